"""URL filters with redirect equivalence, in DataFrame expressions only.

Rules name a host and a path prefix. A rule fits a url if the url's host is the rule's host or a subdomain
and its path begins with the rule's path; the longest fitting rule (host, then path) decides the page.

Pages without a rule get their verdict from their aliases. A page's address is its host, path and query.
Addresses are joined by edges: canonical links and refresh redirects read from the page's html, and any
redirects given as a table. Within a connected component an explicit allow of a member takes precedence
over blocks; else a block of any member blocks all; else the page is allowed. A page's own rule always
holds, whatever its aliases say.

All links of a page count. Relative ones are resolved against the page's ``<base href>`` or its own address; ``.`` and
``..`` segments are resolved in all addresses, ``&amp;`` is read as ``&``, and an empty path is ``/``.

Null urls and urls without ``://`` have empty host and path, fit no rule and have no aliases; they are
allowed. Null or empty html gives no edges. Repeated rows and repeated urls each get a row. Very long html
is searched whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query, which identify a page whatever its scheme and fragment; null if there is no host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host(url) != "", F.concat(host(url), plain_path(path(url)), query))


def plain_path(name: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``/`` if it is empty."""
    step = lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).when(x == ".", seen).otherwise(F.array_append(seen, x))
    parts = F.slice(F.split(name, "/", -1), 2, F.size(F.split(name, "/", -1)))
    short = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/"), F.when(name.rlike(r"/[.]{1,2}$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(name == "", F.lit("/")).when(name.contains("/."), F.regexp_replace(short, "^//$", "/")).otherwise(name)


def _labels(name: Column, most: int) -> list[Column]:
    """The host itself and its parent domains down to ``most`` labels, as columns."""
    return [F.substring_index(name, ".", -n) for n in range(1, most + 1)]


def decide(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add host, path, ``rule`` (host and path of the longest fitting rule, or null) and its ``action``.

    ``rules`` are (action, host, path); the list is a setting, not data, and becomes one expression.
    """
    out = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow"), reverse=True)
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ordered]
    pick = lambda i: reduce(lambda c, k: c.when(fits[k], F.lit(i(ordered[k]))), range(1, len(ordered)), F.when(fits[0], F.lit(i(ordered[0]))))
    if not ordered:
        return out.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    return out.withColumns({"rule": pick(lambda r: r[1] + r[2]), "action": pick(lambda r: r[0])})


def page_edges(pages: DataFrame) -> DataFrame:
    """(u, v) addresses joined by a canonical link or a refresh redirect in the html; relative ones are resolved."""
    own = address(F.col("url"))
    some = pages.select("url", "html").where(F.lower("html").rlike(r"canonical|http-equiv")).where(own.isNotNull())
    found = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))
    links = some.select("url", F.regexp_extract("html", BASE, 1).alias("given"), F.explode(F.array_distinct(found)).alias("to")).withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))

    def resolve(to: Column, from_: Column) -> Column:
        root = F.concat(F.regexp_extract(from_, r"(?s)^(.*?)://", 1), F.lit("://"), host(from_))
        return (
            F.when(to.contains("://"), to)
            .when(to.startswith("//"), F.concat(F.regexp_extract(from_, r"(?s)^(.*?)://", 1), F.lit(":"), to))
            .when(to.startswith("/"), F.concat(root, to))
            .otherwise(F.concat(root, F.when(path(from_) == "", F.lit("/")).otherwise(F.regexp_extract(path(from_), r"(?s)^(.*/)?", 1)), to))
        )

    links = links.withColumn("base", F.when(F.col("given") == "", F.col("url")).otherwise(resolve(F.col("given"), F.col("url"))))
    whole = resolve(F.col("to"), F.col("base"))
    return links.where("to != ''").select(own.alias("u"), address(whole).alias("v")).where("v is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, address, component of every row of ``pages`` (page_id, url, html).

    ``redirects`` (from_url, to_url) adds edges that the html does not show.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("from_url")), address(F.col("to_url"))))
    components = connected_components(edges)
    # Without pages' html from here on. An address outside the edges is a component of its own.
    ruled = decide(pages.select("page_id", "url"), rules).withColumn("address", address(F.col("url")))
    placed = materialize(
        ruled.join(components.withColumnRenamed("node", "address"), "address", "left").withColumn("component", F.coalesce("component", "address")), "pages"
    )
    decisions = (
        placed.where("component is not null")
        .groupBy("component")
        .agg(F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"))
        .where("blocked and not allowed")
        .select("component", F.lit("block").alias("inherited"))
    )
    decisions = materialize(decisions, "decisions")  # one row a blocked component; Spark may split the tasks of a large one
    verdict = F.coalesce("action", "inherited", F.lit("allow"))
    return placed.join(decisions, "component", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "address", "component")
