"""Text of pages: cleaning, identifiers, table quality, routing, and joining of overlapping parts. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import bind


def clean_text(text: Column) -> Column:
    """Line feeds only, blanks within lines collapsed, at most one empty line in a row, trimmed; null gives ''."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x{A0}]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Printed amounts. Grouped: thousands in groups after blanks with an optional decimal comma, or digits with two
# decimals. Cents: two decimals after comma or dot, groups after blanks or dots. Loose: groups and decimals are optional.
AMOUNT_GROUPED = r"[-−]?\d{1,3}(?:[   ]\d{3})+(?:,\d{1,2})?|[-−]?\d+,\d{2}"
AMOUNT_CENTS = r"(?<!\d)(-?\d{1,3}(?:[  .]\d{3})*(?:[,.]\d{2})|-?\d+[,.]\d{2})(?!\d)"
# Short: groups after blanks, an optional decimal comma.
AMOUNT_SHORT = r"[-−]?\d{1,3}(?:[ \u00a0\u202f]\d{3})*(?:,\d{1,2})?"
AMOUNT_LOOSE = r"[-−]?\d{1,3}(?:[   .]\d{3})*(?:[,.]\d{1,2})?"


def prefix_sums(sizes: Column, block: int = 256) -> Column:
    """Sum of the sizes before each element. Blocks are summed first, so no element adds up all before it."""

    def blocks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / block).cast("int")
        return F.struct(xs.alias("xs"), F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))).alias("sums"))

    def heads(s: Column) -> Column:
        return F.struct(s["xs"].alias("xs"), F.transform(s["sums"], lambda _, b: total(F.slice(s["sums"], F.lit(1), b))).alias("before"))

    def places(s: Column) -> Column:
        at = lambda i: (i / block).cast("int")
        return F.transform(s["xs"], lambda _, i: F.get(s["before"], at(i)) + total(F.slice(s["xs"], at(i) * block + 1, i - at(i) * block)))

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return bind(bind(bind(sizes, blocks), heads), places)


def trie_pattern(words: list[str]) -> str:
    """A pattern of all words that prefers the longest, its branches shared by their beginnings, so that a place tries one letter a branch."""
    quote = lambda c: c if c.isalnum() else "\\" + c
    if words == [""]:
        return ""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    body = "|".join(quote(c) + trie_pattern(rest) for c, rest in tails.items())
    return f"(?:{body})" + ("?" if "" in words else "")


def amounts_in(text: Column, form: str = "cents") -> Column:
    """Printed amounts in order, in one of two forms: ``cents`` (two decimals, no digit before or after) or ``grouped``."""
    pattern, group = (AMOUNT_CENTS, 1) if form == "cents" else (AMOUNT_GROUPED, 0)
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def company_number(raw: Column) -> tuple[Column, Column]:
    """Number and city of a register entry such as ``25725/CITY``; null gives two empty strings, no slash an empty city."""
    text = F.coalesce(raw, F.lit(""))
    return F.trim(F.split_part(text, F.lit("/"), F.lit(1))), F.trim(F.split_part(text, F.lit("/"), F.lit(2)))


def clean_identity(fields: dict[str, Column], upper: tuple[str, ...] = ()) -> dict[str, Column]:
    """Identity data trimmed, null as an empty string, those named in ``upper`` in capitals."""
    plain = {n: F.trim(F.coalesce(c, F.lit(""))) for n, c in fields.items()}
    return {n: F.upper(c) if n in upper else c for n, c in plain.items()}


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _table_lines(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: x.startswith("|") & x.endswith("|"))


# Bounds of text quality and routing below: characters, lines, table lines, evenness; characters, image share, rules, words.
SHORT, FEW, TABLE, EVEN = 120, 4, 3, 0.70
BARE, IMAGE, RULES, WORDS = 40, 0.45, 8, 20


def table_quality(text: Column) -> Column:
    """Share of table lines with the most common number of bars; without a table 0.5 for four lines or more, else 0."""
    bars = F.transform(_table_lines(text), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))))
    most = F.array_max(F.transform(F.array_distinct(bars), lambda b: F.size(F.filter(bars, lambda x: x == b))))
    return F.when(F.size(bars) > 0, most / F.size(bars)).when(F.size(_lines(text)) >= FEW, 0.5).otherwise(0.0)


def insufficient_text(text: Column) -> Column:
    """Whether a reading should be repeated: short, few lines, or a table of uneven lines. A page marked empty is fine."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    ragged = (F.size(_table_lines(body)) >= TABLE) & (table_quality(body) < EVEN)
    return (body != "[PAGE VIDE]") & ((F.length(body) < SHORT) | (F.size(_lines(body)) < FEW) | ragged)


def needs_vision(text_length: Column, image_share: Column, rule_lines: Column, words: Column) -> Column:
    """Whether a page goes to the vision path: hardly any text, much image, or a ruled table. Absent measures count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (zero(text_length) < BARE) | (zero(image_share) >= IMAGE) | ((zero(rule_lines) >= RULES) & (zero(words) >= WORDS))


def merge_overlap(top: Column, bottom: Column, most: int = 30) -> Column:
    """Lines of both texts, without the longest run (``most`` at most) that ends one and begins the other.

    Lines are compared in lower case with blanks collapsed. Null counts as empty.
    """
    strip = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"^\s+|\s+$", "")
    lines = lambda t: F.when(strip(t) == "", F.array().cast("array<string>")).otherwise(F.split(strip(t), "\n"))
    norm = lambda x: F.transform(x, lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))))

    def fit(p: Column) -> Column:
        sizes = F.when(p["n"] > 0, F.sequence(p["n"], F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.get(F.filter(sizes, lambda k: F.slice(p["end"], p["n"] - k + 1, k) == F.slice(p["begin"], F.lit(1), k)), F.lit(0)), F.lit(0))

    def edges(p: Column) -> Column:
        n = F.least(F.lit(most), F.size(p["a"]), F.size(p["b"]))
        end = F.when(n > 0, norm(F.slice(p["a"], F.size(p["a"]) - n + 1, n))).otherwise(F.array().cast("array<string>"))
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), n.alias("n"), end.alias("end"), norm(F.slice(p["b"], F.lit(1), n)).alias("begin"))

    # arrays of one struct hold what would be computed again for every length
    once = F.transform(F.array(F.struct(lines(top).alias("a"), lines(bottom).alias("b"))), edges)
    joined = F.transform(once, lambda p: F.array_join(F.concat(p["a"], F.slice(p["b"], fit(p) + 1, F.size(p["b"]))), "\n"))
    return F.regexp_replace(F.get(joined, F.lit(0)), r"^\s+|\s+$", "")


def format_size(size: Column) -> Column:
    """Bytes as o, Ko or Mo with one decimal."""
    return (
        F.when(size < 1024, F.format_string("%d o", size.cast("long")))
        .when(size < 1024 * 1024, F.format_string("%.1f Ko", size / 1024.0))
        .otherwise(F.format_string("%.1f Mo", size / (1024.0 * 1024.0)))
    )


def format_ratio(value: Column, unit: Column) -> Column:
    """A ratio for reading: percent of a fraction, days, times, years; null is n/c."""
    v = value.cast("double")
    return (
        F.when(v.isNull(), "n/c")
        .when(unit == "%", F.format_string("%.1f%%", v * 100))
        .when(unit == "j", F.format_string("%.0f j", v))
        .when(unit == "x", F.format_string("%.2fx", v))
        .when(unit == "ans", F.format_string("%.2f ans", v))
        .otherwise(F.format_string("%.2f", v))
    )
