"""Candidates of a field: preference tiers, agreement of two sources, matching of labels, densifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_similarity, normalize_label

#: Characters of the runs under which texts are filed.
GRAM = 3


def agree(a: Column, b: Column) -> Column:
    """Whether two amounts differ by at most 1 or 0.01 % of the first; null if either is."""
    return F.abs(a - b) <= F.greatest(F.lit(1), F.abs(a) * 0.0001)


def prefer_tier(cands: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """The candidates of the lowest tier that each key has; a null tier is never kept."""
    best = F.min("_tier").over(Window.partitionBy(*keys))
    return cands.withColumn("_tier", tier).where("_tier is not null").withColumn("_best", best).where("_tier = _best").drop("_tier", "_best")


def resolve_balance(df: DataFrame, assets: str, liabilities: str) -> DataFrame:
    """Add balance and balance_status: both sides agreeing are confirmed, differing conflict, one side is derived, none is missing."""
    a, b = F.col(assets), F.col(liabilities)
    both = a.isNotNull() & b.isNotNull()
    status = F.when(both & agree(a, b), "confirmed").when(both, "conflicting").when(a.isNull() & b.isNull(), "missing").otherwise("derived")
    return df.withColumns({"balance_status": status, "balance": F.when(~both | agree(a, b), F.coalesce(a, b))})


def resolve_net_result(df: DataFrame, xiii: str, xvi: str, income: str, balance: str) -> DataFrame:
    """Add net_result, net_status and net_warning from up to four printed values of the same result.

    The two numbered lines agreeing win, and say so if the balance sheet differs; differing, they leave it to the
    balance sheet or conflict. Without both of them the balance sheet wins over a differing income statement.
    """
    a, b, c, d = map(F.col, (xiii, xvi, income, balance))
    numbered = a.isNotNull() & b.isNotNull()
    same = numbered & agree(a, b)
    value = F.when(same, a).when(numbered, d).when(agree(c, d), c).otherwise(F.coalesce(d, c))
    warning = (
        F.when(same & ~agree(a, d), "balance_differs").when(numbered & ~same, "lines_differ").when(~numbered & c.isNotNull() & d.isNotNull() & ~agree(c, d), "income_differs")
    )
    status = F.when(value.isNotNull(), "confirmed").when(numbered, "conflicting").otherwise("missing")
    return df.withColumns({"net_result": value, "net_status": status, "net_warning": warning})


def _grams(text: Column, size: int = GRAM) -> Column:
    """Distinct runs of ``size`` characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def _pieces(text: Column) -> Column:
    """Every run of characters under which a text that holds a given one may be filed: of ``GRAM`` characters and of fewer."""
    return F.flatten(F.array(*(F.when(F.length(text) >= n, _grams(text, n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))


def _filed(texts: DataFrame, text: str, counts: DataFrame) -> DataFrame:
    """``texts`` with ``_key``: the run of ``GRAM`` characters that is rarest by ``counts`` (_key, _n), the whole text if it is shorter."""
    keyed = texts.select("*", F.explode(F.when(F.length(text) >= GRAM, _grams(F.col(text))).otherwise(F.array(text))).alias("_key")).join(counts, "_key", "left")
    rarest = F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key"))
    return keyed.groupBy(*texts.columns).agg(rarest.alias("_key"))


def label_pairs(labels: DataFrame, aliases: DataFrame, least: float) -> DataFrame:
    """(_label, _alias) of distinct normal texts that may have a similarity of ``least`` (0.5 or more), each pair once.

    Three joins by equal keys find them. Shared words: each side gives its rarest words, as many as it cannot all miss. A label that
    holds an alias: the alias is filed under its rarest run of characters, the label looks under all of its own. An alias that holds
    a label nearly as long: the other way round. No text meets one with which it shares nothing.
    """
    words = lambda x: F.array_distinct(F.split(x, " "))
    held = aliases.select("_alias", F.explode(words(F.col("_alias"))).alias("_word"))
    counts = held.groupBy("_word").agg(F.count("*").alias("_n"))
    share = max(least, 0.5)

    def rare(texts: DataFrame, name: str) -> DataFrame:
        told = texts.select(name, F.explode(words(F.col(name))).alias("_word")).join(counts, "_word", "left")
        order = Window.partitionBy(name).orderBy(F.coalesce("_n", F.lit(0)), "_word")
        ranked = told.select(name, "_word", F.row_number().over(order).alias("_k"), F.count("*").over(Window.partitionBy(name)).alias(f"{name}_size"))
        return ranked.where(F.col("_k") <= F.col(f"{name}_size") - F.ceil(F.col(f"{name}_size") * share - 1e-9) + 1).drop("_k")

    left, right = F.col("_label_size"), F.col("_alias_size")
    shared = rare(labels, "_label").join(rare(aliases, "_alias"), "_word").where((left >= right * share - 1e-9) & (right >= left * share - 1e-9))

    def holding(outer: DataFrame, o: str, inner: DataFrame, i: str) -> DataFrame:
        looks = outer.select(o, F.explode(_pieces(F.col(o))).alias("_key"))
        filed = _filed(inner, i, looks.groupBy("_key").agg(F.count("*").alias("_n")))
        return looks.join(filed, "_key").where(F.col(o).contains(F.col(i)))

    inside = holding(labels, "_label", aliases, "_alias")
    around = holding(aliases, "_alias", labels, "_label").where(F.length("_label") >= F.length("_alias") * 0.9)
    found = [x.select("_label", "_alias") for x in (shared, inside, around)]
    return found[0].union(found[1]).union(found[2]).distinct()


def match_labels(rows: DataFrame, label: str, aliases: DataFrame, least: float = 0.7) -> DataFrame:
    """Add code and similarity of the most similar alias, at ``least`` (0.5 or more); the first alias (``pos``) if equal, then the least code.

    ``aliases`` (code, alias, pos) may be of any size: an index of words and runs of characters finds the pairs that can be similar,
    whose similarity is then computed. Rows with equal normal labels share one trial. Rows without a match have nulls.
    """
    known = aliases.select("code", normalize_label(F.col("alias")).alias("_alias"), "pos").where("_alias <> ''")
    labels = rows.select(normalize_label(F.col(label)).alias("_label")).where("_label <> ''").distinct()
    pairs = label_pairs(labels, known.select("_alias").distinct(), least).withColumn("similarity", label_similarity(F.col("_label"), F.col("_alias"))).where(F.col("similarity") >= least)
    choice = F.struct((-F.col("similarity")).alias("_s"), "pos", "code", "similarity")
    best = pairs.join(known, "_alias").groupBy("_label").agg(F.min(choice).alias("_b"))
    return rows.withColumn("_label", normalize_label(F.col(label))).join(best, "_label", "left").select(*rows.columns, F.col("_b.code").alias("code"), F.col("_b.similarity").alias("similarity"))


def densify(values: DataFrame, keys: list[str], codes: list[str]) -> DataFrame:
    """One row for each key and code: (keys, code, value, status), absent ones with status missing; one shuffle, no join.

    Of several rows of a code the largest (status, value) stays; callers resolve before.
    """
    picks = values.groupBy(*keys).agg(*(F.max(F.when(F.col("code") == c, F.struct("status", "value"))).alias(f"_{i}") for i, c in enumerate(codes)))
    cells = [F.struct(F.lit(c).alias("code"), F.col(f"_{i}.value").alias("value"), F.coalesce(F.col(f"_{i}.status"), F.lit("missing")).alias("status")) for i, c in enumerate(codes)]
    return picks.select(*keys, F.inline(F.array(*cells)))
