"""Accounting labels: normal form and asymmetric similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters whose decomposition is one base letter and marks, by rule rather than as a table.
_PAIRS = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)]
_FROM, _TO = "".join(p[0] for p in _PAIRS), "".join(p[1] for p in _PAIRS)


def normalize_label(label: Column) -> Column:
    """Without accents, lower case, ligatures spelt out, punctuation to blanks, blanks collapsed; null gives ''.

    Latin letters only: built-in functions, so plans stay in generated code.
    """
    text = F.lower(F.translate(F.coalesce(label, F.lit("")), _FROM, _TO))
    text = F.replace(F.replace(text, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Mn}+", ""), r"[^a-z0-9_\p{L}\p{N}]+", " "))  # plain letters are told first


def label_similarity(observed: Column, alias: Column) -> Column:
    """Score in [0, 1] of two normal labels: equal 1, alias within label 0.75 and more, label within alias only if nearly as long, else shared words if half or more."""
    size = lambda x: F.length(x).cast("double")
    words = lambda x: F.array_distinct(F.split(x, " "))
    share = F.size(F.array_intersect(words(observed), words(alias))) / F.size(F.array_union(words(observed), words(alias)))
    return (
        F.when((observed == "") | (alias == ""), 0.0)
        .when(observed == alias, 1.0)
        .when(observed.contains(alias), 0.75 + 0.25 * size(alias) / size(observed))
        .when(alias.contains(observed), F.when(size(observed) / size(alias) >= 0.9, 0.7 + 0.2 * size(observed) / size(alias)).otherwise(0.0))
        .when(share >= 0.5, share)
        .otherwise(0.0)
    )


# Misreadings of scanned labels.
MISREADINGS = [(r"(?i)\bdettees\b", "dettes"), (r"(?i)\bimmobliisations\b", "immobilisations"), (r"(?i)\bsolid es\b", "soldes")]


def mended(label: Column) -> Column:
    """A label without the known misreadings."""
    out = F.coalesce(label, F.lit(""))
    for pattern, right in MISREADINGS:
        out = F.regexp_replace(out, pattern, right)
    # one search tells the labels that hold none
    return F.when(label.rlike("|".join(pattern for pattern, _ in MISREADINGS)), out).otherwise(label)


def normalize_ocr_label(label: Column) -> Column:
    """``normalize_label`` after the known misreadings are mended."""
    return normalize_label(mended(label))


def _plain(text: Column) -> Column:
    """Whether a text has one byte a character, so that neither accents nor marks need be looked for."""
    return F.octet_length(text) == F.length(text)


def latin(label: Column) -> Column:
    """The first step of ``normalize_label``: lower case without accents. The next ones read it several times, so it is best a column."""
    text = F.coalesce(label, F.lit(""))
    return F.lower(F.when(_plain(text), text).otherwise(F.translate(text, _FROM, _TO)))


def normal(text: Column) -> Column:
    """``normalize_label`` of a label that ``latin`` has read. Of lower case alone, what is no word is punctuation; that class is one lookup a character."""
    spelt = F.replace(F.replace(text, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    full = F.regexp_replace(F.regexp_replace(spelt, r"\p{Mn}+", ""), r"[^a-z0-9_\p{L}\p{N}]+", " ")
    return F.trim(F.when(_plain(text), F.regexp_replace(text, r"\W+", " ")).otherwise(full))


def strict(text: Column) -> Column:
    """The ``strict`` fold of a label that ``latin`` has read."""
    return F.trim(F.regexp_replace(F.when(_plain(text), text).otherwise(F.regexp_replace(text, r"\p{Mn}+", "")), r"[\W_]+", " "))


def with_folds(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with the ``ocr`` folds of columns under new names; each step is a column, so that none is made twice."""
    for step in (mended, latin, normal):
        df = df.withColumns({name: step(F.col(name if step is not mended else columns[name])) for name in columns})
    return df


def fold(label: Column, kind: str = "ocr") -> Column:
    """Folded text for comparisons: ``strict`` keeps a-z, 0-9 and blanks, ``ocr`` mends misreadings, ``loose`` keeps punctuation."""
    if kind == "ocr":
        return normalize_ocr_label(label)
    text = F.regexp_replace(F.lower(F.translate(F.coalesce(label, F.lit("")), _FROM, _TO)), r"\p{Mn}+", "")
    if kind == "strict":
        return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_label_full(label: Column) -> Column:
    """``normalize_label`` with compatibility decomposition of every script (ligatures, superscripts, wide forms), on Arrow batches."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def decompose(text):
        return text.fillna("").str.normalize("NFKD")

    decompose.__annotations__ = {"text": pd.Series, "return": pd.Series}  # types, not names, tell the kind of function
    return normalize_label(pandas_udf(decompose, "string")(label))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words of two normal labels over all of both; null if neither has a word."""
    words = lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda w: w != "")
    return F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b))))


def strip_markers(text: Column) -> Column:
    """Without a closing reasoning mark at the end, trimmed."""
    bare = F.trim(text)
    return F.when(F.lower(bare).contains("think"), F.trim(F.regexp_replace(bare, r"(?i)(</?think>|/think)\s*$", ""))).otherwise(bare)


def strip_fences(text: Column) -> Column:
    """Without an opening and a closing code fence, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


def is_grand_total(label: Column) -> Column:
    """Whether a label names the total of all three parts."""
    return names_grand_total(normalize_label(label))


def names_grand_total(normal: Column) -> Column:
    """``is_grand_total`` of a label in its normal form."""
    return F.regexp_replace(normal, r"[*_`#\s]+", " ").rlike(r"\btotal (?:general )?i(?: ?\+ ?| )ii(?: ?\+ ?| )iii\b")


def is_revenue_label(folded: Column) -> Column:
    """Whether a folded label names turnover or a sales line, and no purchase."""
    sales = folded.contains("ventes de biens et services") | folded.contains("ventes de services") | folded.contains("ventes de marchandises")
    return ~folded.contains("achat") & ((folded.contains("chiffre") & folded.contains("affaires")) | sales)


# Column headers and the kind of value under them; on a miss the first that contains the header or lies in it.
COLUMN_HEADERS = [
    ("brut", "brut"), ("bruts", "brut"), ("amortissements et provisions", "amortissement_provision"), ("amortissements", "amortissement_provision"), ("provisions", "amortissement_provision"),
    ("net", "net_n"), ("net exercice", "net_n"), ("net exercice n", "net_n"), ("net de l exercice", "net_n"), ("exercice n", "net_n"), ("net exercice n 1", "net_n_1"), ("net n 1", "net_n_1"),
    ("exercice precedent", "net_n_1"), ("operations propres a l exercice", "exercice"), ("operations concernant les exercices precedents", "exercices_precedents"),
    ("total de l exercice", "total_exercice"), ("total exercice", "total_exercice"), ("exercice", "exercice"),
]


def column_nature(header: Column) -> Column:
    """The kind of value under a column header; ``unknown`` for none."""
    return F.when(F.coalesce(header, F.lit("")) == "", "unknown").otherwise(header_nature(normalize_label(header)))


def header_nature(normal: Column) -> Column:
    """``column_nature`` of a header in its normal form, which is best a column: every known header is compared with it."""
    exact, near = F.element_at(F.create_map(*(F.lit(x) for pair in COLUMN_HEADERS for x in pair)), normal), F
    for key, nature in COLUMN_HEADERS:
        near = near.when(normal.contains(key) | F.lit(key).contains(normal), nature)
    return F.coalesce(exact, near, F.lit("unknown"))
