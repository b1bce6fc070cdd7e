"""Page and document types from marker words. Markers are literals of the plan, so a page is read once and not joined."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalize_label

# Markers of page types in order of precedence, and hits from which a type holds by itself.
MARKERS = [
    ("IDENTIFICATION", ["identification du contribuable", "pieces annexes a la declaration", "raison sociale", "identifiant fiscal"], 2),
    ("BILAN_ACTIF", ["bilan actif", "bilan - actif", "immobilisations incorporelles", "immobilisations corporelles", "creances de l actif circulant", "tresorerie actif", "total general i"], 2),
    ("BILAN_PASSIF", ["bilan passif", "bilan - passif", "capitaux propres", "dettes de financement", "passif circulant", "tresorerie passif"], 2),
    ("DETAIL_CPC", ["detail des postes du cpc", "detail des postes du c p c", "redevances de credit bail", "achats consommes de matieres"], 1),
    ("RESULTAT_FISCAL", ["passage du resultat net comptable", "resultat net fiscal", "reintegrations fiscales", "deductions fiscales"], 1),
    ("ESG", ["etat des soldes de gestion", "capacite d autofinancement", "tableau de formation des resultats", "valeur ajoutee"], 1),
    ("CPC", ["compte de produits et charges", "produits d exploitation", "charges d exploitation", "resultat financier", "resultat courant", "chiffre d affaires"], 2),
]

# Words that let a page continue the type of the page before.
CONTINUATION = {
    "BILAN_ACTIF": ["immobilisation", "actif circulant", "tresorerie actif", "creances", "stocks"],
    "BILAN_PASSIF": ["capitaux propres", "dettes de financement", "passif circulant", "tresorerie passif"],
    "CPC": ["produits d exploitation", "charges d exploitation", "produits financiers", "charges financieres", "resultat"],
}

# Types to try after a type, and the order of last resort.
TRANSITIONS = {
    "IDENTIFICATION": ["BILAN_ACTIF", "BILAN_PASSIF", "CPC"],
    "BILAN_ACTIF": ["BILAN_PASSIF", "CPC", "BILAN_ACTIF"],
    "BILAN_PASSIF": ["CPC", "DETAIL_CPC", "BILAN_ACTIF"],
    "CPC": ["DETAIL_CPC", "RESULTAT_FISCAL", "CPC", "BILAN_PASSIF"],
    "DETAIL_CPC": ["RESULTAT_FISCAL", "ESG", "CPC"],
    "RESULTAT_FISCAL": ["ESG", "DETAIL_CPC", "CPC"],
    "ESG": ["DETAIL_CPC", "RESULTAT_FISCAL"],
}
FALLBACK = ["BILAN_ACTIF", "BILAN_PASSIF", "CPC", "DETAIL_CPC", "RESULTAT_FISCAL", "ESG"]

# Document types by precedence (any of these words, all of those), period type and confidence.
DOCUMENTS = [
    ("forecast_financial_statements", "forecast", 0.9, ["prévisionnel", "previsionnel", "bilan prévisionnel", "bilan previsionnel", "forecast", "budget"], []),
    ("interim_financial_statements", "interim", 0.8, ["situation provisoire", "situation intermédiaire", "situation intermediaire"], []),
    ("extraction_report", "actual", 0.95, ["rapport des éléments financiers", "elements financiers calcules"], []),
    ("financial_statements", "actual", 0.8, [], ["bilan (actif)", "bilan (passif)"]),
    ("tax_return", "actual", 0.75, ["liasse fiscale"], []),
]

# Simple page types, the first with one of its words.
SIMPLE = [
    ("IDENTIFICATION", ["identification du contribuable", "raison sociale"]),
    ("BILAN_ACTIF", ["bilan (actif)"]),
    ("BILAN_PASSIF", ["bilan (passif)"]),
    ("CPC", ["compte de produits", "cpc"]),
    ("ESG", ["etat des soldes de gestion", "capacité d'autofinancement", "capacite d autofinancement"]),
    ("RESULTAT_FISCAL", ["résultat fiscal", "resultat fiscal"]),
    ("AMORTISSEMENTS", ["amortissements"]),
    ("PROVISIONS", ["provisions"]),
    ("CREDIT_BAIL", ["credit-bail", "crédit-bail"]),
    ("ANNEXE", ["annexe"]),
]


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    return reduce(Column.__add__, [text.contains(w).cast("int") for w in words], F.lit(0))


def _any(text: Column, words: list[str]) -> Column:
    return hits(text, words) > 0


def classify_pages(
    pages: DataFrame, doc: str, page: str, text: str, markers: list[tuple[str, list[str], int]] = MARKERS, continuation: dict[str, list[str]] = CONTINUATION, alone: str = "DETAIL_CPC", shortest: int = 12
) -> DataFrame:
    """(doc, page, page_type): the type with most markers, the first of ``markers`` if equal.

    ``alone`` holds at its first marker. Below its threshold a type gives way to the type found on the page before
    (the last that had one) if a word of that one's continuation occurs. No marker, or a folded text under
    ``shortest`` characters, gives null. Texts are reduced to counts before pages of a document meet; then one
    scan follows the pages in order, which no window expresses. Pages of one number go by their types.
    """
    folded = pages.select(doc, page, normalize_label(F.col(text)).alias("_t"))
    t = F.col("_t")
    scores = [hits(t, words) for _, words, _ in markers]
    names = [name for name, _, _ in markers]
    best = F.greatest(*scores)
    pick = reduce(lambda acc, i: acc.when(scores[i] == best, F.lit(i)), range(len(names)), F)
    if alone in names:
        only = scores[names.index(alone)] > 0
        pick = F.when(only, names.index(alone)).otherwise(pick)
    scored = folded.select(
        doc, page, best.alias("best"), pick.alias("pick"), F.array_compact(F.array(*[F.when(_any(t, w), F.lit(n)) for n, w in continuation.items()])).alias("goes_on"), (F.length(t) >= shortest).alias("long")
    )
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pick") + 1)
    found = F.col("long") & (F.col("best") > 0)
    weak = F.col("best") < at([n for _, _, n in markers])
    if alone in names:
        weak = weak & (F.col("pick") != names.index(alone))
    rows = scored.select(doc, page, F.when(found, at(names)).alias("kind"), F.coalesce(found & weak, F.lit(False)).alias("weak"), "goes_on")
    dealt = rows.repartition(doc).sortWithinPartitions(doc, page, "kind", "weak", "goes_on")
    kinds = dict(dealt.dtypes)
    return dealt.mapInArrow(_carry, f"`{doc}` {kinds[doc]}, `{page}` {kinds[page]}, page_type string")


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, page, page_type) of sorted rows (doc, page, kind, weak, goes_on).

    Each page maps the type found last to its own type and the type found last after it; the maps are applied one after the other,
    so a document of any length is one pass and nothing of it is held but its last type.
    """
    own, last = None, None
    for batch in batches:
        docs, out = batch.column(0).to_pylist(), []
        for name, kind, weak, goes_on in zip(docs, *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            if name != own:
                own, last = name, None
            if weak and last in goes_on:
                kind = last  # noqa: PLW2901
            last = kind or last
            out.append(kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[batch.schema.names[0], batch.schema.names[1], "page_type"])


def types_to_try(primary: Column, previous: Column, most: int = 3) -> Column:
    """Types to try in turn: the page's, those that follow the page before (or it), then the order of last resort."""
    known = [*FALLBACK, "IDENTIFICATION"]
    after = F.coalesce(previous, primary)
    follow = reduce(lambda acc, kv: acc.when(after == kv[0], F.array(*map(F.lit, kv[1]))), TRANSITIONS.items(), F).otherwise(F.array().cast("array<string>"))
    wanted = F.concat(F.array(primary), follow, F.array(*map(F.lit, FALLBACK)))
    return F.slice(F.array_distinct(F.filter(wanted, lambda x: x.isin(known))), 1, most)


def blank_or_other(folded: Column, page_type: Column, blank: Column) -> Column:
    """VIDE or AUTRE for a page without a type; ``blank`` says whether its image is empty (null counts as so)."""
    empty = F.coalesce(blank, F.lit(True))
    return F.when(empty & (F.length(folded) < 12), "VIDE").when((F.length(folded) >= 30) & page_type.isNull(), "AUTRE").when(~empty, "AUTRE").otherwise("VIDE")


# Wording without which a page after the first is no identification.
STRONG_IDENTITY = ["identification du contribuable", "pieces annexes a la declaration"]


def demote_identification(page_type: Column, page: Column, folded: Column) -> Column:
    """The page type, null for an identification on the second page or later that lacks its strong marks."""
    return F.when((page_type == "IDENTIFICATION") & (page >= 2) & ~_any(F.coalesce(folded, F.lit("")), STRONG_IDENTITY), None).otherwise(page_type)


def simple_page_type(text: Column, has_visual: Column, rules: list[tuple[str, list[str]]] = SIMPLE) -> Column:
    """The first simple type with one of its words; pages without text are a scan or blank."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.trim(F.regexp_replace(lowered, r"\s+", " ")) == "", F.when(F.coalesce(has_visual, F.lit(False)), "SCAN").otherwise("BLANCHE"))
    return reduce(lambda acc, r: acc.when(_any(lowered, r[1]), r[0]), rules, out).otherwise("AUTRE")


def document_types(pages: DataFrame, doc: str, text: str, rules: list[tuple] = DOCUMENTS) -> DataFrame:
    """(doc, document_type, period_type, confidence): the first rule met by the words of all pages; flags combine before the shuffle."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = [[F.max(_any(lowered, [w])) for w in every] if every else [F.max(_any(lowered, some))] for _, _, _, some, every in rules]
    out = pages.groupBy(doc).agg(*(reduce(Column.__and__, f).alias(f"_{i}") for i, f in enumerate(flags)))
    choose = lambda k, otherwise: reduce(lambda acc, i: acc.when(F.col(f"_{i}"), rules[i][k]), range(len(rules)), F).otherwise(otherwise)
    return out.select(doc, choose(0, "unknown").alias("document_type"), choose(1, "unknown").alias("period_type"), choose(2, 0.55).alias("confidence"))
