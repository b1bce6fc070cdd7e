"""Sections of page text: where they start, what a page without a start continues, splits and bounded parts.

A page's sections are worked out in arrays of its own row; only the section that a page continues needs its document's
earlier pages, by a forward fill.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import bind
from ..functions.labels import fold
from ..functions.pages import prefix_sums
from .tables import chunks

# Patterns at which a section starts, in order.
STARTS = [
    ("BILAN_ACTIF", r"(?iU)\bbilan\s*[-–—]?\s*actif\b"),
    ("BILAN_PASSIF", r"(?iU)\bbilan\s*[-–—]?\s*passif\b"),
    ("DETAIL_CPC", r"(?iU)\bd[eé]tail\s+des\s+postes\s+du\s+c\.?\s*p\.?\s*c\.?\b"),
    ("RESULTAT_FISCAL", r"(?isU)passage\s+du\s+r[eé]sultat\s+net\s+comptable.*r[eé]sultat\s+net\s+fiscal"),
    ("CPC", r"(?iU)\bcompte\s+de\s+produits\s+et\s+charges\b"),
    ("IDENTIFICATION", r"(?iU)pi[eè]ces\s+annexes\s+[àa]\s+la\s+d[eé]claration|identification\s+du\s+contribuable"),
]
CONTINUED = ["BILAN_ACTIF", "BILAN_PASSIF", "CPC", "DETAIL_CPC", "RESULTAT_FISCAL"]
# Wording by which a page without a start is known, two of a section at least.
IMPLICIT = {
    "BILAN_ACTIF": ["immobilisation en non valeur", "immobilisations incorporelles", "immobilisations corporelles", "creances de l actif circulant", "tresorerie actif", "stocks f"],
    "BILAN_PASSIF": ["capitaux propres", "dettes de financement", "passif circulant", "tresorerie passif"],
    "CPC": ["produits d exploitation", "charges d exploitation", "resultat d exploitation", "produits financiers", "charges financieres"],
}
ASSETS = r"(?iU)immobilisation\s+en\s+non\s+valeur|immobilisations\s+incorporelles|immobilisations\s+corporelles"
IDENTITY = ["identification", "pieces annexes", "raison sociale", "contribuable"]
# Parts of long sections.
PARTS = {
    "BILAN_PASSIF": [
        ("CAPITAUX_PROPRES", r"(?iU)\bcapitaux\s+propres\b"), ("DETTES_FINANCEMENT", r"(?iU)\bdet+es?\s+de\s+financement\b"), ("PASSIF_CIRCULANT", r"(?iU)\bpassif\s+circulant\b"),
        ("TRESORERIE_PASSIF", r"(?iU)\btresorerie\s*[-–—]?\s*passif\b"),
    ],
    "CPC": [
        ("PRODUITS_EXPLOITATION", r"(?iU)\bproduits\s+d['’]?\s*exploitation\b"), ("CHARGES_EXPLOITATION", r"(?iU)\bcharges\s+d['’]?\s*exploitation\b"),
        ("PRODUITS_CHARGES_FINANCIERS", r"(?iU)\b(?:produits|charges)\s+financi[eè]res?\b"), ("RESULTATS", r"(?iU)\b(?:xiii|xvi)?\s*resultat\s+net\b|\bresultat\s+courant\b"),
        ("NON_COURANT", r"(?iU)\b(?:produits|charges)\s+non\s+courants?\b"),
    ],
}
_START = "array<struct<pos:int,section:string>>"
_PIECE = "struct<section:string,text:string>"


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def positions(text: Column, pattern: str) -> Column:
    """Offsets (from 0) of all matches of ``pattern``: running lengths of what lies between and of the matches."""
    parts = F.struct(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x)).alias("hits"))

    def places(p: Column) -> Column:
        steps = F.transform(p["hits"], lambda h, i: F.get(p["gaps"], i) + h)  # a gap and the match after it
        return F.transform(F.arrays_zip(prefix_sums(steps).alias("to"), F.slice(p["gaps"], F.lit(1), F.size(p["hits"])).alias("gap")), lambda x: x["to"] + x["gap"])

    return F.when(text.isNotNull(), bind(parts, places))


def section_starts(text: Column, patterns: list[tuple[str, str]] = STARTS, gap: int = 10) -> Column:
    """(pos, section) of all starts in order; one less than ``gap`` after the last kept one is dropped."""

    def tag(order: int, name: str):
        return lambda at: F.struct(at.alias("pos"), F.lit(order).alias("order"), F.lit(name).alias("section"))

    found = [F.transform(positions(text, p), tag(i, s)) for i, (s, p) in enumerate(patterns)]
    ordered = F.array_sort(F.concat(*found))
    item = lambda x: F.struct(x["pos"].alias("pos"), x["section"].alias("section"))
    near = lambda kept, x: (F.size(kept) > 0) & (x["pos"] - F.element_at(kept, -1)["pos"] < gap)
    return F.aggregate(ordered, F.array().cast(_START), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.array_append(kept, item(x))))


def segments(text: Column, starts: Column) -> Column:
    """(section, text) from each start to the next or the end, trimmed."""
    return F.transform(starts, lambda s, i: F.struct(s["section"].alias("section"), strip(F.substring(text, s["pos"] + 1, F.coalesce(F.get(starts, i + 1)["pos"], F.length(text)) - s["pos"])).alias("text")))


def segment_end(starts: DataFrame, keys: list[str], start: str, length: str) -> DataFrame:
    """Add the end of each start's segment: the next start of its key, or ``length``."""
    return starts.withColumn("end", F.lead(start, 1).over(Window.partitionBy(*keys).orderBy(start))).withColumn("end", F.coalesce("end", length))


def implicit_section(text: Column) -> Column:
    """The section of which a text holds most marks, two at least; the first listed if equal."""
    folded = fold(text)
    marks = [(s, sum((folded.contains(m).cast("int") for m in words[1:]), folded.contains(words[0]).cast("int"))) for s, words in IMPLICIT.items()]
    most = F.greatest(*(n for _, n in marks))
    return F.when(most >= 2, reduce(lambda c, m: c.when(m[1] == most, m[0]), marks[1:], F.when(marks[0][1] == most, marks[0][0])))


def split_identity(piece: Column) -> Column:
    """A piece as one or two: identification before the first mark of assets, and the assets from there."""
    text, section = piece["text"], piece["section"]
    at = F.regexp_instr(text, F.lit(ASSETS)) - 1
    head, tail = strip(F.substring(text, F.lit(1), at)), strip(F.substring(text, at + 1, F.length(text)))
    folded = fold(head)
    known = (section == "IDENTIFICATION") | reduce(lambda a, b: a | b, [folded.contains(w) for w in IDENTITY])
    part = lambda name, t: F.when(F.length(t) >= 20, F.struct(F.lit(name).alias("section"), t.alias("text")))
    both = F.array_compact(F.array(part("IDENTIFICATION", head), part("BILAN_ACTIF", tail)))
    return F.when((at >= 20) & known & (F.size(both) > 0), both).otherwise(F.array(piece.cast(_PIECE)))


def split_sections(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, part, section, text) of readable ``pages`` (document_id, page_number, status, content).

    Text before a page's first start (50 characters at least) and pages without any go on with the section that the
    document's earlier pages ended in, if it is one that goes on; pages of an unknown kind are ``AUTRE``.
    """
    text = strip(F.coalesce("content", F.lit("")))
    df = pages.where("status = 'ok'").select("document_id", "page_number", text.alias("text")).where(~F.col("text").isin("", "[PAGE VIDE]"))
    df = df.withColumns({"starts": section_starts(F.col("text")), "implicit": implicit_section(F.col("text"))})
    own = F.filter(segments(F.col("text"), F.col("starts")), lambda s: F.length(s["text"]) >= 20)
    whole = lambda s: F.struct(s.alias("section"), F.col("text").alias("text"))
    folded = fold(F.col("text"))
    named = folded.contains("identification") | folded.contains("pieces annexes")
    none = F.array().cast(f"array<{_PIECE}>")
    found = F.when(F.size("starts") > 0, F.flatten(F.transform(own, split_identity))).when(F.col("implicit").isNotNull(), split_identity(whole(F.col("implicit")))).otherwise(none)
    df = df.withColumn("found", found)
    last = F.element_at(F.filter("found", lambda x: x["section"].isin(CONTINUED)), -1)["section"]
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    # identification that splits off assets on a page of its own kind counts too, where no section goes on
    weak = F.when((F.size("starts") == 0) & F.col("implicit").isNull() & named, split_identity(whole(F.lit("IDENTIFICATION")))).otherwise(none)
    df = df.withColumns({"weak": weak, "_last": F.when(F.size("found") > 0, F.get(F.array(last), F.lit(0)))})
    df = df.withColumn("previous", F.last("_last", ignorenulls=True).over(before))
    weak_last = F.element_at(F.filter("weak", lambda x: x["section"].isin(CONTINUED)), -1)["section"]
    df = df.withColumn("_last", F.coalesce("_last", F.when(F.col("previous").isNull() & (F.size("weak") > 0), F.get(F.array(weak_last), F.lit(0)))))
    df = df.withColumn("previous", F.last("_last", ignorenulls=True).over(before))
    head = strip(F.substring(F.col("text"), F.lit(1), F.get("starts", F.lit(0))["pos"]))
    goes_on = F.col("previous").isNotNull()
    with_head = F.when(goes_on & (F.length(head) >= 50), F.array_prepend("found", F.struct(F.col("previous").alias("section"), head.alias("text")))).otherwise(F.col("found"))
    without = F.when(goes_on, F.array(whole(F.col("previous")))).when(F.size("weak") > 0, F.col("weak")).otherwise(F.array(whole(F.lit("AUTRE"))))
    pieces = F.when(F.size("starts") > 0, with_head).when(F.size("found") > 0, F.col("found")).otherwise(without)
    return df.select("document_id", "page_number", F.posexplode(pieces).alias("part", "p")).select("document_id", "page_number", "part", "p.section", "p.text")


def split_parts(section: Column, text: Column, gap: int = 20) -> Column:
    """Texts of the parts of liabilities and income statements, each under a heading; the text itself if there are not two."""
    out = F
    for name, patterns in PARTS.items():
        starts = section_starts(text, patterns, gap)
        parts = F.transform(F.filter(segments(text, starts), lambda s: s["text"] != ""), lambda s: F.concat(F.lit("SOUS-SECTION : "), s["section"], F.lit("\n\n"), s["text"]))
        out = out.when((section == name) & (F.size(starts) >= 2) & (F.size(parts) > 0), parts)
    return out.otherwise(F.array(text))


def chunk_sections(sections: DataFrame, most: int) -> DataFrame:
    """``sections`` with ``chunk`` and ``text`` of at most ``most`` characters: its parts if each fits, else lines packed in order."""
    parts = split_parts(F.col("section"), F.col("text"))
    fits = (F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) <= most)
    pieces = F.when(F.length("text") <= most, F.array("text")).when(fits, parts).otherwise(chunks(F.col("text"), most))
    rest = [c for c in sections.columns if c != "text"]
    return sections.select(*rest, F.posexplode(pieces).alias("chunk", "text"))
