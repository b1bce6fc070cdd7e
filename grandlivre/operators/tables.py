"""Tables in page text, and texts cut into bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_label


def parse_tables(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, block, row, label, column, value): cells of tables written with bars, one row each.

    Lines between bars that follow each other form a block, numbered from 1 on a page; its first line names the
    columns, a line of dashes is skipped. The first cell is the label; rows without one are dropped, rows keep
    their number. Empty cells are null; cells beyond the header are named ``col_i``. Pages without tables give none.
    """
    lines = pages.select(*keys, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    # a line knows the one before it, so that blocks are told without a window
    lines = lines.withColumn("_before", F.concat(F.array(F.lit("")), F.slice("_lines", F.lit(1), F.size("_lines") - 1)))
    lines = lines.select(*keys, F.posexplode(F.arrays_zip("_lines", "_before")).alias("_n", "_l")).select(*keys, "_n", F.trim("_l._lines").alias("_line"), F.trim("_l._before").alias("_before"))
    table = lambda c: F.col(c).startswith("|") & F.col(c).endswith("|") & (F.length(c) > 1)
    lines = lines.where(table("_line")).withColumn("_new", ~table("_before"))
    cells = F.split(F.trim(F.substring(F.col("_line"), F.lit(2), F.length("_line") - 2)), r" *\| *")  # trimmed by the pattern that parts them
    head = F.when(F.col("_new"), F.struct(F.col("_n").alias("n"), F.col("_cells").alias("cells")))
    page = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("_cells", cells).withColumns({"block": F.sum(F.col("_new").cast("int")).over(page).cast("int"), "_h": F.last(head, ignorenulls=True).over(page)})
    dashes = F.forall("_cells", lambda c: c.rlike("^:?-+:?$"))
    rows = numbered.select(*keys, "block", (F.col("_n") - F.col("_h.n")).alias("row"), "_cells", F.col("_h.cells").alias("_header"))
    rows = rows.where((F.col("row") > 0) & ~dashes & (F.get("_cells", F.lit(0)) != ""))
    out = rows.select(*keys, "block", "row", F.get("_cells", F.lit(0)).alias("label"), "_header", F.posexplode("_cells").alias("_i", "_cell")).where("_i > 0")
    name = F.coalesce(F.nullif(F.get("_header", F.col("_i")), F.lit("")), F.concat(F.lit("col_"), F.col("_i").cast("string")))
    return out.select(*keys, "block", "row", "label", name.alias("column"), F.nullif("_cell", F.lit("")).alias("value"))


def chunks(text: Column, most: int) -> Column:
    """Lines packed in order into chunks of at most ``most`` characters; a longer line is a chunk by itself.

    No line is cut. Null and empty texts have no chunks.
    """
    state = "struct<done:array<string>,open:string>"
    start = F.struct(F.array().alias("done"), F.lit(None).cast("string").alias("open")).cast(state)

    def pack(s: Column, line: Column) -> Column:
        fits = F.length(s["open"]) + 1 + F.length(line) <= most
        grown = F.when(s["open"].isNull(), line).when(fits, F.concat(s["open"], F.lit("\n"), line)).otherwise(line)
        done = F.when(s["open"].isNull() | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(done.alias("done"), grown.alias("open")).cast(state)

    body = F.coalesce(text, F.lit(""))
    packed = F.aggregate(F.split(body, "\n"), start, pack, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(packed)


# Wording by which the section of a page or line is known, the first that matches, and column names of tables.
TABLE_SECTIONS = [
    ("BILAN_ACTIF", r"(?iu)bilan\s*[-–]?\s*actif|actif\s+du\s+bilan"), ("BILAN_PASSIF", r"(?iu)bilan\s*[-–]?\s*passif|passif\s+du\s+bilan"), ("CPC", r"(?iu)compte\s+de\s+produits\s+et\s+charges|\bcpc\b"),
    ("DETAIL_POSTES", r"(?iu)d[eé]tail\s+des\s+postes"), ("RESULTAT_FISCAL", r"(?iu)passage\s+du\s+r[eé]sultat|resultat\s+fiscal"), ("ESG", r"(?iu)etat\s+des\s+soldes|capacité\s+d.?autofinancement|\besg\b"),
]
COLUMNS = {
    "brut": "brut", "amortissements": "amortissements", "amortissements et provisions": "amortissements", "net": "net_n", "net exercice n": "net_n", "net n": "net_n", "exercice n": "net_n",
    "exercice precedent": "net_n_1", "total de l exercice": "total_exercice", "operations propres": "exercice", "exercices precedents": "exercices_precedents",
}


def md_column(header: Column) -> Column:
    """The name of a table's column: a known one, else its normal label, else ``value``."""
    key = normalize_label(header)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in COLUMNS.items() for x in p)), key), F.nullif(key, F.lit("")), F.lit("value"))


def table_section(text: Column) -> Column:
    out = F
    for name, pattern in TABLE_SECTIONS:
        out = out.when(text.rlike(pattern), name)
    return out


def financial_rows(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, row, section, raw_label, normalized_label, values map, excerpt) of the tables in ``pages`` (document_id, page_number, status, content).

    The section is the last one that a page as a whole or a line outside of tables named, over all pages before; ``AUTRE`` until then.
    A block's first line names the columns; of columns of one name the last counts. Empty cells are null, rows without label go.
    """
    page = ["document_id", "page_number"]
    begins = F.get(F.split("content", "\r?\n", 2), F.lit(0))
    whole = F.coalesce(table_section(begins), table_section(F.col("content"))).alias("_whole")  # told before the page's lines part, so that no line carries the page
    lines = pages.where("status = 'ok' and content <> ''").select(*page, whole, F.split("content", "\r?\n").alias("_lines"))
    # a line knows the one before it, so that blocks are told without a window
    lines = lines.withColumn("_before", F.concat(F.array(F.lit("")), F.slice("_lines", F.lit(1), F.size("_lines") - 1)))
    lines = lines.select(*page, "_whole", F.posexplode(F.arrays_zip("_lines", "_before")).alias("_n", "_l")).select(*page, "_whole", "_n", F.col("_l._lines").alias("_line"), F.col("_l._before").alias("_before"))
    row = lambda line: line.rlike(r"^\|(.+)\|\s*$")
    lines = lines.withColumns({"_row": row(F.col("_line")), "_goes_on": row(F.col("_line")) & row(F.col("_before"))})
    named = F.when(F.col("_n") == 0, F.col("_whole")).when(~F.col("_goes_on"), table_section(F.col("_line")))
    lines = lines.select(*page, "_n", "_row", "_goes_on", named.alias("_named"), F.when(F.col("_row"), F.col("_line")).alias("_line")).where("_row or _named is not null")
    # cells are trimmed by the pattern that parts them; a block's first line gives its names once, each with the last place that has it
    cells = lambda line: F.split(F.trim(F.regexp_replace(F.trim(line), r"^\||\|$", "")), r" *\| *")
    first = F.col("_row") & ~F.col("_goes_on")
    every = F.when(first, F.transform(F.slice(cells(F.col("_line")), F.lit(2), F.size(cells(F.col("_line")))), md_column))
    lines = lines.withColumn("_every", every).withColumn("_keys", F.array_distinct("_every"))
    places = F.transform("_keys", lambda k: F.size("_every") - F.array_position(F.reverse("_every"), k).cast("int") + 1)
    lines = lines.withColumn("_head", F.when(first, F.struct(F.col("_n").alias("n"), F.col("_keys").alias("keys"), places.alias("places")))).drop("_every", "_keys")
    # a line that goes on names no section, so the last section and the last head are those of its own block
    sofar = Window.partitionBy("document_id").orderBy("page_number", "_n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(sofar)
    lines = lines.select(*page, "_n", "_row", "_line", F.coalesce(last("_named"), F.lit("AUTRE")).alias("section"), last("_head").alias("_head"))
    rows = lines.where(F.col("_row") & (F.col("_n") > F.col("_head.n")) & (F.size("_head.keys") > 0)).withColumn("_cells", cells(F.col("_line")))
    rows = rows.withColumn("raw_label", F.get("_cells", F.lit(0))).where(~F.col("raw_label").rlike("^[-—:]*$"))
    values = F.map_from_arrays("_head.keys", F.transform("_head.places", lambda i: F.nullif(F.get("_cells", i), F.lit(""))))
    return rows.select(*page, F.col("_n").alias("row"), "section", "raw_label", normalize_label(F.col("raw_label")).alias("normalized_label"), values.alias("values"), F.left(F.trim("_line"), F.lit(240)).alias("excerpt"))
