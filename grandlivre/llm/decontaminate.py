"""Benchmark decontamination with a distributed positional inverted index.

``postings`` stores (term, doc_id, position) of the training tokens. A phrase (a window of consecutive test
words) is found from its rarest terms: the posting lists of its two rarest terms, counted over the whole
corpus, are shifted by the terms' places in the phrase and intersected; what is left is compared whole.
Frequent terms are therefore never intersected where a phrase has rarer ones, and no list is gathered into
one row: lists are rows, keyed by document and start, so a term that is in every document is spread like
the documents are.

Words are those of ``words.py`` and are compared by two independent 64-bit hashes. A window is ``n``
consecutive words of a test item; a shorter item with words is one window. Null and empty documents have no
words; null and empty items have no window. Equal items all count. Every row gets its row and is judged by
its own text: repeated rows of one id and text get equal rows, texts that share an id are told apart when they
are compared whole, and rows without an id are searched like any other, told apart by a hash of their text.
Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, small_batches, texts

WINDOW = 10


def _copy(id_col: str, text_col: str) -> Column:
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("copy")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term long, doc, copy long, position int) of every word of every whole text, positions from 0.

    ``copy`` is null where there is an id and otherwise a hash of the text.
    """
    named = docs.select(F.col(id_col).alias("doc"), _copy(id_col, text_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                _, _, terms, counts = W.words(data, at)
                own = np.repeat(np.arange(hi - lo), counts)
                place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
                doc, copy = (batch.column(k).slice(lo, hi - lo).take(pa.array(own)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), doc, copy, pa.array(place.astype(np.int32))], names=["term", "doc", "copy", "position"])

    return named.mapInArrow(run, f"term long, doc {named.dtypes[0][1]}, copy long, position int")


def phrase_windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window long, terms array<long>): a row for each window of ``n`` words; ``window`` is its content's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, text_col):
                _, _, terms, counts = W.words(data, at)
                hashes, many = W.shingles(terms, counts, n)
                lengths = np.repeat(np.minimum(counts, n), many)
                start = np.repeat(np.cumsum(counts) - counts - (np.cumsum(many) - many), many) + np.arange(len(hashes))
                flat = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(terms[flat].view(np.int64)))
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), many)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64)), lists], names=["item", "window", "terms"])

    return items.select(id_col, text_col).mapInArrow(run, f"item {items.select(id_col).dtypes[0][1]}, window long, terms array<long>")


def rarest_terms(docs: DataFrame, windows: DataFrame, most: int = 2, **cols) -> DataFrame:
    """(window, n, place, term, rarity) for the ``most`` rarest terms of each window whose terms all occur in ``docs``.

    Counts are over all documents. The windows' terms are a written table, so Spark knows its size and
    broadcasts it or not.
    """
    lists = windows.dropDuplicates(["window"]).select("window", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "term"))
    wanted = materialize(lists.select("term").distinct(), "terms")
    counts = postings(docs, **cols).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("occurrences"))
    by_window = Window.partitionBy("window")
    ranked = lists.join(counts, "term").withColumns({"known": F.count("*").over(by_window), "rarity": F.row_number().over(by_window.orderBy("occurrences", "place"))})
    return ranked.where(f"known = n and rarity <= {most}").select("window", "n", "place", "term", "rarity")


def candidates(docs: DataFrame, windows: DataFrame, **cols) -> DataFrame:
    """(doc, copy, start, window, n): places where the shifted lists of a window's two rarest terms meet.

    Which rarities met is tested, not how many rows, so repeated rows count once.
    """
    anchors = materialize(rarest_terms(docs, windows, **cols), "anchors")
    shifted = postings(docs, **cols).join(anchors, "term").where("position >= place").select("doc", "copy", (F.col("position") - F.col("place")).alias("start"), "window", "n", "rarity")
    met = shifted.groupBy("doc", "copy", "start", "window", "n").agg(F.min("rarity").alias("least"), F.max("rarity").alias("most"))
    return met.where("least = 1 and most = least(n, 2)").drop("least", "most")


def find_phrases(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, n_words, n_hit, windows array<long>, spans array<start,end>) of every row.

    ``n_hit`` counts the words that lie in an occurrence of any window; ``windows`` are the contents found,
    ``spans`` the maximal hit runs of words.
    """
    small_batches(docs.sparkSession)
    cols = {"id_col": id_col, "text_col": text_col}
    windows = materialize(phrase_windows(items, n, item_col, item_text), "windows")
    found = candidates(docs, windows, **cols)
    hits = found.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "n", "window")).alias("hits"))
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("doc"), _copy(id_col, text_col), F.col(text_col).alias("text"))
    joined = rows.join(hits, rows["doc"].eqNullSafe(hits["doc"]) & rows["copy"].eqNullSafe(hits["copy"]), "left").select(rows["doc"], "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for lo, hi, data, at in texts(batch, "text"):
                _, _, terms, counts = W.words(data, at)
                prefix, first = W.prefix_hash(terms), np.cumsum(counts) - counts
                part = lists.slice(lo, hi - lo)
                many = np.diff(part.offsets.to_numpy()) if len(part) else np.zeros(0, np.int64)
                hit = part.flatten()
                own = np.repeat(np.arange(hi - lo), many)
                start, length, window = (hit.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                ok = start + length <= counts[own]
                own, start, length, window = own[ok], start[ok] + first[own[ok]], length[ok], window[ok]
                ok = W.stretch_hash(prefix, start, start + length).view(np.int64) == window
                own, start, length, window = own[ok], start[ok], length[ok], window[ok]
                step = np.zeros(len(terms) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + length, -1)
                covered = np.cumsum(step[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(covered)])
                n_hit = total[first + counts] - total[first]
                pairs = np.unique(np.stack([own, window]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
                runs = np.zeros(len(terms) + 1, bool)
                runs[first] = True
                edge = covered & (runs[:-1] | ~np.concatenate([[False], covered[:-1]]))[: len(covered)]
                last = covered & (runs[1:] | ~np.concatenate([covered[1:], [False]]))[: len(covered)]
                begins, ends = np.flatnonzero(edge), np.flatnonzero(last) + 1
                of = np.searchsorted(first + counts, begins, "right")
                spans = pa.StructArray.from_arrays([pa.array((begins - first[of]).astype(np.int32)), pa.array((ends - first[of]).astype(np.int32))], ["start", "end"])
                bound = lambda who: pa.array(np.searchsorted(who, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.ListArray.from_arrays(bound(pairs[0]), pa.array(pairs[1])), pa.ListArray.from_arrays(bound(of), spans)],
                    names=["doc", "n_words", "n_hit", "windows", "spans"],
                )

    return joined.mapInArrow(run, f"doc {kind}, n_words long, n_hit long, windows array<long>, spans array<struct<start:int,end:int>>")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items array, spans) of every document: the test items whose windows occur in it."""
    found = find_phrases(docs, items, n, id_col, text_col, item_col, item_text)
    owned = phrase_windows(items, n, item_col, item_text).select("item", "window").distinct()
    first = owned.groupBy("window").agg(F.min("item").alias("first"))
    owners = materialize(owned.join(first, "window").select("item", "window", F.col("item").eqNullSafe(F.col("first")).alias("marked")), "owners")
    rows = found.withColumn("window", F.explode_outer("windows")).join(owners, "window", "left")
    # Rows are told apart by what was found, so a task that runs again changes nothing; equal rows come back as often as they were.
    # Of a window's items one is marked, so that the marked rows of a group are its windows times its copies.
    out = rows.groupBy("doc", "n_words", "n_hit", "windows", "spans").agg(F.collect_set("item").alias("items"), F.count_if(F.coalesce("marked", F.lit(True))).alias("n"))
    copies = F.sequence(F.lit(1), (F.col("n") / F.greatest(F.size("windows"), F.lit(1))).cast("int"))
    return out.select(F.col("doc").alias(id_col), "n_words", "n_hit", "items", "spans", F.explode(copies).alias("_copy")).drop("_copy")


def proximity_matches(docs: DataFrame, items: DataFrame, n: int = WINDOW, slop: int = 20, **cols) -> DataFrame:
    """(doc, window, start, distance): places where a window's two rarest terms lie within ``slop`` words, in any order.

    The nearest partner of each occurrence of the rarest term is given; ``distance`` is how far it lies from
    where an exact phrase would have it. Places are put into blocks of ``slop`` words, so that only
    neighbouring blocks meet.
    """
    anchors = materialize(rarest_terms(docs, materialize(phrase_windows(items, n), "windows"), **cols), "anchors").where("n > 1")
    lists = postings(docs, **cols).join(anchors, "term").select("doc", "position", "place", "window", "rarity")
    near = lists.where("rarity = 1").select("doc", "window", F.col("position").alias("at"), F.col("place").alias("own"), F.explode(F.array(*(F.floor(F.col("position") / slop) + k for k in (-1, 0, 1)))).alias("block"))
    other = lists.where("rarity = 2").withColumn("block", F.floor(F.col("position") / slop))
    gap = F.abs((F.col("position") - F.col("place")) - (F.col("at") - F.col("own")))
    met = near.join(other, ["doc", "window", "block"]).where(F.abs(F.col("position") - F.col("at")) <= slop)
    return met.groupBy("doc", "window", (F.col("at") - F.col("own")).alias("start")).agg(F.min(gap).alias("distance"))
