"""Alignment of two tokenizers' ids over whole documents.

A text is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B). Each side has a dictionary
from the byte offset at which a token ends to the token's index; the intersection of the two key sets, sorted,
is where both sides end, and its offsets slice the two id lists into groups. Links are expanded slice by slice:
the tokens of a slice whose ends are equal, which is one link a slice, since tokens are never empty.

A text falls into *words*: a blank after another character and before one that is no white space begins one. Neither side has
a token across such a place (A's pre-tokens and B's pieces begin there; read from B's vocabulary), so both end there, groups
and links are those of the words, and a worker aligns a word once however often it occurs.

How often a pair of ids is linked in the whole corpus is counted by Spark. Texts are taken in *blocks* of some
megabytes; a block names its distinct pairs and words once, however many documents repeat them, a word lists the places of its
pairs, and a document those of its words. Pairs, not links, are counted, joined with their counts and sent back, so a pair
that every document holds is one row a block. A block is bounded by ``BLOCK_BYTES`` or by one text.

Null and empty texts, and texts whose joined bytes on either side differ from a space and the text, have no
tokens: counts are 0 and the digest is ''. Repeated rows each get a row and count each time; an id may be null;
other columns are not read, so their names cannot clash. An empty table gives no rows. A very long text is encoded
whole and is a block of its own.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_lists, materialize, small_batches

#: Bytes of text of a block, and pairs of a row in which a block names them.
BLOCK_BYTES, PAIRS = 8 << 20, 4096
#: How the byte-level vocabulary writes text: its pre-token pattern. A fixed value of that kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a word begins, what makes a text's words other than what lies between blanks, and the words that a worker keeps.
_WORD, _ODD, KEPT = re.compile(r"(?<! ) (?=\S)"), re.compile(r"  | \Z| [^\S ]"), 200_000
OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def printed_bytes() -> dict[str, int]:
    """The character by which byte-level vocabularies print each byte: itself if it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Words(dict):
    """Numbers of the words met so far. Lists by number hold what a word has."""

    def __init__(self):
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.pairs: list[list[int]] = []
        self.printed: list[bytes | None] = []

    def learn(self, words: list[str], own: Aligner) -> None:
        """Align those of ``words`` that are new."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        for word, *found in own.align(new) if new else ():
            self[word] = len(self.n_a)
            for column, value in zip((self.n_a, self.n_b, self.pairs, self.printed), found, strict=True):
                column.append(value)

    def start_over(self) -> None:
        """Forget all words."""
        self.clear()
        for column in (self.n_a, self.n_b, self.pairs, self.printed):
            column.clear()


class Aligner:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of, vocab = printed_bytes(), model["vocab"]
        self.bytes_a = {i: bytes(map(of.__getitem__, t)) for t, i in vocab.items() if all(c in of for c in t)}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of a byte-level vocabulary must follow the order of its merges")
        known = {i for i in self.bytes_a if len(self.bytes_a[i]) == 1} | set(merged)
        self.bytes_a = {i: b for i, b in self.bytes_a.items() if i in known}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.size_a, self.size_b = {i: len(t) for i, t in self.bytes_a.items()}, list(map(len, self.bytes_b))
        #: No piece of B goes on after a blank that follows other characters, so its merges never cross the beginning of a word.
        self.apart = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in range(n))
        self.words = Words()
        self.table_a, self.table_b = np.zeros(max(self.size_a) + 1, np.int64), np.array(self.size_b)
        self.table_a[list(self.size_a)] = list(self.size_a.values())
        printed = [str(i).encode() for i in range(max(n, max(self.bytes_a) + 1))]
        self.wide = np.array(list(map(len, printed)))
        self.digits = np.array(printed, f"S{self.wide.max() + 1}").view(np.uint8).reshape(len(printed), -1)

    def split(self, text: str) -> list[str]:
        """The words of a text, without the blank that begins each; the text itself where they may not stand alone."""
        if not self.apart or "▁" in text:
            return [text]
        spaced = " " + text
        if not _ODD.search(spaced):
            return text.split(" ")
        cuts = [0, *(m.start() for m in _WORD.finditer(spaced)), len(spaced)]
        return [spaced[i + 1 : j] for i, j in zip(cuts, cuts[1:], strict=False) if i < j]

    def align(self, words: list[str]) -> Iterator[tuple[str, int, int, list[int], bytes | None]]:
        """Of each word or text the numbers of A's and B's ids, (B id << 32 | A id) of each link and the printed groups, None if the bytes differ.

        The words are laid end to end, so offsets and dictionaries are those of one text in which both sides end with each word.
        """
        lists_a, lists_b = [self.a.encode_ordinary(" " + w) for w in words], self.b.encode(words, num_threads=1)
        raws = [(" " + w).encode() for w in words]
        bytes_b = lambda ids: b"".join(map(self.bytes_b.__getitem__, ids))
        if bytes_b(chain.from_iterable(lists_b)) != b"".join(raws) or any(sum(map(self.size_b.__getitem__, ids)) != len(raw) for ids, raw in zip(lists_b, raws, strict=True)):
            same = [bytes_b(ids) == raw for ids, raw in zip(lists_b, raws, strict=True)]
            yield from ((w, 0, 0, [], None) for w, ok in zip(words, same, strict=True) if not ok)
            if any(same):
                yield from self.align([w for w, ok in zip(words, same, strict=True) if ok])
            return
        n_a, n_b = np.array(list(map(len, lists_a))), np.array(list(map(len, lists_b)))
        a, b = (np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())) for lists, n in ((lists_a, n_a), (lists_b, n_b)))
        ends_a = dict(zip(np.cumsum(self.table_a[a]).tolist(), range(len(a)), strict=True))
        ends_b = dict(zip(np.cumsum(self.table_b[b]).tolist(), range(len(b)), strict=True))
        common = sorted(ends_a.keys() & ends_b.keys())
        at_a, at_b = (np.fromiter(map(of.__getitem__, common), np.int64, len(common)) for of in (ends_a, ends_b))
        links, (printed, ends) = (b[at_b] << 32 | a[at_a]).tolist(), self.printed(a, b, at_a, at_b)
        stop = np.searchsorted(at_a, np.cumsum(n_a))  # the groups before each word's end
        i = lo = 0
        for word, x, y, j, hi in zip(words, n_a.tolist(), n_b.tolist(), stop.tolist(), ends[stop - 1].tolist(), strict=True):
            yield word, x, y, links[i:j], printed[lo : hi - 1]
            i, lo = j, hi

    def printed(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups as ``a1,a2|b1;a3|b2,b3;`` and where each ends: ids in order of output, each with its digits and the mark that follows."""
        ids = np.empty(len(a) + len(b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        ids[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = a
        ids[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = b
        last = np.cumsum(size_a + size_b) - 1
        mark[last - size_b], mark[last] = ord("|"), ord(";")
        out, wide = self.digits[ids], self.wide[ids]
        out[np.arange(len(ids)), wide] = mark
        return out[np.arange(out.shape[1]) <= wide[:, None]].tobytes(), np.cumsum(wide + 1)[last]


@functools.lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's tokenizers."""
    gc.set_threshold(200_000)  # many small lists and no cycles
    return Aligner(path_a, path_b)


FIELDS = ["block", "id", "n_a", "n_b", "n_groups", "groups_sha256", "words", "word_links", "first", "pair_b", "pair_a", "pair_n"]


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Block by block, rows of documents (``words``: places of the text's words), of words (``word_links``: places of each one's
    pairs, in the order of the words) and of pairs (``first``: the place of the first)."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"block string, id {kind}, n_a int, n_b int, n_groups int, groups_sha256 string, words array<int>, word_links array<array<int>>, first int, pair_b array<int>, pair_a array<int>, pair_n array<long>"
    many = pa.list_(pa.int32())
    kinds = [pa.string(), None, pa.int32(), pa.int32(), pa.int32(), pa.string(), many, pa.list_(many), pa.int32(), many, many, pa.list_(pa.int64())]

    def record(block: str, id_kind: pa.DataType, n: int, **given: pa.Array) -> pa.RecordBatch:
        given["block"] = pa.array([block] * n)
        return pa.RecordBatch.from_arrays([given.get(f, pa.nulls(n, k or id_kind)) for f, k in zip(FIELDS, kinds, strict=True)], names=FIELDS)

    def rows(own: Aligner, ids: pa.Array, found: list[tuple], words: list[list[int]]) -> Iterator[pa.RecordBatch]:
        block, store = uuid.uuid4().hex, own.words
        sizes = np.array(list(map(len, words)), np.int64)
        used, word, times = np.unique(np.fromiter(chain.from_iterable(words), np.int64, int(sizes.sum())), return_inverse=True, return_counts=True)
        links = [store.pairs[k] for k in used.tolist()]
        held = np.array(list(map(len, links)), np.int64)
        code, place = np.unique(np.fromiter(chain.from_iterable(links), np.int64, int(held.sum())), return_inverse=True)
        count = np.zeros(len(code), np.int64)
        np.add.at(count, place, np.repeat(times, held))
        stop = np.concatenate([[0], np.cumsum(sizes)])
        for lo in range(0, len(found), 256):
            hi = min(len(found), lo + 256)
            cols = {f: pa.array([x[k] for x in found[lo:hi]], t) for k, (f, t) in enumerate((("n_a", pa.int32()), ("n_b", pa.int32()), ("n_groups", pa.int32()), ("groups_sha256", pa.string())))}
            yield record(block, ids.type, hi - lo, id=ids.slice(lo, hi - lo), words=int_lists(word[stop[lo] : stop[hi]], sizes[lo:hi], pa.int32()), **cols)
        if len(used):
            yield record(block, ids.type, 1, word_links=pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), int_lists(place, held, pa.int32())))
        for lo in range(0, len(code), PAIRS):
            part = slice(lo, lo + PAIRS)
            yield record(block, ids.type, 1, first=pa.array([lo], pa.int32()), pair_b=pa.array([code[part] >> 32], many), pair_a=pa.array([code[part] & 0xFFFFFFFF], many), pair_n=pa.array([count[part]], pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        store = own.words
        ids, found, words, held = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids.append(part.column(0))
                done, texts = 0, [x or "" for x in part.column(1).to_pylist()]
                parted = [own.split(x) if x else [] for x in texts]
                store.learn(list(chain.from_iterable(parted)), own)
                for k, (text, own_words) in enumerate(zip(texts, parted, strict=True)):
                    mine = list(map(store.__getitem__, own_words))
                    printed = list(map(store.printed.__getitem__, mine))
                    if not mine or None in printed:
                        found.append((0, 0, 0, ""))
                        words.append([])
                    else:
                        links = sum(map(len, map(store.pairs.__getitem__, mine)))
                        found.append((sum(map(store.n_a.__getitem__, mine)), sum(map(store.n_b.__getitem__, mine)), links, hashlib.sha256(b";".join(printed)).hexdigest()))
                        words.append(mine)
                    held += len(text)
                    if held >= BLOCK_BYTES:
                        ids[-1] = part.column(0).slice(done, k + 1 - done)
                        yield from rows(own, pa.concat_arrays(ids), found, words)
                        ids, found, words, held, done = [part.column(0).slice(k + 1)], [], [], 0, k + 1
                if not found and len(store) > KEPT:
                    store.start_over()
        if found:
            yield from rows(own, pa.concat_arrays(ids), found, words)
        store.start_over()

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best`` are the links whose pair is linked as often in the corpus as any pair of its B id, ``count_sum``
    the sum over links of how often their pair is linked.
    """
    small_batches(docs.sparkSession)
    made = materialize(blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path_a, path_b), "aligned")
    zipped = F.arrays_zip("pair_b", "pair_a", "pair_n")
    pairs = made.where("first is not null").select("block", "first", F.posexplode(zipped).alias("k", "p"))
    pairs = pairs.select("block", (F.col("first") + F.col("k")).alias("place"), "p.*")
    counts = materialize(pairs.groupBy("pair_b", "pair_a").agg(F.sum("pair_n").alias("count")), "pair_counts")
    most = counts.groupBy("pair_b").agg(F.max("count").alias("most"))  # at most one row for each id of B
    judged = pairs.join(counts, ["pair_b", "pair_a"]).join(F.broadcast(most), "pair_b")
    judged = judged.select("block", "place", "count", (F.col("count") == F.col("most")).alias("best"))
    kind = docs.schema[id_col].dataType.simpleString()

    def total(rows: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        named = pc.is_valid(rows.column("word_links"))
        links = rows.filter(named).column("word_links").combine_chunks().flatten()
        rows = rows.filter(pc.invert(named))
        words = rows.column("words").combine_chunks()
        sums = lambda lists, of: np.diff(np.concatenate([[0], np.cumsum(of[lists.flatten().to_numpy(zero_copy_only=False)])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        runs = lambda of: sums(words, sums(links, of) if len(links) else np.zeros(0, np.int64))
        whole = [rows.column(c).cast(pa.int64()) for c in ("n_a", "n_b", "n_groups")]
        cols = [rows.column("id"), *whole, whole[2], pa.array(runs(best)), pa.array(runs(count)), rows.column("groups_sha256")]
        return pa.table(cols, names=["id", *(x.split()[0] for x in OUT.split(", "))])

    mine = made.where("first is null").select(F.col("block").alias("unit"), "id", "n_a", "n_b", "n_groups", "groups_sha256", "words", "word_links")
    out = mine.groupBy("unit").cogroup(judged.groupBy("block")).applyInArrow(total, f"id {kind}, {OUT}")
    return out.withColumnRenamed("id", id_col)
