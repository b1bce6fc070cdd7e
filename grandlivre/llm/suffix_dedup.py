"""Exact substring deduplication by suffix sorting (deep-shallow) around anchors.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (in a document with a
smaller id, or earlier in the same one); strings are judged on the input. Texts are UTF-8 bytes.

1. Every window of ``length`` bytes has an *anchor*: the start of its least 24-byte gram by hash, the
   leftmost if equal. Equal windows have equal anchors at equal distances, and about one position in 39 is
   an anchor, so only these travel: (gram, document, position). Grams that occur once are dropped after a
   count that is combined before the shuffle and written; the join with it that keeps the others has plain
   shuffles on both sides, so Spark splits the tasks of frequent grams.
2. For the others, the bytes around the anchor that its windows can reach are cut out and dealt by gram. A
   document whose whole text is that of an earlier one sends nothing: all its windows start earlier. Equal
   surroundings in one task collapse to their first.
3. In a task the strings to the right of the anchors, and those to the left read backwards, are each
   suffix-sorted: multikey quicksort on 8-byte characters to a shallow depth, then blind tries for groups
   with longer common prefixes. Neighbours' common prefixes give, for each distance, the classes of equal
   windows; all but the first of a class are removed.
4. A gram that occurs ``HOT`` times or more is not sorted in one task. Its windows (an anchor serves three or
   four on average) travel one by one under a 128-bit digest, only the first of each in a task: a passage in a
   third of all documents gives one row a task, its edges in other surroundings go to as many tasks as there
   are different windows. Read in order of place, all but the first of a digest are removed.
5. The removed ranges of a document are merged and cut from its whole text.

Memory: no array is larger than a block of ``BLOCK`` window starts, whatever the length of a text; a task of
step 3 holds ``ROWS`` rows and one gram's, fewer than ``HOT``; one of step 4 a batch.

Null texts are empty. Documents shorter than ``length`` lose nothing. Ids are integers and tell which is
earlier; repeated rows of one id and text are one document and each get its result; rows of an id that
stands for different texts lose nothing, and nothing is removed for their sake. A row without an id
is no earlier and no later than any other: it keeps all its bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, small_batches, texts

LENGTH, GRAM = 100, 24
#: Levels of 8 bytes that multikey quicksort takes before blind tries follow.
SHALLOW = 6
#: Occurrences from which a gram's windows travel one by one, and how many of them a task remembers.
HOT, REMEMBERED = 5000, 50_000
#: Rows that are sorted at once.
ROWS = 50_000
#: Window starts whose anchors are worked out at once.
BLOCK = 1 << 16


def _block_anchors(data: np.ndarray, at: np.ndarray, length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows that start at ``lo`` to ``hi`` - 1; their first and last start may go on beyond that range."""
    width = length - GRAM + 1
    part = data[lo : hi + length - 1]
    prefix = W.prefix_hash(W.BYTE[part])
    place = np.arange(len(part) - GRAM + 1)
    grams = W.stretch_hash(prefix, place, place + GRAM)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)
    # least key of every ``width`` neighbours: running minima from both ends of blocks of that size
    padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    windows = hi - lo
    least = (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a window lies in one text if no text but its own starts before it ends
    start = np.arange(lo, hi)
    valid = np.flatnonzero(np.searchsorted(at, start + length - 1, "right") == np.searchsorted(at, start, "right"))
    own = least[valid]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(valid) != 1)])[: len(own)])
    last = np.append(new[1:], len(valid))[: len(new)] - 1
    return own[new] + lo, grams[own[new]].view(np.int64), valid[new] + lo, valid[last] + lo


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and gram of each anchor, and the first and last window start that it serves.

    Worked out block by block, so that memory beyond the result does not grow with a text.
    """
    parts = [_block_anchors(data, at, length, lo, min(lo + BLOCK, len(data) - length + 1)) for lo in range(0, len(data) - length + 1, BLOCK)]
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    place, gram, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.ones(len(place), bool)  # an anchor that serves windows of two blocks is one
    new[1:] = (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)
    start = np.flatnonzero(new)
    return place[start], gram[start], first[start], last[np.append(start[1:], len(place)) - 1] if len(start) else last


class BlindTrie:
    """Strings in a tree that holds only branching places; a search compares one whole string, once."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | list = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _byte(self, i: int, place: int) -> int:
        s = self.strings[i]
        return s[place] if place < len(s) else -1

    def _insert(self, i: int) -> None:
        node = self.root
        while not isinstance(node, int):  # blind: only branching bytes are looked at
            node = node[1].get(self._byte(i, node[0]), next(iter(node[1].values())))
        a, b = self.strings[i], self.strings[node]
        lo, hi = 0, min(len(a), len(b))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
        parent, edge, here = None, 0, self.root
        while not isinstance(here, int) and here[0] < lo:
            parent, edge, here = here, self._byte(i, here[0]), here[1][self._byte(i, here[0])]
        if not isinstance(here, int) and here[0] == lo:
            here[1][self._byte(i, lo)] = i
            return
        split = [lo, {self._byte(node, lo): here, self._byte(i, lo): i}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def order(self) -> list[int]:
        """Strings in order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(keys: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows within their groups by their first ``depth`` characters, and the class of each place: rows equal so far.

    Every round splits all segments that are not yet settled in three by their pivots, at once; the middle part goes on
    with the next character.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    cls = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]])[:n])
    level = np.zeros(n, np.int64)  # of each place
    while True:
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])[:n])
        size = np.diff(np.append(first, n))
        open_ = np.flatnonzero((size > 1) & (level[first] < depth))
        if not len(open_):
            return order, cls
        lo, many = first[open_], size[open_]
        own = np.repeat(np.arange(len(lo)), many)
        places = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(own))
        key = keys[order[places], level[places]]
        head = np.cumsum(many) - many
        tries = np.sort(np.stack([key[head], key[head + many // 2], key[head + many - 1]]), 0)
        part = (key > tries[1][own]).astype(np.int8) + (key >= tries[1][own])  # 0 below, 1 equal, 2 above
        by = np.argsort(own * 3 + part, kind="stable")
        order[places], part = order[places][by], part[by]
        level[places] += part == 1
        new = np.concatenate([[True], cls[1:] != cls[:-1]])
        new[places[1:]] |= (part[1:] != part[:-1]) & (own[1:] == own[:-1])
        cls = np.cumsum(new) - 1


def deep_shallow(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded byte rows within their groups, and each one's common prefix with the one before.

    The first of a group has -1. Shorter strings come before those that they begin.
    """
    n, wide = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = rows.view(">u8").astype(np.uint64)
    order, cls = multikey_quicksort(keys, group, min(SHALLOW, keys.shape[1]))
    deep = np.flatnonzero(np.concatenate([[False], cls[1:] == cls[:-1]]) | np.concatenate([cls[1:] == cls[:-1], [False]]))
    if len(deep):
        cuts = np.flatnonzero(np.concatenate([[True], cls[deep][1:] != cls[deep][:-1], [True]]))
        raw = rows.tobytes()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            places = deep[lo:hi]
            same: dict[bytes, list[int]] = {}
            for i in order[places]:
                same.setdefault(raw[i * wide : i * wide + sizes[i]], []).append(i)
            if len(same) > 1:
                strings = list(same)
                order[places] = [i for k in BlindTrie(strings).order() for i in same[strings[k]]]
    common = np.full(n, -1)
    for lo in range(1, n, 1 << 14):
        hi = min(n, lo + (1 << 14))
        a, b = order[lo:hi], order[lo - 1 : hi - 1]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(1), differ.argmax(1), wide)
        common[lo:hi] = np.where(group[a] == group[b], np.minimum(first, np.minimum(sizes[a], sizes[b])), -1)
    return order, common


def repeated(group: np.ndarray, rank: np.ndarray, least: np.ndarray, most: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first distance, last distance) of the windows that also start earlier.

    ``rank`` orders rows by place in the corpus; a row's windows start ``least`` to ``most`` bytes before its
    anchor; ``left`` is read backwards from the anchor.
    """
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        wide = -(-max(map(len, strings)) // 8) * 8 or 8
        flat = b"".join(s.ljust(wide, b"\0") for s in strings)
        return np.frombuffer(flat, np.uint8).reshape(n, wide), np.fromiter(map(len, strings), np.int64, n)

    by_right, same_right = deep_shallow(*matrix(right), group)
    by_left, same_left = deep_shallow(*matrix(left), group)
    place = np.argsort(rank, kind="stable")
    gone = np.zeros((n, length - GRAM + 1), bool)
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(least.min()), int(most.max()) + 1):
        here = place[(least[place] <= d) & (d <= most[place])]
        if len(here) < 2:
            continue
        r[by_right] = np.cumsum(same_right < length - d)
        l[by_left] = np.cumsum(same_left < d)
        first = np.unique(r[here] * (n + 1) + l[here], return_index=True)[1]
        again = np.ones(len(here), bool)
        again[first] = False
        gone[here[again], d] = True
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1] - 1


def several_texts(docs: DataFrame) -> DataFrame:
    """(doc): ids whose rows hold different texts, so that nothing tells which of them is meant."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.groupBy("doc").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo != hi").select("doc")


def earlier_copies(docs: DataFrame, several: DataFrame) -> DataFrame:
    """(doc): documents whose whole text is that of a document with a smaller id; those of ``several`` take no part."""
    marked = docs.select("doc", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same")).join(several, "doc", "left_anti")
    # written, so that the join has plain shuffles on both sides and Spark splits the tasks of a frequent text
    first = materialize(marked.groupBy("same").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"), "first")
    return marked.join(first, "same").where("doc > first").select("doc").distinct()


def removed_ranges(docs: DataFrame, without: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc long, start int, end int): byte ranges of ``docs`` (doc, text, more) that windows found earlier cover; they may overlap.

    The ids of ``without`` are left out: copies, all of whose windows start earlier, and ids of several texts. Further columns of ``docs`` only travel along where
    texts are joined, so that a caller's own join of the same table by ``doc`` can reuse that shuffle.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                place, gram, _, _ = anchors(data, at, length)
                own = np.searchsorted(at, place, "right") - 1
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(gram), ids, pa.array((place - at[own]).astype(np.int32))], names=["gram", "doc", "place"])

    found = docs.select("doc", "text").mapInArrow(find, "gram long, doc long, place int")
    counts = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    wanted = found.join(counts, "gram").groupBy("doc").agg(F.collect_list(F.struct("place", (F.col("n") >= HOT).alias("hot"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                raw = data.tobytes()
                place, gram, first, last = anchors(data, at, length)
                lists = batch.column("wanted").slice(lo, hi - lo)
                items = lists.flatten()
                start = items.field(0).to_numpy().astype(np.int64) + np.repeat(at[:-1], np.diff(lists.offsets.to_numpy()))
                own = np.searchsorted(at, start, "right") - 1
                ids, starts = np.asarray(batch.column(0).slice(lo, hi - lo))[own], start - at[own]
                hot = items.field(1).to_numpy(zero_copy_only=False)
                order = np.lexsort((starts, ids))
                index = np.searchsorted(place, start)
                kept: dict[tuple, tuple[int, int]] = {}
                out = []
                for a, doc, s, k, many in zip(*(x[order].tolist() for x in (start, ids, starts, index, hot)), strict=True):
                    g, near, far = int(gram[k]), a - int(last[k]), a - int(first[k])
                    if not many:
                        around = raw[a - far : a + length - near]
                        if kept.setdefault((g, near, far, around), (doc, s)) != (doc, s):
                            out.append((doc, 0, doc, s - far, s - near + length, 0, None))  # the same surroundings lie earlier
                        else:
                            out.append((g, 0, doc, s - far, s - near + length, far, around))
                        continue
                    for d in range(far, near - 1, -1):
                        digest = hashlib.blake2b(raw[a - d : a - d + length], digest_size=16).digest()
                        if len(windows) >= REMEMBERED and digest not in windows:
                            windows.clear()
                        before = windows.setdefault(digest, (doc, s - d))
                        if before < (doc, s - d):
                            out.append((doc, 0, doc, s - d, s - d + length, 0, None))
                        else:
                            windows[digest] = (doc, s - d)
                            out.append((*np.frombuffer(digest, np.int64).tolist(), doc, s - d, s - d + length, -1, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["route", "digest", "doc", "start", "end", "anchor", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    some = wanted.join(without, "doc", "left_anti")
    around = docs.join(some, "doc").mapInArrow(cut, "route long, digest long, doc long, start int, end int, anchor int, bytes binary")

    def settle(table: pa.Table) -> pa.RecordBatch:
        route, doc, start, end, anchor = (table.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3, 4, 5))
        same = [x[1:] == x[:-1] for x in (route, doc, start, end, anchor)]  # rows come in this order
        row = np.flatnonzero(np.concatenate([[True], ~np.logical_and.reduce(same)])[: len(route)])  # a repeated row is one occurrence
        bodies = table.column("bytes").take(pa.array(row)).to_pylist()
        group = np.unique(route[row], return_inverse=True)[1]
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((start[row] + anchor[row], doc[row]))] = np.arange(len(row))
        most, place = anchor[row], start[row] + anchor[row]
        least = length - (end[row] - place)
        left, right = [x[:m][::-1] for x, m in zip(bodies, most, strict=True)], [x[m:] for x, m in zip(bodies, most, strict=True)]
        which, near, far = repeated(group, rank, least, most, left, right, length)
        return ranges(doc[row][which], place[which] - far, place[which] - near + length)

    def ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc", "start", "end"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, before = 0, None  # before: route, digest, document and start of the first window of the digest read last
        for batch in batches:  # sorted by route, digest and place
            anchor, bare = batch.column("anchor").to_numpy(), batch.column("bytes").is_null().to_numpy(zero_copy_only=False)
            route, digest, doc, start, end = (batch.column(k).to_numpy() for k in range(5))
            passed = bare & (anchor >= 0)
            yield ranges(doc[passed], start[passed], end[passed])
            one = np.flatnonzero(bare & (anchor < 0))
            if len(one):
                new = np.ones(len(one), bool)
                new[1:] = (route[one][1:] != route[one][:-1]) | (digest[one][1:] != digest[one][:-1])
                head = one[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first of each one's digest
                first = np.stack([doc[head], start[head].astype(np.int64)], 1)
                if before and before[:2] == (route[one[0]], digest[one[0]]):
                    first[np.cumsum(new) == 1] = before[2:]
                before = (route[one[-1]], digest[one[-1]], *first[-1].tolist())
                later = one[(doc[one] != first[:, 0]) | (start[one] != first[:, 1])]
                yield ranges(doc[later], start[later], end[later])
            batch = batch.filter(pa.array(~bare))
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS and held[0].column(0)[0].as_py() != held[-1].column(0)[-1].as_py():  # whole groups
                table = pa.Table.from_batches(held)
                route = table.column("route").to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                yield settle(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
        if held:
            yield settle(pa.Table.from_batches(held))

    dealt = around.repartition("route").sortWithinPartitions("route", "digest", "doc", "start", "end", "anchor")
    return dealt.mapInArrow(sort, "doc long, start int, end int")


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of bytes by document, touching ones joined, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    wide = int(end.max()) + 2  # ranges of different documents never touch
    reach = np.maximum.accumulate(doc * wide + end)
    new = np.flatnonzero(np.concatenate([[True], doc[1:] * wide + start[1:] > reach[:-1]]))
    return doc[new], start[new], reach[np.append(new[1:], len(doc)) - 1] - doc[new] * wide


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, spans array<start,end>, kept binary, carry) of every document.

    A document without an id stands before and after no other, so it loses nothing and takes nothing from others.

    ``spans`` are the maximal removed runs; ``kept`` the other bytes end to end. Columns named in ``carry`` come
    out beside them, which spares a join with ``docs``.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry))).where("doc is not null")
    several = materialize(several_texts(base), "several")
    copies = materialize(earlier_copies(base, several), "copies")
    ranges = removed_ranges(base, copies.union(several), length).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    whole = copies.select("doc", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"))).alias("ranges"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in texts(batch, "text"):
                lists = batch.column("ranges").slice(lo, hi - lo)
                many = np.diff(lists.offsets.to_numpy())
                items, own, size = lists.flatten(), np.repeat(np.arange(hi - lo), many), np.diff(at)
                start, end = (items.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                end = np.where(end < 0, np.where(size[own] >= length, size[own], 0), end)  # -1: a copy goes whole, if it has a window
                own, start, end = merged(own[end > start], start[end > start], end[end > start])
                spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
                edge = np.searchsorted(own, np.arange(hi - lo + 1))
                gone = np.bincount(own, end - start, hi - lo).astype(np.int64)
                kept = []
                for d in range(hi - lo):
                    raw, cuts = data[at[d] : at[d + 1]], slice(edge[d], edge[d + 1])
                    kept.append(b"".join(raw[x:y].tobytes() for x, y in zip([0, *end[cuts]], [*start[cuts], len(raw)], strict=True)))
                edges = pa.array(edge.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(gone), pa.ListArray.from_arrays(edges, spans), pa.array(kept, pa.binary())]
                    + [batch.column(f"_carry_{i}").slice(lo, hi - lo) for i in range(len(carry))],
                    names=[id_col, "n_bytes", "n_removed", "spans", "kept", *carry],
                )

    kinds = dict(docs.dtypes)
    out = f"`{id_col}` long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    nameless = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias(id_col), F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), raw.alias("kept"), *carry
    )
    return base.join(ranges.union(whole), "doc", "left").mapInArrow(apply, out).union(nameless)
