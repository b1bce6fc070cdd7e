"""Prefix trie of rebuilt conversations, by adaptive radix trees.

A *turn id* is ``WIDTH`` bytes: the length of the turn's text in UTF-8, big-endian, and the first 16 bytes of the SHA-256
of its role and text, so equal ids are equal turns but for a chance of about n**2 / 2**129 among n turns. A conversation is the
bytes of its turns' ids in order. Such keys are dealt by range of (key, conversation), so copies of one conversation,
however many, spread over tasks, and each task reads sorted keys, a block at a time, into an adaptive radix tree:
paths of single children are compressed, and a node's layout grows from 4 to 16, 48 and 256 children. Walking the
tree, byte depths that are multiples of ``WIDTH`` emit nodes, inside compressed paths too; other depths emit none.

A node's numbers are sums over the keys below it, so parts from several blocks add up. Only prefixes of a block's
first and last key can lie in two blocks; they are marked ``edge``, added by node, and corrected for what both sides of
a *seam* (last key of one block, first of the next) counted: the shared nodes' text, children and leaves.
Conversation ids that end at a node are joined in the task that holds them all; ids of a key that may go on in the
next task, and of one with more than ``CHUNK`` ids, leave as chunks that a later stage digests in order, one by one. A
SHA-256 is made from front to back, so that stage takes one task a key; it holds one chunk.

Rebuilding (:func:`rebuild`): turns are ordered by number (null first), then id; a null role or text is empty. Repeated
rows are turns each. Rows without a conv_id take no part. ``c - c % 5`` rounds down for negative ids too. Columns other
than the four are not read, so their names cannot clash. An empty table gives no nodes, not even a root. A conversation's
ids (20 bytes a turn) are held whole by a task; texts are digested where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

WIDTH = 20
#: Keys and key bytes of a tree, and conversation ids of a chunk.
BLOCK_KEYS, BLOCK_BYTES, CHUNK = 20_000, 8 << 20, 8192
#: The digest of no ids.
NOTHING = hashlib.sha256(b"").hexdigest()


class Sorted:
    """Up to ``room`` children in the order of their bytes; 4 or 16."""

    __slots__ = ("kids", "marks", "room")

    def __init__(self, room: int = 4):
        self.room, self.marks, self.kids = room, bytearray(), []

    def get(self, mark: int) -> Node | None:
        at = self.marks.find(mark) if self.room == 4 else bisect_left(self.marks, mark)
        return self.kids[at] if 0 <= at < len(self.marks) and self.marks[at] == mark else None

    def put(self, mark: int, kid: Node) -> Sorted | Indexed:
        at = bisect_left(self.marks, mark)
        if at < len(self.marks) and self.marks[at] == mark:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.room:
            return (Sorted(16) if self.room == 4 else Indexed()).take(self).put(mark, kid)
        self.marks.insert(at, mark)
        self.kids.insert(at, kid)
        return self

    def take(self, other: Sorted) -> Sorted:
        self.marks, self.kids = other.marks, other.kids
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.marks, self.kids, strict=True)


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, mark: int) -> Node | None:
        at = self.index[mark]
        return self.kids[at - 1] if at else None

    def put(self, mark: int, kid: Node) -> Indexed | Direct:
        at = self.index[mark]
        if at:
            self.kids[at - 1] = kid
        elif len(self.kids) == 48:
            return Direct().take(self).put(mark, kid)
        else:
            self.kids.append(kid)
            self.index[mark] = len(self.kids)
        return self

    def take(self, other: Sorted) -> Indexed:
        for mark, kid in other.items():
            self.put(mark, kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((mark, self.kids[at - 1]) for mark, at in enumerate(self.index) if at)


class Direct:
    """A place for each of 256 children."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, mark: int) -> Node | None:
        return self.kids[mark]

    def put(self, mark: int, kid: Node) -> Direct:
        self.kids[mark] = kid
        return self

    def take(self, other: Indexed) -> Direct:
        for mark, kid in other.items():
            self.kids[mark] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((mark, kid) for mark, kid in enumerate(self.kids) if kid is not None)


class Node:
    """The bytes that lead on without a branch, the value of the key that ends there, and the children."""

    __slots__ = ("below", "path", "value")

    def __init__(self, path: bytes, value: tuple | None = None):
        self.path, self.value, self.below = path, value, None

    def put(self, mark: int, kid: Node) -> None:
        self.below = (self.below or Sorted()).put(mark, kid)


def shared(a: bytes, b: bytes) -> int:
    """Number of leading bytes in which ``a`` and ``b`` agree."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class Tree:
    """An adaptive radix tree of byte strings, which may be prefixes of each other."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value: tuple) -> None:
        """Put ``value`` at ``key``, in place of one that is there."""
        if self.root is None:
            self.root = Node(key, value)
            return
        node, over, mark, at = self.root, None, 0, 0
        while True:
            path = node.path
            same = len(path) if key.startswith(path, at) else shared(path, key[at : at + len(path)])
            if same < len(path):  # the path splits
                upper = Node(path[:same])
                node.path = path[same + 1 :]
                upper.put(path[same], node)
                if over is None:
                    self.root = upper
                else:
                    over.below = over.below.put(mark, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            kid = node.below.get(key[at]) if node.below else None
            if kid is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            node, over, mark, at = kid, node, key[at], at + 1


class Prefix:
    """A node of the trie: a prefix of whole turns."""

    __slots__ = ("children", "depth", "distinct", "edge", "ends", "first", "leaves", "n", "name", "own", "total", "up")

    def __init__(self, up: Prefix | None, turn: bytes):
        self.up, self.depth = up, up.depth + 1 if up else 0
        self.name = hashlib.sha256(up.name + turn).digest()[:16] if up else bytes(16)
        self.own = int.from_bytes(turn[:4], "big")
        self.first, self.ends, self.edge = None, None, False
        self.n = self.children = self.leaves = self.total = self.distinct = 0

    def close(self) -> None:
        """All below are closed: add the node's own share and pass the sums on."""
        self.total += self.n * self.own
        self.distinct += self.own
        self.leaves = self.leaves or 1
        up = self.up
        if up:
            up.n += self.n
            up.children += 1
            up.leaves += self.leaves
            up.total += self.total
            up.distinct += self.distinct
            up.first = self.first if up.first is None or self.first < up.first else up.first


def walk(tree: Tree) -> list[Prefix]:
    """The tree's nodes at turn-aligned depths, children first; prefixes of the first and last key are edges."""
    out: list[Prefix] = []
    top = now = Prefix(None, b"")
    outer: Prefix | None = None
    last = None
    todo: list[tuple] = [(tree.root, b"", top)] if tree.root else []
    while todo:
        node, rest, now = todo.pop()
        if node is None:  # ``now`` and the nodes up to but not including ``rest`` are complete
            while now is not rest:
                now.close()
                out.append(now)
                now = now.up
            continue
        begun, data = now, rest + node.path
        for k in range(0, len(data) - WIDTH + 1, WIDTH):
            now = Prefix(now, data[k : k + WIDTH])
        rest = data[len(data) - len(data) % WIDTH :]
        if node.value is not None:
            n, first, ends = node.value
            now.n, now.first, now.ends = now.n + n, first, ends
            outer, last = outer or now, now
        todo.append((None, begun, now))
        if node.below:
            todo.extend((kid, rest + bytes((mark,)), now) for mark, kid in reversed(list(node.below.items())))
    for edge in (outer, last):
        while edge:
            edge.edge, edge = True, edge.up
    if tree.root:
        top.own = 0
        top.close()
        out.append(top)
    return out


SUMS = ("n", "children", "leaves", "total", "distinct")
SCHEMA = "kind string, node binary, parent binary, depth int, edge boolean, first long, parent_first long, ends string, n long, children long, leaves long, total long, distinct long, low binary, high binary"
ARROW = pa.schema([("kind", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("edge", pa.bool_()), ("first", pa.int64()), ("parent_first", pa.int64()), ("ends", pa.string())]
                  + [(s, pa.int64()) for s in SUMS] + [("low", pa.binary()), ("high", pa.binary())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def _nodes(tree: Tree) -> Iterator[tuple]:
    for p in walk(tree):
        up = p.up
        known = up.first if up and not up.edge else None
        yield ("node", p.name, up.name if up else None, p.depth, p.edge, p.first, known, p.ends, p.n, p.children, p.leaves, p.total, p.distinct, None, None)


def seam(low: bytes, high: bytes) -> Iterator[tuple]:
    """What nodes above both ``low`` and the next key ``high`` must lose where each was counted in a tree of its own."""
    depth = shared(low, high) // WIDTH
    node, chain = Prefix(None, b""), []
    for k in range(depth + 1):
        chain.append(node)
        node = Prefix(node, low[k * WIDTH : (k + 1) * WIDTH]) if k < depth else node
    twice, ended = 0, len(low) == depth * WIDTH
    for p in reversed(chain):
        twice += p.own if p.depth else 0
        yield ("node", p.name, p.up.name if p.up else None, p.depth, True, None, None, None, 0, -(p.depth < depth), -ended, 0, -twice, None, None)


def _chunk(node: bytes, ids: list[int]) -> tuple:
    """Ids of conversations that end at a node, in order; ``first`` is the least."""
    return ("ids", node, None, None, None, ids[0], None, ",".join(map(str, ids)), *[None] * 5, None, None)


def _name(key: bytes) -> bytes:
    name = bytes(16)
    for k in range(0, len(key), WIDTH):
        name = hashlib.sha256(name + key[k : k + WIDTH]).digest()[:16]
    return name


def plant(batches: Iterator[pa.RecordBatch], block_keys: int = BLOCK_KEYS, block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Nodes, seams, chunks of ids and the bounds of a task's sorted (key, conversation) rows."""
    tree, keys, size, rows = Tree(), 0, 0, []
    bottom = before = key = None
    lowest = 0
    ids: list[int] = []
    n, first, cut = 0, 0, False

    def done(last: bool) -> Iterator[tuple]:
        """The key is complete here; its ids may go on in a neighbouring task if it is the first or the last."""
        nonlocal before, keys, size, tree
        ends = None
        if cut or last or before is None:
            if ids:
                yield _chunk(_name(key), ids)
        else:
            ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        if keys and (keys >= block_keys or size >= block_bytes):
            yield from _nodes(tree)
            yield from seam(before, key)
            tree, keys, size = Tree(), 0, 0
        tree.insert(key, (n, first, ends))
        keys, size, before = keys + 1, size + len(key) + 64, key

    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is None:
                    bottom, lowest = k, conv
                else:
                    rows.extend(done(False))
                key, ids, n, first, cut = k, [], 0, conv, False
            if len(ids) == chunk:
                rows.append(_chunk(_name(key), ids))
                ids, cut = [], True
            ids.append(conv)
            n += 1
        while len(rows) > 4096:
            yield _table(rows[:4096])
            del rows[:4096]
    if key is None:
        return
    rows.extend(done(True))
    rows.extend(_nodes(tree))
    rows.append(("bounds", None, None, None, None, lowest, None, None, *[None] * 5, bottom, key))
    for k in range(0, len(rows), 4096):
        yield _table(rows[k : k + 4096])


def rebuild(conversations: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """(key, conv_id) of every rebuilt conversation: a head of the first conversation of its ``every``, then its own turns after as many.

    The head is ``crc32(conv_id in decimals) % heads`` turns, all if there are fewer, none if that conversation is absent.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    name = F.unhex(F.concat(F.lpad(F.hex(F.octet_length(text)), 8, "0"), F.substring(digest, 1, 32)))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select((conv - F.pmod(conv, F.lit(every))).alias("lead"), conv.alias("conv_id"), F.col("turn"), name.alias("id"))
    dealt = turns.repartition("lead").sortWithinPartitions("lead", "conv_id", F.asc_nulls_first("turn"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, lead, head, own, keys, convs, held = None, None, [], [], [], [], 0

        def finish() -> None:
            nonlocal head, held
            head = own[: heads - 1] if conv == lead else head
            h = zlib.crc32(str(conv).encode()) % heads
            keys.append(b"".join(head[:h] + own[h:]))
            convs.append(conv)
            held += len(keys[-1])

        for batch in batches:
            for g, c, i in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != conv:
                    if conv is not None:
                        finish()
                    if g != lead:
                        head = []
                    conv, lead, own = c, g, []
                own.append(i)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(convs, pa.int64())], names=["key", "conv_id"])
                    keys, convs, held = [], [], 0
        if conv is not None:
            finish()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(convs, pa.int64())], names=["key", "conv_id"])

    return dealt.select("lead", "conv_id", "id").mapInArrow(run, "key binary, conv_id long")


def _digests(chunks: DataFrame) -> DataFrame:
    """(node, ends): the digest of each node's ids, chunk after chunk."""
    dealt = chunks.select("node", "first", "ends").repartition("node").sortWithinPartitions("node", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, names, hexes = None, None, [], []
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        names.append(node)
                        hexes.append(state.hexdigest())
                    node, state = at, hashlib.sha256()
                state.update(text.encode())
        if node is not None:
            names.append(node)
            hexes.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hexes)], names=["node", "late"])

    return dealt.mapInArrow(run, "node binary, late string")


def nodes(keys: DataFrame) -> DataFrame:
    """The trie of (key, conv_id) rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    made = materialize(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(plant, SCHEMA), "trie")
    # one row a task of the stage before, whatever the input's size
    bounds = made.where("kind = 'bounds'").select("low", "first", "high")
    pairs = bounds.select("low", F.lag("high").over(Window.orderBy("low", "first")).alias("before")).where("before is not null")

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _table(list(seam(before, low)))

    found = made.where("kind = 'node'")
    sums = [F.sum(s).alias(s) for s in SUMS]
    split = found.where("edge").unionByName(pairs.mapInArrow(seams, SCHEMA))
    merged = materialize(split.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("first").alias("first"), F.max("ends").alias("ends"), *sums), "trie_edges")
    columns = ["node", "parent", "depth", "first", "ends", *SUMS]
    inner = found.where("not edge")
    open_ = inner.where("parent_first is null").select(columns).unionByName(merged.select(columns))
    upper = merged.select(F.col("node").alias("parent"), F.col("first").alias("parent_first"))
    all_ = inner.where("parent_first is not null").select(*columns, "parent_first").unionByName(open_.join(upper, "parent", "left").select(*columns, "parent_first"))
    late = materialize(_digests(made.where("kind = 'ids'")), "trie_ends")
    out = all_.join(late, "node", "left")
    return out.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("distinct")).alias("saved_tokens"), F.coalesce("ends", "late", F.lit(NOTHING)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    small_batches(conversations.sparkSession)
    return nodes(materialize(rebuild(conversations), "rebuilt"))
