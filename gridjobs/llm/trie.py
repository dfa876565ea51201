"""A prefix trie of conversations: one node for each distinct sequence of first turns.

A turn's id has a fixed width: the first 16 bytes of the SHA-256 of its role and text, then the bytes of its text as a
big-endian 32-bit number.  A conversation's key is its turn ids one after another.  Spark sorts (key, conv_id) by range,
so that even a key that a third of all conversations share is dealt to several tasks, and every task builds adaptive radix
trees over slices of its sorted keys: bytes that have no branch are one compressed path, and a node that branches holds
its children in a layout of 4, 16, 48 or 256 places which grows as they come.  Only byte depths that are whole turns emit nodes.

Nodes below a slice's edges are finished there: members, children, leaves, saved tokens, the digest of those that end.
Only nodes on the path of a slice's first or last key can go on in a neighbour.  Each slice reports its share of them and
both paths; shares are added up, and what neighbours share (found from the edges' node ids alone) is counted once.  The
digest of members that end in such a node is fed slice by slice in order, as SHA-256 takes its input in one sequence.

Order of turns: by turn (null first), then role, then the turn's id; repeated rows are turns of their own.  A null role or
text is empty.  Rows with a null conv_id belong to no conversation and are left out.  A conversation without turns is a
member of the root alone.  An empty table gives no nodes, not even a root.  Columns of other names are ignored.  Texts are
hashed where they are read and never gathered; a task holds the ids (20 bytes a turn) of one conversation, and a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize

WIDTH = 20
#: Conversations, and bytes of keys, in a slice.
SLICE_KEYS, SLICE_BYTES = 20_000, 1 << 24


class Few:
    """Up to 4 or 16 children: sorted branch bytes beside the children."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self) -> None:
        self.bytes, self.nodes, self.room = bytearray(), [], 4

    def find(self, b: int) -> Branch | None:
        i = self.bytes.find(b)
        return self.nodes[i] if i >= 0 else None

    def put(self, b: int, node: Branch) -> Few | Indexed:
        i = self.bytes.find(b)
        if i >= 0:
            self.nodes[i] = node
            return self
        if len(self.nodes) == 16:
            return Indexed(self).put(b, node)
        self.room = 4 if len(self.nodes) < 4 else 16
        i = sum(x < b for x in self.bytes)
        self.bytes.insert(i, b)
        self.nodes.insert(i, node)
        return self

    def ordered(self) -> list[tuple[int, Branch]]:
        return list(zip(self.bytes, self.nodes))


class Indexed:
    """Up to 48 children: 256 places that number them."""

    __slots__ = ("nodes", "place", "room")

    def __init__(self, few: Few) -> None:
        self.room, self.place, self.nodes = 48, bytearray(256), list(few.nodes)
        for i, b in enumerate(few.bytes):
            self.place[b] = i + 1

    def find(self, b: int) -> Branch | None:
        i = self.place[b]
        return self.nodes[i - 1] if i else None

    def put(self, b: int, node: Branch) -> Indexed | Direct:
        if i := self.place[b]:
            self.nodes[i - 1] = node
            return self
        if len(self.nodes) == 48:
            return Direct(self).put(b, node)
        self.nodes.append(node)
        self.place[b] = len(self.nodes)
        return self

    def ordered(self) -> list[tuple[int, Branch]]:
        return [(b, self.nodes[i - 1]) for b, i in enumerate(self.place) if i]


class Direct:
    """A place for each of 256 children."""

    __slots__ = ("nodes", "room")

    def __init__(self, indexed: Indexed) -> None:
        self.room, self.nodes = 256, [None] * 256
        for b, node in indexed.ordered():
            self.nodes[b] = node

    def find(self, b: int) -> Branch | None:
        return self.nodes[b]

    def put(self, b: int, node: Branch) -> Direct:
        self.nodes[b] = node
        return self

    def ordered(self) -> list[tuple[int, Branch]]:
        return [(b, node) for b, node in enumerate(self.nodes) if node is not None]


class Branch:
    """A node of the radix tree: its compressed path, the conversations that end in it, its children."""

    __slots__ = ("ends", "kids", "path")

    def __init__(self, path: bytes) -> None:
        self.path, self.ends, self.kids = path, [], None


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class RadixTree:
    def __init__(self) -> None:
        self.root = Branch(b"")

    def insert(self, key: bytes, conv: int) -> None:
        node, above, at = self.root, None, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                m = shared(path, key[at : at + len(path)])
                split = Branch(path[:m])
                node.path = path[m + 1 :]
                split.kids = Few().put(path[m], node)
                above[0].kids = above[0].kids.put(above[1], split)  # the root's path is empty and never splits
                node, path = split, split.path
            at += len(path)
            if at == len(key):
                node.ends.append(conv)
                return
            b = key[at]
            below = node.kids.find(b) if node.kids is not None else None
            if below is None:
                below = Branch(key[at + 1 :])
                below.ends.append(conv)
                node.kids = (node.kids if node.kids is not None else Few()).put(b, below)
                return
            above, node, at = (node, b), below, at + 1


def path_ids(key: bytes) -> list[bytes]:
    """Ids of the nodes on a key's path, the root's first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.digest())
    return out


def path_bytes(key: bytes) -> list[int]:
    """Bytes of text up to each node of a key's path, summed."""
    out = [0]
    for at in range(WIDTH, len(key) + 1, WIDTH):
        out.append(out[-1] + int.from_bytes(key[at - 4 : at], "big"))
    return out


def _hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


COLUMNS = "depth long, conv_id long, parent_conv_id long, node binary, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"


def slice_nodes(tree: RadixTree, first: bytes, last: bytes) -> list[list]:
    """Rows of COLUMNS for the turn-aligned depths of one slice's tree, with keys from ``first`` to ``last``.

    Nodes on the path of either have an id (node), and leave the digest open; so do their children the parent's conv_id.
    """
    ids = (path_ids(first), path_ids(last))
    rows: list[list] = []
    path = bytearray()
    # A frame: branch, depth above it in bytes, lengths shared with the two edges, children still to do, what came from those done.
    frames = [[tree.root, -1, (0, 0), tree.root.kids.ordered() if tree.root.kids else [], ([], 0, None, 0, 0)]]
    while frames:
        branch, above, met, todo, got = frames[-1]
        if todo:
            b, below = todo.pop(0)
            start, part = len(path), bytes((b,)) + below.path
            path += part
            on = tuple(m + shared(part, edge[m : m + len(part)]) if m == start else m for m, edge in zip(met, (first, last)))
            frames.append([below, start, on, below.kids.ordered() if below.kids else [], ([], 0, None, 0, 0)])
            continue
        frames.pop()
        tops, n, least, leaves, saved = got
        if branch.ends:
            n, least = n + len(branch.ends), branch.ends[0] if least is None else min(least, branch.ends[0])
        end, ends = len(path), branch.ends
        for at in range(end - end % WIDTH, above, -WIDTH):
            own = ends if at == end else []
            edge = next((i for i in (0, 1) if at <= met[i]), None)
            higher = next((i for i in (0, 1) if at - WIDTH <= met[i]), None) if at else None
            leaves = leaves or 1
            saved += (n - 1) * int.from_bytes(path[at - 4 : at], "big") if at else 0
            depth = at // WIDTH
            for i in tops:
                if edge is None:
                    rows[i][2] = least
            final = edge is None
            rows.append([depth, least, None, None if final else ids[edge][depth], ids[higher][depth - 1] if higher is not None else None, n, len(tops), leaves, saved, _hash(own) if final else None, None if final or not own else ",".join(map(str, own)).encode()])
            tops = [len(rows) - 1]
        if frames:
            t, m, low, k, s = frames[-1][4]
            frames[-1][4] = (t + tops, m + n, least if low is None else low if least is None else min(low, least), k + leaves, s + saved)
            del path[above:]
    return rows


SLICED = f"{COLUMNS}, part int, slice int, first_ids array<binary>, first_bytes array<long>, last_ids array<binary>"


def sliced_nodes(keys: DataFrame, slice_keys: int, slice_bytes: int) -> DataFrame:
    """Rows of COLUMNS from each slice of the sorted ``keys`` (key, conv_id), and one row a slice that has its edges' paths."""
    names = [c.split()[0] for c in SLICED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]

    def emit(tree: RadixTree, first: bytes, last: bytes, part: int, number: int) -> Iterator[pa.RecordBatch]:
        rows = slice_nodes(tree, first, last)
        blank = [None] * (len(names) - 5)
        edge = [*blank, part, number, path_ids(first), path_bytes(first), path_ids(last)]
        for at in range(0, len(rows), 50_000):
            some = [*((edge,) if not at else ()), *([*r, part, number, None, None, None] for r in rows[at : at + 50_000])]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        tree, first, last, held, size = None, b"", b"", 0, 0
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tree is None:
                    tree, first, held, size = RadixTree(), key, 0, 0
                tree.insert(key, conv)
                last, held, size = key, held + 1, size + len(key)
                if held >= slice_keys or size >= slice_bytes:
                    yield from emit(tree, first, last, part, number)
                    tree, number = None, number + 1
        if tree is not None:
            yield from emit(tree, first, last, part, number)

    return keys.mapInArrow(run, SLICED)


def _shared_parts(edges: DataFrame) -> DataFrame:
    """What neighbouring slices counted twice, by node: rows (node, n_children, n_leaves, saved_tokens)."""
    before = Window.orderBy("part", "slice")  # a row a slice
    met = edges.select("part", "slice", "first_ids", "first_bytes", "last_ids").withColumn("prior", F.lag("last_ids").over(before)).where("prior IS NOT NULL")
    met = met.withColumn("s", F.expr("size(filter(arrays_zip(first_ids, prior), x -> x.first_ids = x.prior)) - 1")).withColumn("ended", F.expr("size(prior) - 1 = s"))
    each = met.select("s", "ended", "first_bytes", F.posexplode(F.expr("slice(first_ids, 1, s + 1)")).alias("d", "node"))
    twice = F.expr("element_at(first_bytes, s + 1) - IF(d = 0, 0L, element_at(first_bytes, d))")
    return each.select("node", F.when(F.expr("d < s"), -1).otherwise(0).alias("n_children"), F.when(F.col("ended"), -1).otherwise(0).alias("n_leaves"), twice.alias("saved_tokens"))


def _digests(shares: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256) of nodes on edges, from their ended members slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for x, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256()
                state.update(ends)
        if node is not None:
            out.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])

    dealt = shares.where("ends IS NOT NULL").select("node", "ends", "part", "slice").repartition("node").sortWithinPartitions("node", "part", "slice")
    return dealt.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def trie(keys: DataFrame, slice_keys: int = SLICE_KEYS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Nodes of the trie over ``keys`` (conv_id long, key binary): conv_id, depth, parent_conv_id, n_convs, ..."""
    dealt = keys.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(sliced_nodes(dealt, slice_keys, slice_bytes), "nodes")
    shares = found.where("node IS NOT NULL")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    twice = _shared_parts(found.where("first_ids IS NOT NULL")).select("node", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("n_convs"), *sums[1:])
    whole = shares.select("node", "parent", "depth", "conv_id", *sums).unionByName(twice).groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    whole = materialize(whole.join(_digests(shares), "node", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"]), "edges")
    higher = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    inner = found.where("node IS NULL AND depth IS NOT NULL")
    hanging = inner.where("parent IS NOT NULL").drop("parent_conv_id").join(higher, "parent")
    return inner.where("parent IS NULL").select(*rows).unionByName(hanging.select(*rows)).unionByName(whole.join(higher, "parent", "left").select(*rows))


def turn_id(role: str = "role", text: str = "text") -> Column:
    """A turn's id as hexadecimal digits; null role and text are empty."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return F.concat(F.left(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), F.lit(2 * (WIDTH - 4))), F.lpad(F.hex(F.octet_length(t)), 8, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, ids): the turn ids of each conversation in order."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), turn_id().alias("id"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id"))).alias("turns")).select("conv_id", F.col("turns.id").alias("ids"))


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Rows (conv_id, key): h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % (most + 1)."""
    own = materialize(sequences(conversations), "sequences")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("head"))
    both = own.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).join(heads, "base", "left").withColumn("h", F.expr(f"int(crc32(cast(cast(conv_id AS string) AS binary)) % {most + 1})"))
    ids = "concat(slice(coalesce(head, cast(array() AS array<string>)), 1, h), slice(ids, h + 1, size(ids)))"
    return both.select("conv_id", F.expr(f"unhex(array_join({ids}, ''))").alias("key"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(load(spark, sf_dir, "conversations")))
