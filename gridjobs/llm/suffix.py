"""Removal of long repeated passages by distributed prefix doubling.

Every byte covered by a ``length``-byte string that starts at two or more places of the corpus is removed.  Sorting all
suffixes would shuffle a row for every byte, so positions are pruned first, without loss:

1. Windows.  Each ``length``-byte window is named by the smallest hashed ``gram`` inside it (leftmost on ties).  Equal
   windows have equal smallest grams at equal offsets.  Neighbouring windows with the same gram position form a run.
2. Runs whose gram occurs once in the corpus hold only unique windows and are dropped.  Runs that are equal as a whole
   (gram and run hash, 128 bits together) are repeated throughout.  Of each set of equal runs one representative goes on.
3. Prefix doubling over the windows of what is left: the names of ``start`` bytes at a position and of the next
   ``start`` bytes are a rank pair; pairs are counted and sorted by Spark, pairs that occur once drop out, the others
   get their place in the order as new rank, and the offset doubles until ``length`` bytes are ranked.  Windows that
   still share a rank are repeated.

Units are bytes, or words (split at ASCII white space): ``words`` asks for passages of so many words besides, whatever
white space is between them, found in the same way over word hashes.  A text loses the bytes of either kind.

Hashes stand for strings: names within a group of equal grams, so that 128 bits decide.  A hot passage is pre-aggregated
in every shuffle that groups, and the joins have a unique small side, so that Spark splits a hot partition.

Nulls: a null text is empty and keeps an empty text; a null id is kept.  Rows that are repeated (same id and text) are
two documents, so passages of ``length`` bytes or more in them are removed.  Texts shorter than ``length`` stay whole.
Matches never cross documents.  Texts are hashed in
blocks of ``block`` windows; memory in a task follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, load, materialize, release

BLOCK = 1 << 20


class _Rolling:
    """Hashes of substrings by prefix sums modulo 2**64; tables of powers grow to the longest block seen."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letter = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63)) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, t: np.ndarray) -> np.ndarray:
        n = len(t)
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                powers = np.full(size, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        out = np.zeros(n + 1, np.uint64)
        letters = self.letter[t] if t.dtype == np.uint8 else t ^ self.letter[0]
        np.cumsum(letters * self.up[:n], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        x = (sums[start + length] - sums[start]) * self.down[start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


_first, _second = _Rolling(11), _Rolling(29)


def window_runs(t: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, gram hash, run hash) of the runs of a block of bytes."""
    w, grams = length - gram + 1, len(t) - gram + 1
    s1, s2 = _first.sums(t), _second.sums(t)
    h = (s1[gram:] - s1[:-gram]) * _first.down[:grams]
    order = h ^ (h >> np.uint64(32))
    order *= np.uint64(0xBF58476D1CE4E5B9)
    order >>= np.uint64(24)
    order <<= np.uint64(24)
    order |= np.arange(grams, dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        order = np.minimum(order[:-size], order[size:])
        size *= 2
    if size < w:
        order = np.minimum(order[: len(order) - (w - size)], order[w - size :])
    at = (order & np.uint64(0xFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[lo, len(at)])
    at = at[lo]
    run = _second.at(s2, lo, n - 1 + length) ^ ((at - lo) * (2 * length) + n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return lo, n, _first.at(s1, at, gram), run


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last, for the words of bytes.split()."""
    t = np.frombuffer(text, np.uint8)
    inside = np.r_[False, (t != 32) & ((t < 9) | (t > 13)), False].astype(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _blocks(text: bytes | None, length: int, block: int, words: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    if words:
        digest, parts = xxhash.xxh64_intdigest, (text or b"").split()
        t = np.fromiter((digest(w) for w in parts), np.uint64, len(parts))
    else:
        t = np.frombuffer(text or b"", np.uint8)
    for base in range(0, max(0, len(t) - length + 1), block):
        yield base, t[base : base + block + length - 1]


def _runs(rows: DataFrame, length: int, gram: int, block: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = batch.column(0).to_numpy(), []
            for i, text in enumerate(batch.column(1)):
                for base, t in _blocks(text.as_py(), length, block, words):
                    lo, n, k, s = window_runs(t, length, gram)
                    found.append((np.full(len(lo), keys[i]), lo + base, n.astype(np.int32), k.view(np.int64), s.view(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["row", "lo", "n", "gram", "run"])

    return rows.mapInArrow(run, "row long, lo long, n int, gram long, run long")


def _positions(rows: DataFrame, length: int, start: int, block: int, words: bool) -> DataFrame:
    """A row for each window asked for: its gram's group, the name of its first ``start`` bytes and of the pieces after."""
    sizes = [start]
    while sum(sizes) < length:
        sizes.append(min(sum(sizes), length - sum(sizes)))
    names = ["name", *(f"next{j}" for j in range(1, len(sizes)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, asked = batch.column(0).to_numpy(), batch.column(2)
            for i, text in enumerate(batch.column(1)):
                own = asked[i].values
                lo, n, gram, alone = (own.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "n", "gram", "alone"))
                each = np.repeat(np.arange(len(lo)), n)
                p = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                for base, t in _blocks(text.as_py(), length, block, words):
                    here = np.flatnonzero((p >= base) & (p < base + block))
                    if not len(here):
                        continue
                    sums, q, out = _second.sums(t), p[here] - base, []
                    for size in sizes:
                        out.append(pa.array(_second.at(sums, q, size).view(np.int64)))
                        q = q + size
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), keys[i])), pa.array(p[here]), pa.array(gram[each[here]]), pa.array(alone[each[here]]), *out], names=["row", "p", "gram", "alone", *names])

    return rows.mapInArrow(run, "row long, p long, gram long, alone boolean, " + ", ".join(f"{x} long" for x in names))


def prefix_doubling(positions: DataFrame) -> DataFrame:
    """Positions whose whole string occurs more than once.

    ``positions``: row, p, gram (the group in which names compare), alone, name (of the first bytes) and next1, next2, ...
    (of the pieces that double the length each time); a written table, whose files go after the first round.  Each round counts and sorts the rank pairs, drops what has become
    unique and ranks the rest anew by place in the sorted order.
    """
    pieces = [c for c in positions.columns if c.startswith("next")]
    ranked = positions.withColumnRenamed("name", "rank")
    for piece in pieces:
        pair = ["gram", "rank", piece]
        again = ranked.groupBy(*pair).agg(F.count("*").alias("c")).where("c > 1").drop("c")
        again = materialize(again.orderBy(*pair).withColumn("newrank", F.monotonically_increasing_id()), "ranks")
        release(positions.sparkSession)
        joined = ranked.join(again, pair).drop("rank", piece).withColumnRenamed("newrank", "rank")
        if piece != pieces[-1]:
            joined = materialize(joined, "ranked")
            for t in (ranked, again):
                drop_table(t)
            release(positions.sparkSession)
        ranked = joined
    return ranked


def _kept(rows: DataFrame, length: int, words: int, as_text: bool, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, removed, kept = batch.column("bytes").to_pylist(), batch.column("spans"), [], []
            for i, text in enumerate(texts):
                own = spans[i].values
                if own is None or not len(own):
                    removed.append([])
                    kept.append(text)
                    continue
                lo = own.field("lo").to_numpy()
                hi = lo + own.field("n").to_numpy() - 1
                worded = own.field("worded").to_numpy(zero_copy_only=False)
                if worded.any():
                    first, last = word_places(text)
                    lo, hi = lo.copy(), hi.copy()
                    hi[worded] = last[hi[worded] + words - 1]
                    lo[worded] = first[lo[worded]]
                hi[~worded] += length
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                lo, hi = lo[first], hi[np.r_[first[1:], len(hi)] - 1]
                removed.append([{"start": a, "stop": b} for a, b in zip(lo.tolist(), hi.tolist())])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)])))
            cols = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("bytes", "spans")]
            rest = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), rest], names=[*(c for c in batch.schema.names if c not in ("bytes", "spans")), "n_bytes", "removed", "kept"])

    return rows.mapInArrow(run, schema)


def _repeated(rows: DataFrame, length: int, gram: int, start: int, block: int, words: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (row, lo, n): windows lo, lo + 1, ... of ``length`` bytes or words of a text that occur elsewhere too.

    They are read from the tables returned besides, which may be dropped afterwards.
    """
    spark = rows.sparkSession
    runs = materialize(_runs(rows.where(F.length("bytes") >= (2 * length - 1 if words else length)).select("row", "bytes"), length, gram, block, words), "runs")
    grams = materialize(runs.groupBy("gram").agg(F.count("*").alias("c"), F.min("run").alias("a"), F.max("run").alias("b")).where("c > 1").select("gram", F.expr("a <> b").alias("mixed")), "grams")
    again = materialize(runs.join(grams, "gram"), "again")
    drop_table(runs)
    release(spark)

    mixed = again.where("mixed")
    kinds = materialize(mixed.groupBy("gram", "run").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "n")).alias("one")), "kinds")
    release(spark)
    ask = kinds.where("c = 1").select("gram").distinct()
    asked = kinds.join(ask, "gram").select("one.*", "gram", F.expr("c = 1").alias("alone"))
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("lo", "n", "gram", "alone")).alias("asked"))
    positions = materialize(_positions(rows.select("row", "bytes").join(asked, "row"), length, start, block, words), "positions")
    release(spark)
    single = prefix_doubling(positions).where("alone").select("row", F.col("p").alias("lo"), F.lit(1).alias("n"))

    whole = again.where("NOT mixed").select("row", "lo", "n").unionAll(mixed.join(kinds.where("c > 1"), ["gram", "run"], "left_semi").select("row", "lo", "n"))
    return whole.unionAll(single), [again, kinds]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 300, start: int = 100, keep: list[str] = (), as_text: bool = False, block: int = BLOCK, words: int = 0) -> DataFrame:
    """Rows (doc_id, n_bytes, removed array of byte spans, kept binary), one for each row of ``docs``.

    ``keep`` names further columns to carry along; ``as_text`` returns kept as a string, without the bytes of characters
    that a span cuts through.  ``words`` also removes repeated passages of so many words.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row"), text.cast("binary").alias("bytes"), *(F.col(c).alias(f"kept_{c}") for c in keep))

    windows, tables = _repeated(rows, length, gram, start, block)
    windows = windows.withColumn("worded", F.lit(False))
    if words:
        windows = materialize(windows, "windows")
        for t in tables:
            drop_table(t)
        release(spark)
        more, tables = _repeated(rows, words, max(1, words * 3 // 4), max(1, words // 4), block, words=True)
        windows = windows.unionAll(more.withColumn("worded", F.lit(True)))
    spans = materialize(windows.groupBy("row").agg(F.collect_list(F.struct("lo", "n", "worded")).alias("spans")), "spans")
    for t in tables:
        drop_table(t)
    release(spark)
    carried = [f"kept_{c}" for c in keep]
    out = rows.join(spans, "row", "left").select("doc_id", *carried, "bytes", "spans")
    kinds = dict(out.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *carried])
    out = _kept(out, length, words, as_text, f"{schema}, n_bytes long, removed array<struct<start: long, stop: long>>, kept {'string' if as_text else 'binary'}")
    return out.select("doc_id", "n_bytes", "removed", "kept", *(F.col(f"kept_{c}").alias(c) for c in keep))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
