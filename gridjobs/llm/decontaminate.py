"""Benchmark decontamination with spaced seeds.

Tokens are lower-cased words (runs of letters, digits and underscores), hashed to 64 bits.  Fixed masks pick some of the
tokens of a window and ignore the others, so a substitution at an ignored place leaves the seed's hash as it was.
Benchmark seeds are a table, and Spark joins it by hash with the documents' seeds; each meeting fixes an item and a
diagonal (document place less item place), on which overlaps are verified: a segment of ``min_overlap`` tokens (or the
whole item, if it is shorter) or more of which ``min_share`` agree.  On a diagonal the best-scoring segment (a match
counts 1, a substitution ``-penalty``) is reported if it passes, else the longest one that does, and then those of what
is left on either side of it.  So all overlaps are returned, a row for each.

No overlap of 13 tokens or more of which 80 % agree lacks a seed: such a segment of 26 tokens or more has a half of 13 or
more that passes as well, and of 13 to 25 tokens the masks reach every pattern of substitutions (2 in 13, 3 in 15, 4 in
20, 5 in 25).  For other values of the parameters, and for items of fewer than 13 tokens, a seed is a run of as many tokens
as the substitutions of a passing segment must leave whole somewhere.

Most of a document's seeds meet nothing.  Two bit tables of fixed size, of the benchmark's token hashes and of its seed
hashes, are built by Spark and broadcast (``TOKEN_BITS`` and ``SEED_BITS`` say how large); what they let pass goes to
the join, so a larger benchmark costs more joined rows, never more memory.  Only documents with such a seed travel on,
with their token hashes.  A seed's places in one document are one row, and the benchmark's side is dealt to ``SALTS``
salts, so that a seed that many documents share is split over tasks.

Nulls: a null text has no tokens, a null id is kept in the result; items without tokens match nothing.  Repeated
documents are reported each; so are repeated items.  Of equal segments on a diagonal the leftmost is taken.  Columns of
other names in either table are ignored.  A very long text is held by one task, with 8 bytes a token.  Empty tables: no
rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

#: The masks; 1 marks a token that the seed takes.  Lossless for MASKS_FOR (tokens, agreeing share) or more.
MASKS = ("1111011", "10111011", "110000010111", "1101110000001")
MASKS_FOR = (13, 0.8)
#: Sizes of the bit tables, as powers of two, of salts of the benchmark's seeds, and of a worker's cache of words.
TOKEN_BITS, SEED_BITS, SALTS, CACHE = 22, 26, 8, 400_000
_WORD = re.compile(r"\w+")
_MIX = [(0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1) for i in range(64)]


def as_fraction(share: float) -> Fraction:
    return Fraction(share).limit_denominator(10_000)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def token_hash(word: str) -> int:
    """A signed 64-bit hash that is never 0: 0 stands for words that the benchmark does not have."""
    h = xxhash.xxh64_intdigest(word.encode(), 7)
    return (h - (1 << 64) if h >> 63 else h) or 1


def sure_run(length: int, share: Fraction) -> int:
    """Agreeing tokens that follow each other somewhere in every segment of ``length`` tokens of which ``share`` agree."""
    wrong = length - math.ceil(length * share)
    return -(-(length - wrong) // (wrong + 1))


def seed_kind(length: int, min_overlap: int, share: Fraction) -> int:
    """How an item of ``length`` tokens is seeded: 0 by the masks, n by runs of n tokens."""
    if length < min_overlap:
        return max(1, sure_run(length, share))
    if min_overlap >= MASKS_FOR[0] and share >= as_fraction(MASKS_FOR[1]):
        return 0
    # Segments of min_overlap to twice as many tokens: any longer one has a half that passes too.
    return max(1, min(length, *(sure_run(n, share) for n in range(max(1, min_overlap), max(2, 2 * min_overlap)))))


def masks_of(kind: int) -> list[np.ndarray]:
    return [np.flatnonzero([c == "1" for c in m]) for m in MASKS] if kind == 0 else [np.arange(kind)]


def seeds(ids: np.ndarray, kind: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the seeds of token hashes; only of windows whose taken tokens are all ``known``."""
    found, places = [], []
    for number, mask in enumerate(masks_of(kind)):
        n = len(ids) - int(mask[-1])
        if n <= 0:
            continue
        valid = np.ones(n, bool) if known is None else known[mask[0] : mask[0] + n].copy()
        if known is not None:
            for m in mask[1:]:
                valid &= known[m : m + n]
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        h = np.full(len(at), (kind * 8 + number + 1) * 0x2545F4914F6CDD1D & (2**64 - 1), np.uint64)
        for i, m in enumerate(mask):
            h += ids[at + m].view(np.uint64) * np.uint64(_MIX[i % 64])
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(h.view(np.int64))
        places.append(at)
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def best_overlap(same: np.ndarray, penalty: float) -> tuple[int, int]:
    """[start, stop) of the segment with the greatest sum, a match counting 1 and the rest -penalty."""
    best, low, start, total = (0.0, 0, 0), 0.0, 0, 0.0
    for i, x in enumerate(same.tolist()):
        total += 1.0 if x else -penalty
        if total - low > best[0]:
            best = (total - low, start, i + 1)
        if total < low:
            low, start = total, i + 1
    return best[1], best[2]


def longest_overlap(same: np.ndarray, least: int, share: Fraction) -> tuple[int, int]:
    """[start, stop) of the longest segment of which ``share`` agrees, less substitutions at its ends beyond ``least`` tokens."""
    gain = np.where(same, share.denominator - share.numerator, -share.numerator)
    sums = np.r_[0, np.cumsum(gain)]
    # For each start, the last stop whose sum is no smaller: sums that no later one exceeds are in falling order.
    top = np.maximum.accumulate(sums[::-1])[::-1]
    stop = np.searchsorted(-top, -sums, "right") - 1
    a = int(np.argmax(stop - np.arange(len(sums))))
    b = int(stop[a])
    while b - a > least and not (same[a] and same[b - 1]):
        a, b = (a, b - 1) if not same[b - 1] else (a + 1, b)
    return a, b


def passing(same: np.ndarray, least: int, share: Fraction, penalty: float) -> list[tuple[int, int]]:
    """[start, stop) of the passing segments of a diagonal: the best or else the longest, then those left and right of it."""
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least or int(same[lo:hi].sum()) < math.ceil(least * share):
            continue
        part = same[lo:hi]
        passes = lambda a, b: b - a >= least and int(part[a:b].sum()) >= share * (b - a)
        longest = longest_overlap(part, least, share)
        if passes(*longest):  # else no segment does
            best = best_overlap(part, penalty)
            a, b = best if passes(*best) else longest
            out.append((lo + a, lo + b))
            todo += [(lo, lo + a), (lo + b, hi)]
    return sorted(out)


def _bits(values: DataFrame, column: str, power: int) -> np.ndarray:
    """A table of 2**power bytes, 1 where a value's top bits say; at most 2**power / 64 rows reach the driver."""
    place = F.shiftrightunsigned(column, 64 - power)
    words = values.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned({column}, {64 - power}) & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(2 ** (power - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return table


def _has(table: np.ndarray, values: np.ndarray, power: int) -> np.ndarray:
    place = values.view(np.uint64) >> np.uint64(64 - power)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Known(dict):
    """Token hashes of words, 0 for those that the benchmark does not have."""

    def __init__(self, table: np.ndarray) -> None:
        self.flags = np.unpackbits(table.view(np.uint8), bitorder="little").tobytes()

    def __missing__(self, word: str) -> int:
        h = token_hash(word)
        h = self[word] = h if self.flags[(h >> 64 - TOKEN_BITS) & (1 << TOKEN_BITS) - 1] else 0
        return h


def _items(benchmark: DataFrame, item_col: str, text_col: str, min_overlap: int, share: Fraction) -> DataFrame:
    """Rows (item, item_id, kind, ids): the items that have tokens."""
    kind = dict(benchmark.dtypes)[item_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = [[token_hash(w) for w in tokens(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), batch.column(0), pa.array([seed_kind(len(x), min_overlap, share) if x else -1 for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int64()))], names=["item", "item_id", "kind", "ids"])
            row += len(ids)

    return benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"item long, item_id {kind}, kind int, ids array<long>").where("kind >= 0")


def _seed_rows(items: DataFrame) -> DataFrame:
    """Rows (seed, item, places) of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, kind, ids in zip(*(c.to_pylist() for c in batch.columns)):
                h, at = seeds(np.array(ids, np.int64), kind)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), item, np.int64)), pa.array(at.astype(np.int32))], names=["seed", "item", "at"])

    rows = items.select("item", "kind", "ids").mapInArrow(run, "seed long, item long, at int")
    return rows.groupBy("seed", "item").agg(F.collect_list("at").alias("item_at"))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _scan(rows: DataFrame, kinds: list[int], known: np.ndarray, seeded: np.ndarray) -> DataFrame:
    """Rows (row, doc_id, ids, hits) of the documents with a seed that the bit tables let pass."""
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast((known, seeded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seed_table = shared.value
        words = _Known(table)
        row = TaskContext.get().partitionId() << 33
        gap = max(int(m[-1]) for k in kinds for m in masks_of(k)) + 1  # no window reaches from one text into the next
        for batch in (part for whole in batches for part in _slices(whole, 512)):
            own = []
            for text in batch.column(1):
                if len(words) > CACHE:
                    words.clear()
                found = tokens(text.as_py())
                own.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
            starts = np.cumsum([0, *(len(x) + gap for x in own)])
            ids = np.zeros(int(starts[-1]), np.int64)
            for x, a in zip(own, starts):
                ids[a : a + len(x)] = x
            h, place = (np.concatenate(x) for x in zip(*(seeds(ids, k, ids != 0) for k in kinds)))
            here = _has(seed_table, h, SEED_BITS)
            h, place = h[here], place[here]
            doc = np.searchsorted(starts, place, "right") - 1
            order = np.lexsort((place, h, doc))
            h, doc, place = h[order], doc[order], (place - starts[doc])[order].astype(np.int32)
            if not len(h):
                continue
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            at, sizes = np.unique(doc[first], return_counts=True)
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(place))
            hits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(h[first]), places], names=["seed", "at"]))
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), batch.column(0).take(pa.array(at)), pa.array([own[i] for i in at.tolist()], pa.list_(pa.int64())), hits], names=["row", "doc_id", "ids", "hits"])
            row += n

    return rows.mapInArrow(run, f"row long, doc_id {kind}, ids array<long>, hits array<struct<seed: long, at: array<int>>>")


def _diagonals(met: DataFrame) -> DataFrame:
    """Rows (row, item, shift), each once: the diagonals of all meetings (row, item, doc_at, item_at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if len(a) * len(b) <= 64:
                    found.append(list({x - y for x in a for y in b}))
                    continue
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                some = [np.unique(a[i : i + 1024, None] - b[None, j : j + 1024]) for i in range(0, len(a), 1024) for j in range(0, len(b), 1024)]
                found.append(np.unique(np.concatenate(some)).tolist())
            size = [len(x) for x in found]
            keys = np.stack([np.repeat(batch.column(c).to_numpy(), size) for c in (0, 1)] + [np.fromiter(itertools.chain.from_iterable(found), np.int64, sum(size))], 1)
            once = np.unique(keys, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(once[:, c])) for c in range(3)], names=["row", "item", "shift"])

    return met.select("row", "item", "doc_at", "item_at").mapInArrow(run, "row long, item long, shift long").distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = 13, min_share: float = 0.8, penalty: float = 2.0) -> DataFrame:
    """Rows (doc_id, item_id, doc_start, doc_stop, item_start, matched): token places of each document's verified overlaps."""
    spark, share = docs.sparkSession, as_fraction(min_share)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    doc_kind, item_kind = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, doc_start int, doc_stop int, item_start int, matched int"
    items = materialize(_items(benchmark, item_col, item_text_col, min_overlap, share), "items")
    kinds = sorted(r["kind"] for r in items.select("kind").distinct().collect())
    if not kinds:
        return spark.createDataFrame([], schema)
    seed_rows = materialize(_seed_rows(items), "seeds")
    known = _bits(items.select(F.explode("ids").alias("h")).distinct(), "h", TOKEN_BITS)
    found = materialize(_scan(rows, kinds, known, _bits(seed_rows.select("seed").distinct(), "seed", SEED_BITS)), "found")

    hits = found.select("row", F.explode("hits").alias("h")).select("row", F.col("h.seed").alias("seed"), F.col("h.at").alias("doc_at"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    dealt = seed_rows.withColumn("salt", F.explode(F.array(*(F.lit(x).cast("long") for x in range(SALTS)))))
    shifts = _diagonals(hits.join(dealt, ["seed", "salt"])).groupBy("row", "item").agg(F.collect_list("shift").alias("shifts"))
    pairs = shifts.join(items.select("item", "item_id", F.col("ids").alias("target")), "item").join(found.select("row", "doc_id", "ids"), "row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, take, out = batch.slice(at, 256), [], []
                for i in range(part.num_rows):
                    shift, target, ids = (part.column(c)[i].values.to_numpy() for c in (2, 3, 4))
                    least = min(min_overlap, len(target))
                    for d in sorted(shift.tolist()):
                        lo, hi = max(0, -d), min(len(target), len(ids) - d)
                        same = ids[lo + d : hi + d] == target[lo:hi]
                        for a, b in passing(same, least, share, penalty):
                            take.append(i)
                            out.append((lo + a + d, lo + b + d, lo + a, int(same[a:b].sum())))
                places = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(places), part.column(1).take(places), *(pa.array(c, pa.int32()) for c in (zip(*out) if out else [[]] * 4))], names=["doc_id", "item_id", "doc_start", "doc_stop", "item_start", "matched"])

    return pairs.select("doc_id", "item_id", "shifts", "target", "ids").mapInArrow(verify, schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
