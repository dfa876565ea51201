"""How the word use of sources differs within a language, measured exactly.

Terms are runs of ASCII letters and of bytes over 127 (whole other characters), with A-Z lower-cased.  A language keeps the
terms that occur in at least ``least_docs`` of its documents.  Each (language, source) that occurs, and each language, gives
every kept term the share p = 1 + floor(10**9 * (count + 1) / (N + V)); V kept terms, N their occurrences there.  The
divergence of p from q at a term is floor((p - q)**2 / q), all in integers.

Counting takes pointers to the first byte of every term of an Arrow buffer of documents, in slices of ``slice_bytes``, and
sorts them by multikey quicksort over characters of 8 bytes: numpy's quicksort orders pointers by one such character, and
only runs of equal ones whose terms go on are sorted by the next.  Runs of equal terms then give, in the order of their
documents, the documents and occurrences of each source.  Spark adds slices up, so no term, source or document is gathered
whole; a slice holds whole documents, so that each is counted once, and a very long text is a slice of its own.

Comparing sources: terms of a language are dealt to blocks, a block is a matrix of shares (terms by sources), and Spark
adds the blocks' sums up.  The result itself has a row for each two sources of a language.

Nulls: a null text, language or source is the empty string.  Rows that are repeated are documents of their own.  Documents
without a term still make their source occur.  Ties rank by item in UTF-8 order.  An empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize

#: Terms' bytes, with A-Z lower-cased; zero for bytes outside terms.
_FOLD = np.zeros(256, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
#: Masks that keep the first n bytes of 8, big-endian.
_KEEP = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)
SLICE_BYTES = 8 << 20
#: (term, source) counts in a block of the comparison, and shares in a matrix at once.
BLOCK_COUNTS, MATRIX = 1 << 15, 1 << 20


def term_pointers(text: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes with 8 zeros after them, first byte of each term, its length); terms end where a document ends."""
    folded = np.zeros(len(text) + 8, np.uint8)
    folded[: len(text)] = _FOLD[text]
    inside = folded[: len(text) + 1] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = starts_of_docs[starts_of_docs < len(text)]
    begins[cut] = inside[cut]
    first = np.flatnonzero(begins)
    gaps = np.flatnonzero(~inside)
    after = gaps[np.searchsorted(gaps, first)] if len(first) else first
    after = np.minimum(after, np.r_[first[1:], len(text)]) if len(first) else first
    return folded, first, after - first


def sorted_runs(folded: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of term pointers: (their order, the number of the run of equal terms of each in that order)."""
    eights = np.ndarray(len(folded) - 7, ">u8", folded, strides=(1,))
    order, fresh = np.arange(len(first)), np.zeros(len(first), bool)
    fresh[:1] = True
    todo, at = np.arange(len(first)), 0  # places in the order whose runs are not yet told apart from byte ``at`` on
    while len(todo):
        mine = order[todo]
        char = eights[first[mine] + np.minimum(at, length[mine])].astype(np.uint64) & _KEEP[np.clip(length[mine] - at, 0, 8)]
        run = np.cumsum(fresh[todo])  # quicksort inside each run: the run is the higher key
        by = np.argsort(char)
        if run[-1] > 1:
            by = by[np.argsort(run[by], kind="stable")]
        mine, char = mine[by], char[by]
        order[todo] = mine
        new = np.ones(len(todo), bool)
        new[1:] = (run[1:] != run[:-1]) | (char[1:] != char[:-1])
        fresh[todo] |= new
        at += 8
        longer = length[mine] > at  # equal 8 bytes: all of a run go on, or it is one that ended within them
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, len(todo)])
        ends = np.add.reduceat(longer, starts)
        going = np.repeat((ends > 0) & (size > 1), size)
        todo = todo[going]
    return order, np.cumsum(fresh) - 1


def slice_counts(text: np.ndarray, starts_of_docs: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, occurrences, documents) of a slice: ``group`` is the number of each document's group."""
    folded, first, length = term_pointers(text, starts_of_docs)
    if not len(first):
        return pa.array([], pa.binary()), *(np.zeros(0, np.int64) for _ in range(3))
    order, run = sorted_runs(folded, first, length)
    doc = (np.searchsorted(starts_of_docs, first, side="right") - 1)[order]
    inside = np.sort(run * len(group) + doc)  # by term, then document
    begins = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
    times = np.diff(np.r_[begins, len(inside)])
    term, which = np.divmod(inside[begins], len(group))
    groups = int(group.max()) + 1
    key = term * groups + group[which]
    by = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    docs, times = np.diff(np.r_[begins, len(by)]), np.add.reduceat(times[by], begins)
    term, of = np.divmod(key[by][begins], groups)
    heads = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])]
    n = length[heads]
    offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
    data = folded[np.repeat(first[heads] - offsets[:-1], n) + np.arange(offsets[-1])]
    names = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return names.take(pa.array(term)), of, times, docs


def counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (lang, source, term binary, count, docs) of slices; docs: rows (lang, source, text), none of them null."""
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            pairs, group = np.unique(langs.indices.to_numpy() * np.int64(len(sources.dictionary)) + sources.indices.to_numpy(), return_inverse=True)
            texts = batch.column(2)
            offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.binary() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="right")) - 1)
                term, of, times, seen = slice_counts(data[offsets[at] : offsets[to]], offsets[at:to] - offsets[at], group[at:to])
                at = to
                if len(term):
                    lang, source = np.divmod(pairs[of], len(sources.dictionary))
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), term, pa.array(times), pa.array(seen)], names=names)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, count long, docs long")


SHARE = "1 + (cast(1000000000 AS decimal(10, 0)) * cast({c} + 1 AS decimal(20, 0))) div cast({n} + {v} AS decimal(20, 0))"
APART = "((p - q) * (p - q)) div q"


def _block_sums(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) to be added up: sums of each block of terms over all ordered pairs of sources."""

    def run(key: tuple, some: pa.Table, shares: pa.Table) -> pa.Table:
        names = shares.column("source").combine_chunks()
        rank = {s: i for i, s in enumerate(names.to_pylist())}
        zero = shares.column("p0").to_numpy()
        of = np.array([rank[s] for s in some.column("source").to_pylist()], np.int64)
        term = np.unique(some.column("term").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        p, by = some.column("p").to_numpy(), np.argsort(term, kind="stable")
        term, of, p = term[by], of[by], p[by]
        total, at, step = np.zeros((len(zero), len(zero)), np.int64), 0, max(1, MATRIX // len(zero))
        while at < len(term):
            to = int(np.searchsorted(term, term[at] + step))
            shown = np.tile(zero, (int(term[to - 1] - term[at]) + 1, 1))
            shown[term[at:to] - term[at], of[at:to]] = p[at:to]
            for i in range(len(zero)):
                apart = shown[:, i : i + 1] - shown
                total[i] += (apart * apart // shown).sum(0)
            at = to
        i, j = np.nonzero(~np.eye(len(zero), dtype=bool) & (len(term) > 0))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": pa.array(total[i, j])})

    blocks = groups.where("v > 0").select("lang", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "source", "p0")
    return parts.select("lang", "block", "term", "source", "p").groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top: int = 200, slice_bytes: int = SLICE_BYTES, block_counts: int = BLOCK_COUNTS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): other sources by divergence (pair), and telling terms (term)."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    added = counts(docs, slice_bytes).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = added.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("each"), F.sum("count").alias("all"), F.sum("docs").alias("docs"))
    kept = materialize(terms.where(f"docs >= {least_docs}").drop("docs").withColumn("term", F.col("term").cast("string")), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"), F.sum(F.size("each")).alias("cells"))
    sums = kept.select("lang", F.explode("each").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0)
    groups = materialize(groups.withColumn("p0", F.expr(f"IF(v = 0, 0L, {SHARE.format(c=0, n='n', v='v')})")).withColumn("blocks", F.expr(f"1 + cells div {block_counts}")), "groups")
    cells = kept.select("lang", "term", "all", F.explode("each").alias("e")).select("lang", "term", "all", "e.source", "e.count").join(groups.drop("p0", "cells"), ["lang", "source"])
    cells = cells.select("lang", "source", "term", F.expr("pmod(xxhash64(term), blocks)").alias("block"), F.expr(SHARE.format(c="count", n="n", v="v")).alias("p"), F.expr(SHARE.format(c="all", n="n_lang", v="v")).alias("q"))
    cells = materialize(cells, "cells")

    both = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pair = both.join(_block_sums(cells, groups).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left").fillna(0, ["value"])
    term = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(APART).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(best)) for x in (pair, term)]
    return ranked[0].withColumn("part", F.lit("pair")).unionByName(ranked[1].where(f"rank <= {top}").withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))
