"""SimHash near-duplicates found through deletion-variant signatures.

A text's words (ASCII lower case, split at ASCII white space) form n-word shingles, repeats included; each shingle is
hashed with XXH64 (seed 42); a fingerprint bit is 1 where more than half of the hashes have it.  Fewer than n words:
the whole sequence is the one shingle; no words or a null text: fingerprint zero, linked like any other.

Search: the fingerprint is cut into segments so few that one of them differs by at most one bit (two segments for two
differing bits).  Every segment is indexed with each of its bits deleted in turn; fingerprints that meet under one
variant are compared in full.  A variant shared by two fingerprints gives its pair from the minimum and maximum of a
partial aggregation; up to ``bucket_limit`` members are compared pairwise; fuller ones take another exact way whose
rows grow with the members only (wide fingerprints: what the stars of a few segments link first is one group; variants that
only one group shares are left out, and members of one group are not compared again; a few segments are
indexed at a time, so that the index never lies on disk as a whole): for a distance of up to 2, two fingerprints are within it exactly if flipping at most
one bit in each makes them equal, so the members that share a flipped value are linked to its smallest member.  For
larger distances every member of a fuller variant is compared with its smallest; only members that this does not link
meet all others, in blocks of ``BLOCK_NODES``.
With ``jaccard`` the groups found so are only candidates: inside each, texts are linked anew by the Jaccard similarity
of their sets of shingle hashes.  A group of up to ``BLOCK_BYTES`` of text is compared as a whole; in a larger one all
texts are compared with one text after another that is still unlinked (``STARS`` times), and then every text outside the
largest set of linked texts meets all others, in blocks.  So no link between two texts of a group is lost.

Equal fingerprints (wide ones: equal word sequences) count as one node throughout.  Empty table: empty result.  A row with
a null id is fingerprinted and linked like any other, so it also links those on its two sides; component_id is null only
where a whole component has no id.  For wide fingerprints a word sequence without any id links nothing.
Repeated rows share a component.  Columns of other names in the input are ignored, whatever their names.  A very long
text is hashed in blocks; its words and hashes are held by one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, load, materialize, release

SEED = 42
#: Members, and bytes of text, in a block of a group whose members are all compared.
BLOCK_NODES, BLOCK_BYTES = 1024, 1 << 20
#: Texts of a large group that all others are compared with, one after another, before blocks are.
STARS = 4
#: Segments of wide fingerprints whose fuller variants link their members first, before all segments are searched.
FIRST = 4
#: Segments of wide fingerprints that are indexed at a time.
PASS = 6
#: Odd multipliers that derive further 64-bit words from a shingle's hash, for wide fingerprints.
_STEP = 0x9E3779B97F4A7C15


def shingle_digests(words: list[bytes], n: int) -> bytes:
    """The XXH64 digests (8 bytes, big-endian) of the n-word shingles, one after another."""
    if not words:
        return b""
    digest, seed = xxhash.xxh64_digest, SEED
    if len(words) <= n:
        return digest(b" ".join(words), seed)
    parts = [words[i:] for i in range(n)]
    return b"".join([digest(b" ".join(s), seed) for s in zip(*parts)])


def bit_counts(words: list[bytes], n: int, width: int = 1) -> tuple[np.ndarray, int]:
    """(in how many shingles each of the 64 * width hash bits is set, shingles)."""
    h = np.frombuffer(shingle_digests(words, n), dtype=">u8")
    if width > 1:
        h = h.astype(np.uint64)
        wide = np.empty((len(h), width), ">u8")
        wide[:, 0] = h
        for j in range(1, width):
            x = h * np.uint64((_STEP * (2 * j + 1)) & (2**64 - 1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            wide[:, j] = x ^ (x >> np.uint64(32))
        h = wide
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(h), 255 * 64):  # blocks: bits take 64 times the room of hashes
        bits = np.unpackbits(h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8 * width), axis=1)
        whole = len(bits) // 255
        ones += bits[255 * whole :].sum(0, dtype=np.int64)
        if whole:
            ones += bits[: 255 * whole].reshape(whole, 255, -1).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return ones, len(h)


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits).view(">u8").astype(np.uint64)


def fingerprint(words: list[bytes], n: int, width: int = 1) -> np.ndarray:
    """``width`` unsigned 64-bit words of the fingerprint."""
    ones, total = bit_counts(words, n, width)
    return _words(2 * ones > total)


def weakest(ones: np.ndarray, total: int, cuts: list[tuple[int, int, int]], count: int) -> np.ndarray:
    """Bits of each segment with the least majority, as words: only they are deleted."""
    margin, chosen = np.abs(2 * ones - total), np.zeros(len(ones), bool)
    for w, first, bits in cuts:
        stop = 64 * (w + 1) - first  # bit ``first`` counts from the low end, the array from the high end
        chosen[stop - bits + np.argsort(margin[stop - bits : stop], kind="stable")[:count]] = True
    return _words(chosen)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, width: int = 1, cuts: list[tuple[int, int, int]] = (), delete: int | None = None) -> DataFrame:
    """Rows (doc_id, words, fp0, ...): fingerprint words as signed longs; words: for wide ones the MD5 of the word sequence.

    With ``delete``, also lo0, ...: the bits of each segment that may be deleted.
    """
    low = width if delete else 0
    names = ["doc_id", "words", *(f"fp{j}" for j in range(width)), *(f"lo{j}" for j in range(low))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, marks = np.empty((batch.num_rows, width + low), np.uint64), []
            for i, t in enumerate(batch.column(1)):
                words = (t.as_py() or b"").lower().split()
                ones, total = bit_counts(words, shingle, width)
                fps[i, :width] = _words(2 * ones > total)
                if low:
                    fps[i, width:] = weakest(ones, total, cuts, delete)
                marks.append(hashlib.md5(b" ".join(words)).digest() if width > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), *(pa.array(fps[:, j].view(np.int64).copy()) for j in range(width + low))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, words binary, " + ", ".join(f"{x} long" for x in names[2:]))


def segments(width: int, count: int, bits: int | None = None) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of ``count`` segments, as many in each word; at most 32 bits each.

    Without ``bits`` they cut each word into equal parts; with it they are spread evenly and may overlap.
    """
    per, left = divmod(count, width)
    if left or not per or (bits or 64 // per) > 32:
        raise ValueError("each word takes the same number of segments, of up to 32 bits")
    if bits is None:
        return [(w, 64 // per * i, 64 // per) for w in range(width) for i in range(per)]
    return [(w, (64 - bits) * i // max(1, per - 1), bits) for w in range(width) for i in range(per)]


def variants(nodes: DataFrame, cuts: list[tuple[int, int, int]], part: range | None = None) -> DataFrame:
    """Rows (key, node): every segment, or those numbered in ``part``, with each of its bits deleted in turn."""
    low = "lo0" in nodes.columns
    chosen = [f"filter(sequence(0L, {bits - 1}L), b -> shiftrightunsigned(lo{w}, int(b) + {first}) & 1L = 1L)" if low else f"sequence(0L, {bits - 1}L)" for w, first, bits in cuts]
    parts = [f"transform({chosen[s]}, b -> (shiftrightunsigned(fp{w}, {first}) & {(1 << bits) - 1}L & ~shiftleft(1L, int(b))) | shiftleft(b, 32) | {s << 40}L)" for s, (w, first, bits) in enumerate(cuts) if part is None or s in part]
    return nodes.select("node", *(["comp"] if "comp" in nodes.columns else []), F.explode(F.expr(f"flatten(array({', '.join(parts)}))")).alias("key"))


def _first_links(nodes: DataFrame, width: int, cuts: list[tuple[int, int, int]], max_diff: int) -> DataFrame:
    """Verified links of the members of each fuller variant of ``FIRST`` segments with its smallest node."""
    index = variants(nodes, cuts[:: max(1, len(cuts) // FIRST)])
    low = index.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("a")).where("c > 2").select("key", "a")
    pairs = index.join(low, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    return _within(pairs, nodes, width, max_diff)


def _within(pairs: DataFrame, nodes: DataFrame, width: int, max_diff: int) -> DataFrame:
    fps = [f"fp{j}" for j in range(width)]
    left, right = (nodes.select(F.col("node").alias(x), F.struct(*fps).alias(f"f{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").where(f"{_differing(width, 'fa', 'fb')} <= {max_diff}").select("a", "b")


def _differing(width: int, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"bit_count({a}.fp{j} ^ {b}.fp{j})" for j in range(width))


def _hot_links_exact(hot: DataFrame) -> DataFrame:
    """All links at distance 2 or less among 64-bit nodes, as stars over one-bit flips."""
    flips = hot.select("node", F.explode(F.expr("concat(array(fp0), transform(sequence(0, 63), i -> fp0 ^ shiftleft(1L, i)))")).alias("z"))
    low = flips.groupBy("z").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    return flips.join(low, "z").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the same of ``n`` items as all links do; near(i, others) marks the others that i is linked to."""
    left, out = np.arange(n), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            hit = near(i, left)
            reached += left[hit].tolist()
            out += [(i, j) for j in left[hit].tolist()]
            left = left[~hit]
    return out


def _crossed(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """``rows`` (group, node, apart, ...) with columns i, j of small groups in which every row that is ``apart`` meets
    every other row of its group; ``blocks``: how many blocks the group's rows of one kind take, as SQL over
    ``n_apart`` or ``n_rest`` put in place of {n}.  Groups without a row apart are left out.
    """
    kinds = rows.groupBy(group).agg(F.sum(F.col("apart").cast("long") * F.col("weight")).alias("n_apart"), F.sum((~F.col("apart")).cast("long") * F.col("weight")).alias("n_rest"), F.max("apart").alias("some")).where("some").drop("some")
    cut = lambda n: F.expr(f"cast(greatest(1, ceil({blocks.format(n=n)})) AS long)")
    met = rows.join(kinds, group).withColumn("own_blocks", F.when(F.col("apart"), cut("n_apart")).otherwise(cut("n_rest"))).withColumn("other_blocks", F.when(F.col("apart"), cut("n_rest")).otherwise(cut("n_apart")))
    met = met.withColumn("own", F.expr("pmod(xxhash64(node), own_blocks)")).drop("n_apart", "n_rest", "weight")
    over = met.withColumn("other", F.explode(F.expr("sequence(0L, other_blocks - 1)")))
    rest = over.select("*", F.when(F.col("apart"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("apart"), F.col("own")).otherwise(F.col("other")).alias("j"))
    among = met.where("apart AND own_blocks > 1").withColumn("other", F.explode(F.expr("sequence(0L, own_blocks - 1)"))).where("own <> other")
    among = among.select("*", (-1 - F.least("own", "other")).alias("i"), F.greatest("own", "other").alias("j"))
    return rest.unionByName(among).drop("own", "other", "own_blocks", "other_blocks", "apart")


def _as_links(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    at = nodes[np.array(found, np.int64).reshape(-1, 2)]
    return pa.table({"a": pa.array(at.min(1)), "b": pa.array(at.max(1))})


def _hot_links(hot: DataFrame, nodes: DataFrame, width: int, max_diff: int) -> DataFrame:
    """Links that connect whatever is within ``max_diff`` among the nodes of one key; hot: rows (key, node, comp, low), low the
    key's smallest node.  Nodes of equal comp are linked already.
    """
    fps = [f"fp{j}" for j in range(width)]
    first = nodes.select(F.col("node").alias("low"), F.col("comp").alias("low_comp"), F.struct(*fps).alias("f1"))
    rows = hot.join(first, "low").join(nodes.select("node", F.struct(*fps).alias("f2")), "node")
    rows = rows.select("key", "node", "low", F.expr("comp = low_comp").alias("linked"), F.expr(f"{_differing(width, 'f1', 'f2')} > {max_diff}").alias("far"), "f2")
    rows = materialize(rows.withColumn("apart", F.expr("far AND NOT linked")), "stars")
    stars = rows.where("NOT far AND NOT linked").select(F.col("low").alias("a"), F.col("node").alias("b"))

    def run(group: pa.Table) -> pa.Table:
        fp = np.column_stack([group.column(c).to_numpy() for c in fps]).view(np.uint64)
        return _as_links(group.column("node").to_numpy(), forest(len(fp), lambda i, others: np.bitwise_count(fp[others] ^ fp[i]).sum(1, dtype=np.int64) <= max_diff))

    met = _crossed(rows.select("key", "node", "apart", F.lit(1).alias("weight"), "f2.*"), "key", f"{{n}} / {BLOCK_NODES}")
    return stars.unionAll(met.select("key", "i", "j", "node", *fps).groupBy("key", "i", "j").applyInArrow(run, "a long, b long")).distinct()


def _hash_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_digests((text or b"").lower().split(), shingle), ">u8"))


def _similar_in(groups: DataFrame, keys: list[str], shingle: int, least: float) -> DataFrame:
    """Links that connect the texts of Jaccard similarity ``least`` or more among those of one group of rows."""

    def run(group: pa.Table) -> pa.Table:
        sets = [_hash_set(t.as_py(), shingle) for t in group.column("text")]
        size = np.array([len(x) for x in sets], np.int64)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
        at, marked = np.r_[0, np.cumsum(size)], np.zeros(len(ids) + 1, np.int64)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            own = ids[at[i] : at[i + 1]]
            marked[own] = 1
            sums = np.r_[0, np.cumsum(marked[ids])]
            marked[own] = 0
            both = sums[at[others + 1]] - sums[at[others]]
            return both >= least * (size[i] + size[others] - both) - 1e-9

        return _as_links(group.column("node").to_numpy(), forest(len(sets), near))

    return groups.select(*keys, "node", "text").groupBy(*keys).applyInArrow(run, "a long, b long").where("a <> b").distinct()


def _stars(large: DataFrame, left: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) of all texts of each group with its smallest node of ``left``.

    large: rows (component, node, text, n_bytes).  The one text is dealt to as many salts as its group has blocks.
    """
    salts = f"cast(ceil(n_bytes / {BLOCK_BYTES}) AS long)"
    one = left.groupBy("component").agg(F.min("node").alias("a"))
    one = large.select("component", F.col("node").alias("a"), F.col("text").alias("first"), "n_bytes").join(one, ["component", "a"]).withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts} - 1)"))).drop("n_bytes")
    rows = large.withColumn("salt", F.expr(f"pmod(xxhash64(node), {salts})")).join(one, ["component", "salt"]).where("node <> a").select("a", F.col("node").alias("b"), "first", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, a in enumerate(batch.column(0).to_pylist()):
                if a != held:
                    held, first = a, _hash_set(batch.column(2)[k].as_py(), shingle)
                other = _hash_set(batch.column(3)[k].as_py(), shingle)
                both = len(np.intersect1d(first, other, assume_unique=True))
                keep[k] = both >= least * (len(first) + len(other) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    return rows.mapInArrow(run, "a long, b long")


def similar(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links that connect the texts of Jaccard similarity ``least`` or more in each group; texts: rows (component, node, text)."""
    sizes = texts.groupBy("component").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_bytes"))
    texts = texts.join(sizes, "component")
    small = _similar_in(texts.where(f"n_bytes <= {BLOCK_BYTES}"), ["component"], shingle, least)
    large = materialize(texts.where(f"n_bytes > {BLOCK_BYTES}"), "large")
    left, found = large.select("component", "node"), []
    for _ in range(STARS):
        if left.isEmpty():
            break
        found.append(materialize(_stars(large, left, shingle, least), "stars"))
        ones = left.groupBy("component").agg(F.min("node").alias("node")).select("node")
        left = materialize(left.join(found[-1].select(F.col("b").alias("node")).unionAll(ones).distinct(), "node", "left_anti"), "left")
    if not found:
        return small
    stars = functools.reduce(DataFrame.unionAll, found)
    placed = large.join(components(stars, "a", "b").withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("weight", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    labels = placed.groupBy("component", "label").agg(F.sum("weight").alias("w"))
    most = labels.groupBy("component").agg(F.max(F.struct("w", "label")).alias("m")).select("component", F.col("m.label").alias("most"))
    placed = placed.join(most, "component").select("component", "node", "text", (F.col("label") != F.col("most")).alias("apart"), "weight")
    across = _similar_in(_crossed(placed, "component", f"{{n}} / {BLOCK_BYTES}"), ["component", "i", "j"], shingle, least)
    return small.unionAll(stars).unionAll(across)


def links(nodes: DataFrame, width: int, cuts: list[tuple[int, int, int]], max_diff: int, bucket_limit: int = 16) -> DataFrame:
    """Verified links (a, b), a < b, between nodes (node long, fp0, ...) of distinct fingerprints or texts."""
    spark = nodes.sparkSession
    exact = width == 1 and max_diff <= 2
    stars, parts = None, [range(len(cuts))]
    if not exact:  # what stars of a few segments link need not be compared again
        count = nodes.count()
        stars = materialize(_first_links(nodes, width, cuts, max_diff), "first")
        nodes = nodes.join(components(stars, "a", "b").withColumnRenamed("component", "comp"), "node", "left")
        nodes = materialize(nodes.withColumn("comp", F.coalesce("comp", "node")).repartition(-(-count // 8000) or 1), "placed")
        parts = [range(s, min(s + PASS, len(cuts))) for s in range(0, len(cuts), PASS)]
        release(spark)
    # Variants shared by the same nodes count once; those of one linked group are left out.
    alike = ["c", "low", "high", "mark"]
    met = []
    for part in parts:
        shared = variants(nodes, cuts, part).groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), *([] if exact else [F.min("comp").alias("one"), F.max("comp").alias("other")]), F.bit_xor(F.xxhash64("node")).alias("mark"))
        shared = shared.where("c > 1" if exact else "c > 1 AND one <> other")
        met.append(materialize(shared.groupBy(*alike).agg(F.min("key").alias("key")), "met"))
        if not exact:
            del shared
            release(spark)
    if len(parts) > 1:
        met = [materialize(functools.reduce(DataFrame.unionAll, met).groupBy(*alike).agg(F.min("key").alias("key")), "met")]
    met = met[0]
    pairs = met.where("c = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    full = []
    for part in parts:
        asked = met.where(f"c > 2 AND shiftright(key, 40) BETWEEN {part[0]} AND {part[-1]}").select("key", "c", "low")
        if not exact:  # written, so that a few keys are broadcast and the index is not dealt again
            asked = materialize(asked, "asked")
        full.append(materialize(variants(nodes, cuts, part).join(asked, "key"), "full"))
        if not exact:
            release(spark)
    full = functools.reduce(DataFrame.unionAll, full)
    some = full.where(f"c <= {bucket_limit}").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", F.col("node" if exact else "comp").alias("comp")))).alias("m"))
    some = some.select("m").distinct().select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.comp <> x.comp), y -> struct(x.node AS a, y.node AS b))))")).alias("p")).select("p.a", "p.b")
    hot = full.where(f"c > {bucket_limit}")
    found = _within(pairs.unionAll(some).distinct(), nodes, width, max_diff)
    if exact:
        return found.unionAll(_hot_links_exact(hot.select("node").distinct().join(nodes, "node")))
    return stars.unionAll(found).unionAll(_hot_links(hot, nodes, width, max_diff))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, width: int = 1, cut_into: int = 2, max_diff: int = 2, bits: int | None = None, delete: int | None = None, jaccard: float | None = None) -> DataFrame:
    """Rows (doc_id, fingerprint hex string, component_id): component_id is the smallest doc_id reachable by links.

    With ``cut_into`` segments every pair within ``2 * cut_into - 1`` differing bits meets for sure.  A wide
    fingerprint (``width`` words) with a larger ``max_diff`` estimates similarity: a share of 0.1515 differing bits is a
    cosine of 0.89 and so a Jaccard similarity of 0.8 of equally large shingle sets.  Beyond the sure distance a pair
    meets with the probability that one segment differs by at most one bit; ``bits`` shortens segments, and ``delete``
    deletes only so many bits of each, those with the least majority, where near copies differ.  With ``jaccard`` texts
    of one group are linked only from that similarity on, computed, so that ``max_diff`` may be generous.
    """
    spark = docs.sparkSession
    fps = [f"fp{j}" for j in range(width)]
    same = ["words", *fps] if width > 1 else fps
    lows = [f"lo{j}" for j in range(width)] if delete else []
    cuts = segments(width, cut_into, bits)
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, width, cuts, delete), "fingerprints")
    if width > 1:
        nodes = rows.groupBy("words").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in [*fps, *lows]))
    else:
        nodes = rows.groupBy(*same, *lows).agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp0"))
    nodes = materialize(nodes, "nodes")
    known = nodes.where("node IS NOT NULL").select("node", *fps, *lows).repartition(-(-nodes.count() // 8000) or 1)
    linked = components(links(known, width, cuts, max_diff), "a", "b")
    if jaccard is not None:
        release(spark)
        texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
        alike = texts.join(linked, "node").groupBy("node").agg(F.min("component").alias("component"), F.min("text").alias("text"))
        linked = components(similar(materialize(alike, "alike"), shingle, jaccard), "a", "b")
    release(spark)
    placed = nodes.join(linked, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    if width == 1:  # a component goes by its smallest fingerprint; its name is its smallest id
        ids = placed.groupBy("component_id").agg(F.min("least").alias("id"))
        placed = placed.join(ids, "component_id").withColumn("component_id", F.col("id"))
    placed = placed.select(*same, "component_id")
    met = rows.join(placed, same) if width == 1 else rows.drop(*fps).join(placed, "words")
    return met.select("doc_id", F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in fps))).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=3)
