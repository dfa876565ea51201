import itertools

import numpy as np
import xxhash

from gridjobs.llm import simhash
from gridjobs.llm.common import components


def slow_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, n, most):
    fps = [(i, slow_fingerprint(t, n)) for i, t in rows]
    comp = {i: i for i, _ in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (a, x), (b, y) in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= most:
            lo, hi = sorted((find(a), find(b)))
            comp[hi] = lo
    return {i: (f"{x:016x}", find(i)) for i, x in fps}


def test_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents, shingle=3).collect()}
    assert got == brute(rows, 3, 2)


def test_full_buckets_take_the_exact_way(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << (i % 64)) ^ (1 << (i * 7 % 64)) for i in range(60)] + [base ^ 0xFFFF0000FFFF0000]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp0 long")
    found = {frozenset((r.a, r.b)) for r in simhash.links(nodes, 1, simhash.segments(1, 2), 2, bucket_limit=2).collect()}
    near = {frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(enumerate(fps), 2) if ((x ^ y) & (2**64 - 1)).bit_count() <= 2}
    assert found <= near

    def groups(pairs):
        comp = dict(zip(range(len(fps)), range(len(fps))))
        for _ in fps:
            for p in map(tuple, pairs):
                comp[p[0]] = comp[p[1]] = min(comp[p[0]], comp[p[1]])
        return comp

    assert groups(found) == groups(near)


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd, shingle=3).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert len(by[1]) == 1 and {c for _, c in by[1]} == {1}
    assert {c for _, c in by[None]} == {1, 2}  # null ids take their fingerprint's component
    assert simhash.near_duplicates(empty).collect() == []


def test_wide_fingerprints_find_near_copies(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(400)]
    near = [*words[:200], "edited", *words[201:]]
    other = [f"v{i * 104729 % 4999}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((words, near, other))], "doc_id long, text string")
    got = simhash.near_duplicates(docs, shingle=5, width=12, cut_into=24, bits=28, delete=14, max_diff=124)
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 2}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_full_buckets_lose_no_link_of_wide_fingerprints(spark):
    """Near copies that meet only in a bucket whose smallest member is another text."""
    rng = np.random.default_rng(5)
    fps = [rng.integers(0, 2**64, 12, dtype=np.uint64) for _ in range(40)]
    for x in fps:
        x[0] = (x[0] >> np.uint64(28) << np.uint64(28)) | np.uint64(0x5A5A5A5)
    cuts = simhash.segments(12, 24, 28)
    for x in fps[1:4]:  # a copy with four other bits in each segment but the first, 92 in all
        x = x.copy()
        for w, first, _ in cuts[1:]:
            for b in range(4):
                x[w] ^= np.uint64(1 << (first + 7 * b))
        fps.append(x)
    nodes = spark.createDataFrame([(i, *x.view(np.int64).tolist()) for i, x in enumerate(fps)], "node long, " + ", ".join(f"fp{j} long" for j in range(12)))
    for block in (1024, 9):
        simhash.BLOCK_NODES = block
        got = {(r.a, r.b) for r in simhash.links(nodes, 12, cuts, 124).collect()}
        assert got == {(1, 40), (2, 41), (3, 42)}
    simhash.BLOCK_NODES = 1024


def test_groups_are_checked_by_jaccard_similarity(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(300)]

    def changed(n):  # each word takes five of 296 shingles with it
        return " ".join("zz" if i % 40 == 20 and i // 40 < n else x for i, x in enumerate(words))

    texts = [" ".join(words), changed(6), changed(7).replace("zz", "yy")]
    rows = spark.createDataFrame([(7, i, bytearray(t.encode())) for i, t in enumerate(texts)], "component long, node long, text binary")
    for block in (1 << 20, 1000):
        simhash.BLOCK_BYTES = block
        assert {(r.a, r.b) for r in simhash.similar(rows, 5, 0.8).collect()} == {(0, 1)}
    simhash.BLOCK_BYTES = 1 << 20
    docs = spark.createDataFrame([(i, changed(n)) for i, n in enumerate((0, 4, 7))], "doc_id long, text string")
    found = [simhash.near_duplicates(docs.where("doc_id <> 1"), shingle=5, width=12, cut_into=96, bits=8, max_diff=200, jaccard=j).collect() for j in (None, 0.8)]
    assert [sorted({r.component_id for r in x}) for x in found] == [[0], [0, 2]]
    got = simhash.near_duplicates(docs.where("doc_id < 2"), shingle=5, width=12, cut_into=24, bits=28, delete=14, max_diff=148, jaccard=0.8)
    assert {r.component_id for r in got.collect()} == {0}


def jaccard(a, b, n=5):
    x, y = ({tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def joined(pairs, nodes):
    comp = {n: n for n in nodes}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        comp[hi] = lo
    return {n: find(n) for n in nodes}


def test_large_groups_lose_no_link(spark):
    """A drifting chain and a few strangers in one group that takes stars and blocks, against all pairs."""
    rng = np.random.default_rng(8)
    words, texts = [f"w{i}" for i in range(120)], []
    for i in range(70):
        words[rng.integers(0, 120)] = f"n{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"s{k}-{i}" for i in range(100)) for k in range(5)] + [""]
    order = rng.permutation(len(texts)).tolist()
    rows = spark.createDataFrame([(3, n, bytearray(texts[t].encode())) for n, t in enumerate(order)], "component long, node long, text binary")
    want = joined([(a, b) for a, b in itertools.combinations(range(len(order)), 2) if jaccard(texts[order[a]], texts[order[b]]) >= 0.8], range(len(order)))
    for block, stars in ((1 << 20, 4), (3000, 4), (3000, 1)):
        simhash.BLOCK_BYTES, simhash.STARS = block, stars
        found = [(r.a, r.b) for r in simhash.similar(rows, 5, 0.8).collect()]
        assert joined(found, range(len(order))) == want and len(set(want.values())) > 5
    simhash.BLOCK_BYTES, simhash.STARS = 1 << 20, 4


def test_recall_of_the_pipelines_search(spark):
    """At least nine of ten isolated pairs of each band of similarity are linked, and none below 0.8."""
    rng, bands, texts = np.random.default_rng(4), {0.7: [], 0.8: [], 0.85: [], 0.9: []}, []
    while any(len(x) < (20 if b == 0.7 else 60) for b, x in bands.items()):
        n = int(rng.integers(60, 500))
        words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        other, k = list(words), int(rng.integers(1, max(2, n // 8)))
        if rng.random() < 0.5:
            at = int(rng.integers(0, n - k))
            other[at : at + k] = [f"x{x}" for x in rng.integers(0, 10**6, k)]
        else:
            for at in rng.integers(0, n, max(1, k // 3)):
                other[at] = f"x{rng.integers(0, 10**6)}"
        a, b = " ".join(words), " ".join(other)
        j = jaccard(a, b)
        band = max((x for x in bands if x <= j), default=None)
        if band is not None and j < 1 and not 0.78 < j < 0.8 and len(bands[band]) < 60:
            bands[band].append(len(texts))
            texts += [a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import corpus_pipeline

    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()}
    found = {b: sum(got[i] == got[i + 1] for i in at) / len(at) for b, at in bands.items()}
    assert found[0.7] == 0 and min(v for b, v in found.items() if b >= 0.8) >= 0.9, found
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_rows_without_an_id_link_both_sides(spark):
    import xxhash

    def bits(text):
        return simhash.fingerprint(text.encode().lower().split(), 3)[0]

    first = "w0 w1 w2"
    h = xxhash.xxh64_intdigest(first.encode(), 42)
    assert int(bits(first)) == h
    rows = [(1, h), (None, h ^ 3), (2, h ^ 15), (None, h ^ (255 << 20))]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    made = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fp0 long")
    original, simhash.fingerprints = simhash.fingerprints, lambda *a, **k: made.selectExpr("doc_id", "cast(null AS binary) AS words", "fp0")
    try:
        got = simhash.near_duplicates(made, id_col="doc_id", text_col="fp0", shingle=3).collect()
    finally:
        simhash.fingerprints = original
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 1)]


def test_links_of_a_large_group_grow_with_its_members(spark):
    """Near copies that all meet each other: the links are a few stars, not the pairs, and connect the same."""
    rng = np.random.default_rng(11)
    base, n = rng.integers(0, 2**63, 12, dtype=np.uint64), 240
    fps = np.tile(base, (n, 1))
    for i in range(1, n):
        for bit in rng.choice(768, 40, replace=False):
            fps[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    fps = np.vstack([fps, rng.integers(0, 2**63, (5, 12), dtype=np.uint64)])
    nodes = spark.createDataFrame([(i, *map(int, x.view(np.int64))) for i, x in enumerate(fps)], "node long, " + ", ".join(f"fp{j} long" for j in range(12)))
    got = [(r.a, r.b) for r in simhash.links(nodes, 12, simhash.segments(12, 36, 25), 148).collect()]
    assert joined(got, range(n + 5)) == {i: 0 if i < n else i for i in range(n + 5)}
    assert len(set(got)) < 5 * n


def test_wide_index_is_made_a_few_segments_at_a_time(spark):
    """No step makes the variants of all segments at once; links across any segment are found all the same."""
    rng = np.random.default_rng(12)
    cuts = simhash.segments(12, 36, 25)
    fps, want = [], {}
    for s, (w, first, bits) in enumerate(cuts):  # a pair for each segment, equal in that segment alone
        a = rng.integers(0, 2**63, 12, dtype=np.uint64)
        b = a.copy()
        for v, f, n in cuts:
            if (v, f) != (w, first):
                for bit in rng.choice(n, 3, replace=False):
                    if v != w or not first <= f + bit < first + bits:
                        b[v] ^= np.uint64(1) << np.uint64(f + bit)
        fps += [a, b]
        want |= {2 * s: 2 * s, 2 * s + 1: 2 * s}
    nodes = spark.createDataFrame([(i, *map(int, x.view(np.int64))) for i, x in enumerate(fps)], "node long, " + ", ".join(f"fp{j} long" for j in range(12)))
    asked, original = [], simhash.variants
    simhash.variants = lambda n, c, part=None: asked.append(len(c) if part is None else len(part)) or original(n, c, part)
    try:
        got = [(r.a, r.b) for r in simhash.links(nodes, 12, cuts, 148).collect()]
    finally:
        simhash.variants = original
    assert joined(got, range(len(fps))) == want
    assert max(asked) <= simhash.PASS < len(cuts)
