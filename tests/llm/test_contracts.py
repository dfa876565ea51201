"""The queries' columns, models against plain re-computation, and repeated rows that must not change a model."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.llm import langid, quality, toxicity
from gridjobs.llm.queries import queries

SF = "/root/testdata/sf0.001"
TEXTS = ["One two. You awful fool! Three\nfour five", "", None, " \n\t ", "Ünïcode ☃ text, again. again!", "12345 !!!", "a" * 50 + " b" * 3000]

COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_lattice": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_avi": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op8_slots": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_pack": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10_suffix": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}
FOLD = {"op2_toxicity": (5, 0), "op3_language": (4, 2), "op5_lattice": (7, 2)}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_returns_the_contract(spark, documents, name):
    out = queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    ids = {r.doc_id for r in documents.collect()}
    assert {r.doc_id for r in rows} == ids and (name == "op9_pack" or len(rows) == len(ids))
    if name in FOLD:
        k, rest = FOLD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == rest) for r in rows)
    if "predicted" in kinds:
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_scores_equal_plain_sums(spark):
    rng = np.random.default_rng(1)
    model = toxicity.NoisyOr(rng.normal(scale=0.4, size=toxicity.BUCKETS).astype(np.float32), -1.0, 0.8, -0.3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        none = 1.0
        for words in toxicity.sentences(TEXTS[r.doc_id]):
            z = -1.0 + sum(float(model.weights[f]) for w in words for f in toxicity.word_features(w))
            none *= 1 - min(1 / (1 + math.exp(-max(z, -700))), 1 - 1e-12)
        p = min(max(1 - none, 1e-12), 1 - 1e-12)
        want = 0.0 if none == 1.0 else 1 / (1 + math.exp(-(0.8 * math.log(p / (1 - p)) - 0.3)))
        assert r.score == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_language_scores_equal_plain_sums(spark):
    rng = np.random.default_rng(2)
    langs, code = ["de", "en", "fr"], langid.codewords(3, 15)
    bits = code.shape[1]
    model = langid.OutputCode(langs, code, rng.normal(size=(langid.BUCKETS, bits)).astype(np.float32), rng.normal(size=bits), np.abs(rng.normal(size=bits)))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in langid.identify(docs, model).collect():
        words = langid._WORD.findall((TEXTS[r.doc_id] or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        f = np.mean([np.mean([model.weights[g] for g in langid.word_grams(w)], 0) for w in words], 0) + model.bias
        loss = [sum(t * math.log1p(math.exp(-c * x)) for c, x, t in zip(row, f, model.trust)) for row in code]
        share = 1 / sum(math.exp(min(loss) - x) for x in loss)
        assert r.lang_pred == langs[int(np.argmin(loss))] and r.score == pytest.approx(share, rel=1e-4)


def test_quality_scores_equal_plain_sums(spark):
    rng = np.random.default_rng(3)
    model = quality.CoTrained(rng.random((50, quality.FORMS)), rng.random(50) * 100)
    for v in model.views:
        v.w, v.b, v.slope, v.shift = rng.normal(scale=0.3, size=len(v.w)).astype(np.float32), 0.2, 0.9, -0.1
    model.prior = 0.4
    meta = [("s1", "en", 10), (None, None, None), ("s2", "de", 50)]
    docs = spark.createDataFrame([(i, t, *meta[i % 3]) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string, n_chars long")
    squash = lambda z: 1 / (1 + math.exp(-z))
    for r in quality.score(docs, model).collect():
        form, words = quality.text_features((TEXTS[r.doc_id] or "").encode())
        text = sum(float(model.views[0].w[i]) for i in words) * 4 / math.sqrt(max(1, len(words)))
        text += sum(float(model.views[0].w[quality.WORDS + k * quality.BINS + sum(form[k] >= e for e in model.edges[:, k])]) for k in range(quality.FORMS))
        source, lang, chars = meta[r.doc_id % 3]
        at = [0 if v is None else zlib.crc32(v.encode()) % (quality.VALUES - 1) + 1 for v in (source, lang)]
        places = [at[0], quality.VALUES + at[1], 2 * quality.VALUES + (quality.BINS if chars is None else sum(chars >= e for e in model.char_edges))]
        a, b = (0.9 * (x + 0.2) - 0.1 for x in (text, sum(float(model.views[1].w[i]) for i in places)))
        assert (r.score, r.text_score, r.meta_score) == pytest.approx((squash(a + b - 0.4), squash(a), squash(b)), rel=1e-4)


def test_an_id_repeated_many_times_counts_once(spark, documents, labels):
    docs = documents.where("doc_id < 120")
    own = docs.where("doc_id < 3")
    many = docs
    for _ in range(20):
        many = many.unionByName(own)
    a, b = (toxicity.learn(d, labels) for d in (docs, many))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)
    a, b = (langid.learn(d, per_lang=20) for d in (docs, many))
    assert np.allclose(a.weights, b.weights) and a.langs == b.langs
    a, b = (quality.learn(d, labels, rounds=1) for d in (docs, many))
    assert np.allclose(a.views[0].w, b.views[0].w) and a.prior == b.prior


def test_a_labelled_id_with_many_texts_stays_within_the_bound(spark, monkeypatch):
    rows = [(1, f"good text {i}") for i in range(400)] + [(2, f"bad text {i}") for i in range(30)]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    sizes, fit = [], toxicity.NoisyOr.fit.__func__
    monkeypatch.setattr(toxicity.NoisyOr, "fit", classmethod(lambda cls, bags, y, *a: (sizes.append(len(y)), fit(cls, bags, y, *a))[1]))
    toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_docs=50)
    assert 0 < sizes[0] <= 100


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gridjobs.llm.common import scratch_path

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077", applicationId="x")), "a")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,512]", applicationId="x")), "a")
