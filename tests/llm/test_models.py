import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from gridjobs.llm import langid, lattice, quality, toxicity

SMALL = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def auc(rows):
    """Chance that a row of class 1 scores over one of class 0; rows: (class, score)."""
    ones, zeros = ([s for y, s in rows if y == k] for k in (1, 0))
    assert len(ones) > 5 and len(zeros) > 5
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def held(k, r):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == r


def test_toxicity_learns_sentences_from_document_labels():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    bags, y = [], []
    for i in range(300):
        sent = [[str(x) for x in rng.choice(words, 6)] for _ in range(4)]
        if i % 3 == 0:
            sent[int(rng.integers(4))][2] = "awful"
        bags.append([[f for w in s for f in toxicity.word_features(w)] for s in sent])
        y.append(int(i % 3 == 0))
    m = toxicity.NoisyOr.fit(bags, np.array(y))
    p, found = m.score("w1 w2 w3. w4 awful w5! w6 w7")
    assert p > 0.5 and [x["sentence"] for x in found] == [1]
    assert m.score("w1 w2 w3. w4 w5! w6 w7")[0] < 0.5
    assert m.score(None) == (0.0, []) and m.score("") == (0.0, [])


def test_toxicity_on_documents(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.learn(docs.where(~held(5, 0)), labels)
    got = [(r.toxic, r.score) for r in toxicity.score(docs, model).join(labels, "doc_id").where(held(5, 0)).collect()]
    assert auc(got) > 0.8  # a constant answer has 0.5
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert toxicity.score(empty, model).collect() == []
    assert all(r.score == 0 for r in toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).collect())


def test_models_do_not_depend_on_partitions(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    a, b = (toxicity.learn(docs.repartition(n), labels, max_docs=200) for n in (3, 7))
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias and (a.slope, a.shift) == (b.slope, b.shift)
    a, b = (langid.learn(docs.repartition(n), per_lang=25) for n in (3, 7))
    assert a.langs == b.langs and np.allclose(a.weights, b.weights) and np.allclose(a.trust, b.trust)


def test_signs_are_no_letters_and_rare_languages_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 20) * 3} {chr(98 + i % 20) * 4} word", f"l{i % 20:02d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, per_lang=10)
    assert len(model.langs) == 20
    odd = spark.createDataFrame([(0, "½ ² ①"), (1, "12 _ !"), (2, "ⅷ"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und"


def test_codewords_lie_apart():
    for n in (2, 3, 4, 7, 20):
        code = langid.codewords(n, 15)
        assert len(code) == n and min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2)) >= (1 if n == 2 else 2)


def test_language_on_documents(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(docs.where(~held(4, 2)), per_lang=100)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held(4, 2)).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == rows[7].lang_pred == "und"
    assert rows[5].lang_pred in model.langs and 0 <= rows[5].score <= 1
    assert langid.identify(empty, model).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}


def marked(n, seed, spark):
    """Documents whose source tells the class nine times in ten and whose words tell it too, with few labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(2))
        own = [f"{'good' if y else 'bad'}{rng.integers(60)}" if rng.random() < 0.35 else f"w{rng.integers(400)}" for _ in range(25)]
        rows.append((i, " ".join(own), "en", f"s{y}" if rng.random() < 0.95 else "s?", 100, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, y int")
    return docs, docs.where("doc_id % 25 = 0").select("doc_id", F.col("y").alias("quality"))


def test_exchange_of_labels_helps(spark):
    docs, labels = marked(1000, 1, spark)
    right = {}
    for rounds in (0, 3):
        model = quality.learn(docs, labels, rounds=rounds, per_round=60, sure=0.7)
        got = quality.score(docs.where("doc_id % 25 <> 0"), model).join(docs.select("doc_id", "y"), "doc_id")
        right[rounds] = got.agg(F.avg(((F.col("text_score") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
    assert right[3] > right[0] + 0.02 and right[3] > 0.9, right


def test_quality_does_not_depend_on_partitions(spark):
    docs, labels = marked(300, 2, spark)
    models = [quality.learn(docs.repartition(n), labels, rounds=2, per_round=20, sure=0.7) for n in (2, 5)]
    for a, b in zip(models[0].views, models[1].views):
        assert np.allclose(a.w, b.w) and abs(a.slope - b.slope) < 1e-9 and abs(a.shift - b.shift) < 1e-9


def test_quality_on_documents(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(docs.where(~held(5, 0)), labels)
    got = [(r.quality, r.score) for r in quality.score(docs, model).join(labels, "doc_id").where(held(5, 0)).collect()]
    assert auc(got) > 0.95
    caught = sum(s < 0.5 for y, s in got if not y)
    assert caught / sum(s < 0.5 for _, s in got) > 0.8 and caught >= 3
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(odd, quality.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, model).collect() == []


def slow_lattice(lat, word, k):
    u = "▁" + word
    total = 0.0
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(u)), n) for n in range(len(u))):
        p = 0.0
        for a, b in zip((0, *cuts), (*cuts, len(u))):
            j = lat.index.get(u[a:b])
            p += lat.rows[j][k] if j else -math.inf
        total += math.exp(p)
    return math.log10(total)


def test_forward_recursion_sums_all_segmentations():
    rng = np.random.default_rng(2)
    lat = lattice.Lattice(PIECES, rng.random((32000, 2)) * 5, np.array([10.0, 20.0]))
    words = ["a", "nation", "thenthe", "zqxj", "☃", "é"]
    got = lat.log10(words)
    for i, w in enumerate(words):
        for k in (0, 1):
            assert abs(got[i, k] - slow_lattice(lat, w, k)) < 1e-9
    assert np.isfinite(lat.log10(["x" * 5000, "𝒳𝒴"])).all()


def test_expected_counts_weigh_all_segmentations():
    rng = np.random.default_rng(3)
    lat = lattice.Lattice(PIECES, rng.random((32000, 1)) * 5, np.array([10.0]))
    words, counts = ["a", "nation", "thenthe", "☃a", "nation"], np.array([[1.0, 0.0], [2.0, 5.0], [0.5, 1.0], [3.0, 1.0], [1.0, 1.0]])
    got, want = lat.expected(words, counts), np.zeros((32000, 2))
    for w, c in zip(words, counts):
        u, ways = "▁" + w, []
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(u)), n) for n in range(len(u))):
            rows = [lat.index.get(u[a:b]) for a, b in zip((0, *cuts), (*cuts, len(u)))]
            if all(rows):
                ways.append((math.exp(sum(lat.rows[j][0] for j in rows)), rows))
        whole = sum(p for p, _ in ways)
        for p, rows in ways:
            for j in rows:
                for i in [lat.bytes[b] for b in lat.spelled[j].encode()] if j in lat.spelled else [j]:
                    want[i - 1] += p / whole * c
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert lattice.fit_frequent(PIECES, ["", "the", "then"], np.array([5.0, 9.0, 1.0]), 5.0).sum() > 10


def test_rounds_of_em_raise_the_likelihood():
    rng = np.random.default_rng(1)
    parts = ["tion", "er", "th", "on", "ing", "a", "re"]
    words = sorted({"".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(400)})
    counts = rng.integers(1, 50, len(words)).astype(float)
    scores = []
    for rounds in (0, 1, 3, 6):
        pieces = lattice.fit_frequent(PIECES, words, counts, 100.0, rounds)
        scores.append(float(lattice.Lattice(PIECES, pieces, np.array([100.0])).log10(words)[:, 0] @ counts))
    assert scores == sorted(scores) and scores[-1] > 0.8 * scores[0]


def test_classes_beyond_the_most_frequent_share_one(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MOST_CLASSES", 2)
    docs = spark.createDataFrame([(i, f"w{i % 7} x", "ab"[i % 2] if i < 40 else f"rare{i}") for i in range(60)], "doc_id long, text string, lang string")
    got = lattice.score(docs, F.lit(False), PIECES).collect()
    assert len(got) == 60 and all(math.isfinite(r.score) for r in got)


def test_language_model_counts(spark, documents, odd, empty):
    rule = held(7, 2)
    rows = lattice.score(documents, rule, PIECES).collect()
    texts = {r.doc_id: lattice.split((r.text or "").encode()) + [b""] for r in documents.collect()}
    out = {r.doc_id: r for r in rows}
    c = Counter(w for i, t in texts.items() if not out[i].held_out for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert r.score < 0
    got = lattice.score(odd, rule, PIECES).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert lattice.score(empty, rule, PIECES).collect() == []
    none = lattice.score(odd, F.lit(True), PIECES).collect()
    assert all(r.base_score == 0 and math.isfinite(r.score) for r in none)


def test_score_is_the_sum_over_segmentations_of_the_text(spark, monkeypatch):
    """The whole score from counts, weights and all segmentations of each word, on short texts of two languages."""
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "le chat chat", "fr"), (3, "cat chat", None), (4, "", "en")], "doc_id long, text string, lang string")
    seen = []
    own = lattice.Lattice.__init__
    monkeypatch.setattr(lattice.Lattice, "__init__", lambda self, *a: (own(self, *a), seen.append(self))[0])
    got = {r.doc_id: r for r in lattice.score(docs, F.lit(False), PIECES).collect()}
    lat, share = seen[-1], np.array([2, 1, 1]) / 4
    for i, text in {1: "the cat", 2: "le chat chat", 3: "cat chat", 4: ""}.items():
        each = [share[k] * 10 ** (lat.end[k] + sum(slow_lattice(lat, w, k) for w in text.split())) for k in range(3)]
        assert abs(got[i].score - math.log10(sum(each))) < 1e-9
        assert got[i].mixed_score < 0
    assert (10**lat.end < 1).all()


def test_rare_words_join_as_the_frequent_ones(spark, documents, monkeypatch):
    rule = held(7, 2)
    want = {r.doc_id: r.score for r in lattice.score(documents, rule, PIECES).collect()}
    monkeypatch.setattr(lattice, "FREQUENT", 40)
    got = {r.doc_id: r.score for r in lattice.score(documents, rule, PIECES).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
