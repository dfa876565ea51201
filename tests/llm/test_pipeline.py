from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == P.COLUMNS
        assert 0 < out.count() <= docs.count()
        assert stage(spark, empty, SF).count() == 0
    assert stage(spark, odd, SF).count() <= odd.count()


def test_odd_rows_pass_every_stage(spark, odd, empty):
    for name, stage in P.STAGES:
        assert stage(spark, odd, SF).count() >= 1
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_leaves_one_of_each_group(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(300)]
    near = " ".join([*words[:100], "edited", *words[101:]])
    rows = [(5, " ".join(words)), (3, near), (9, near), (9, near), (4, " ".join(f"v{i}" for i in range(300))), (None, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in P.near_duplicates(spark, docs, SF).collect()) == ["3", "4", "None"]


def test_rows_without_an_id_and_ids_of_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first().text
    rows = [(None, a), (None, a), (None, a + " more"), (2, b), (2, c), (1, b), (None, "before " + leak), (4, "before " + leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs.where(~F.col("text").startswith("before")), SF).collect()]
    assert len(kept) == 3 and {(1, b), (2, c)} < set(kept)
    assert [i for i, _ in kept].count(None) == 1
    clean = P.no_benchmark_leaks(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted(rows[:6], key=str)


def test_passages_of_over_fifty_words_go(spark):
    """Short words, so that 51 are far under 400 bytes; white space between them does not matter, 50 words stay."""
    def own(tag):
        return [f"{tag}{i}" for i in range(60)]

    w = [f"p{i}" for i in range(51)]
    texts = [[*own("a"), *w, *own("A")], [*own("b"), *w, *own("B")], [*own("c"), *w[:50], *own("C")]]
    rows = [(i, (" ", "  ", "\n")[i].join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.repeated_passages(spark, docs, SF).collect()}
    assert {i: r.text.split() for i, r in got.items()} == {0: own("a") + own("A"), 1: own("b") + own("B"), 2: texts[2]}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_run_packs_what_is_left(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
