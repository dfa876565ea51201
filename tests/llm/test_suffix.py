import hashlib

import pytest
from pyspark.sql import functions as F

from gridjobs.llm import suffix


def brute(texts, n):
    seen, covered = {}, []
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                flags[i : i + n] = b"\x01" * n
        covered.append(flags)
    return [(len(t), sum(f), sum(1 for i, x in enumerate(f) if x and (i == 0 or not f[i - 1])), hashlib.sha256(bytes(c for c, x in zip(t, f) if not x)).hexdigest()) for t, f in zip(texts, covered)]


def digests(found):
    return {r.doc_id: (r.n_bytes, r.n_bytes - r.k, r.s, r.h) for r in found.select("doc_id", "n_bytes", F.length("kept").alias("k"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h")).collect()}


def test_matches_brute_force(spark, documents):
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.select("doc_id", "text").collect()]
    want = dict(zip([i for i, _ in rows], brute([t for _, t in rows], 400)))
    assert digests(suffix.remove_repeats(documents)) == want


@pytest.mark.parametrize("length, gram, start", [(20, 12, 5), (30, 8, 10)])
def test_short_lengths_and_periodic_texts(spark, length, gram, start):
    texts = ["abcabcabc" * 20, "x" * 100, "the quick brown fox jumps over the lazy dog and runs away", "a quick brown fox jumps over the lazy dog, then sleeps", "q" * 19, "", "xyzzy" * 3 + "the quick brown fox jumps over" + "plugh" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute([t.encode() for t in texts], length)))
    assert digests(suffix.remove_repeats(docs, length=length, gram=gram, start=start)) == want


def test_blocks_of_long_texts(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(500))
    docs = spark.createDataFrame([(0, t + "UNIQUE" + t[100:400])], "doc_id long, text string")
    want = dict(enumerate(brute([(t + "UNIQUE" + t[100:400]).encode()], 40)))
    assert digests(suffix.remove_repeats(docs, length=40, gram=20, start=10, block=64)) == want


def test_odd_rows(odd, empty):
    got = suffix.remove_repeats(odd, keep=["lang"], as_text=True).collect()
    assert len(got) == odd.count()
    assert all(r.kept == "" and r.removed == [] for r in got if r.doc_id in (2, 3))
    assert next(r for r in got if r.doc_id == 7).kept == "12345 !!!"
    assert suffix.remove_repeats(empty).collect() == []


def test_repeated_rows_are_copies(spark):
    t = "".join(chr(97 + i * i * 7 % 26) for i in range(450))
    docs = spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id long, text string")
    got = suffix.remove_repeats(docs).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(1, 0), (1, 0), (2, 5)]


def test_query_and_its_sql_agree(spark, documents, tmp_path):
    import duckdb

    from gridjobs.llm.queries import oracle_sql, queries

    some = documents.where("doc_id < 40").select("doc_id", "text")
    passage = "".join(chr(97 + i * i % 23) for i in range(400))
    odd = [(-1, None), (-2, ""), (-3, "é" * 300), (-4, "x" * 900), (-5, passage + passage), (None, "tail " + passage), (-5, "y" * 399)]
    some.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op10_suffix"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle_sql()["op10_suffix"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
