import json
import os

import pytest
from pyspark.sql import functions as F

from gridjobs import registry, schemas
from gridjobs.session import scratch_path
from gridjobs.sources import archives, payloads, published, sinks, store, text

LOAD = "ts_utc timestamp, ba string, load_mw double"


def load(spark, rows):
    return spark.createDataFrame(rows, "ts_utc string, ba string, load_mw double").withColumn("ts_utc", F.to_timestamp("ts_utc"))


ROWS = [("2024-01-15 00:00:00", "PJM", 80000.0), ("2024-01-15 01:00:00", "PJM", 78000.0), ("2024-02-01 00:00:00", "PJM", 81000.0)]


def files(spark, path):
    return [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]


def test_append_scan_and_layout(spark):
    path = scratch_path(spark, "t")
    assert store.scan(spark, path, LOAD).count() == 0
    store.append(load(spark, []), path)
    store.append(load(spark, ROWS), path)
    out = store.scan(spark, path, LOAD)
    assert out.count() == 3 and {"year", "month"} <= set(out.columns)
    assert {f.split("/")[-2] for f in files(spark, path)} == {"month=01", "month=02"}
    with pytest.raises(ValueError):
        store.append(load(spark, ROWS), path, "when")


def test_compaction_keeps_duplicates(spark):
    path, to = scratch_path(spark, "t"), scratch_path(spark, "t")
    for _ in range(3):
        store.append(load(spark, ROWS), path)
    store.compact(spark, path, to, LOAD)
    assert store.scan(spark, to, LOAD).count() == 9 and len(files(spark, to)) == 2


def test_manifest_skips_known_keys(spark):
    path = scratch_path(spark, "m")
    store.record(spark, path, spark.createDataFrame([("eia-930", "PJM-2024-01", 744, "x")], "source string, key string, n_rows long, sha256 string").withColumn("fetched_at", F.current_timestamp()))
    batches = spark.createDataFrame([("eia-930", "PJM-2024-01"), ("eia-930", "PJM-2024-02"), ("other", "PJM-2024-01")], "source string, key string")
    assert {(r.source, r.key) for r in store.skip_known(batches, spark.read.parquet(path)).collect()} == {("eia-930", "PJM-2024-02"), ("other", "PJM-2024-01")}


def test_content_hash_ignores_order(spark):
    a, b = load(spark, ROWS), load(spark, ROWS[::-1])
    assert store.content_hash(a).collect() == store.content_hash(b).collect()
    assert store.content_hash(a).first().sha256 != store.content_hash(load(spark, ROWS[:2])).first().sha256


def test_upsert_takes_the_latest_of_touched_months(spark):
    path, to = scratch_path(spark, "u"), scratch_path(spark, "u")
    kind = LOAD + ", as_of timestamp"
    old = load(spark, ROWS).withColumn("as_of", F.lit("2024-03-01").cast("timestamp"))
    store.append(old, path)
    batch = load(spark, [("2024-01-15 00:00:00", "PJM", 1.0)]).withColumn("as_of", F.lit("2024-03-02").cast("timestamp"))
    store.upsert(spark, batch, path, to, kind)
    assert sorted(r.load_mw for r in store.scan(spark, to, kind).collect()) == [1.0, 78000.0]


def test_enforce(spark):
    df = spark.createDataFrame([(1, "PJM", "2024-01-01", "s", "2024-01-01", 5)], "load_mw int, ba string, as_of string, source string, ts_utc string, more int")
    out = schemas.enforce(df, schemas.LOAD)
    assert out.columns == ["ts_utc", "ba", "load_mw", "source", "as_of"] and dict(out.dtypes)["load_mw"] == "double"
    with pytest.raises(ValueError, match="missing columns: as_of, load_mw, source"):
        schemas.enforce(df.select("ts_utc", "ba"), schemas.LOAD)


def test_registry(spark):
    reg = registry.registry(spark)
    assert reg.count() == 67 and registry.select(reg, has_demand=True).count() == 53 and registry.select(reg, is_rto=True).count() == 7
    assert {r.interconnect for r in reg.collect()} == {"Eastern", "Western", "Texas"}
    assert [r.code for r in registry.select(reg, ["ciso", "PJM", "nope"]).collect()] == ["PJM", "CISO"]
    centres = registry.load_centres(spark, reg).groupBy("ba").count()
    assert centres.count() == 67 and centres.where("ba = 'PJM'").first()["count"] == 6


def values(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_pages_with_bad_numbers(spark):
    page = json.dumps({"response": {"data": [{"period": "2024-01-01T05", "respondent": "PJM", "value": "7.5"}, {"period": "2024-01-01T06", "respondent": "PJM", "value": None}, {"period": "2024-01-01T07", "respondent": "PJM", "value": "n/a"}]}})
    rows = payloads.eia_load(values(spark, page)).orderBy("ts_utc").collect()
    assert [r.load_mw for r in rows] == [7.5, None, None] and str(rows[0].ts_utc) == "2024-01-01 05:00:00"


def test_parallel_arrays_drop_nulls(spark):
    page = json.dumps([{"data": [{"VALUES": {"DATES": ["01/02/2024 03:00:00", "01/02/2024 04:00:00"], "DATA": [1.0, None]}}]}])
    assert [(str(r.ts_utc), r.load_mw) for r in payloads.parallel_arrays(values(spark, page)).collect()] == [("2024-01-02 03:00:00", 1.0)]


def test_asos_nulls_and_means(spark):
    lines = values(spark, "station,valid,tmpf", "DCA,2024-01-01 00:10,32.0", "DCA,2024-01-01 00:50,50.0", "DCA,2024-01-01 01:10,M", "DCA,2024-01-01 01:20,T", "DCA,2024-01-01 02:00,")
    assert {str(r.ts_utc)[11:13]: r.temp_c for r in payloads.asos_hourly(lines).collect()} == {"00": 5.0, "01": None, "02": None}


def test_zip_members(spark, tmp_path):
    def rows(members, chunk=1):
        archives.write_archive(f"{tmp_path}/{len(os.listdir(tmp_path))}/in/p.zip", members)
        return archives.read_zip_csv(spark, f"file:{tmp_path}/{len(os.listdir(tmp_path)) - 1}", chunk)

    got = rows({"prices.CSV": "when,hub,usd\n1999-12-31,west,7\n1999-12-31,east,", "notes.md": "no table", "empty.csv": "\n\n", "bare.csv": "when,hub,usd", "deep/more.csv": 'a\n"x\ny"'})
    assert got.rdd.getNumPartitions() == 4  # a partition a CSV member
    assert [(r.member, json.loads(r.row)) for r in got.collect()] == [("prices.CSV", {"when": "1999-12-31", "hub": hub, "usd": usd}) for hub, usd in (("west", "7"), ("east", ""))] + [("deep/more.csv", {"a": "x\ny"})]
    assert all(r.path.startswith(f"file:{tmp_path}") and r.path.endswith("/in/p.zip") for r in got.collect())
    catalog = spark.sql("SELECT 'p' AS doc_id, timestamp'2000-01-01' AS publish_date UNION ALL SELECT 'q', timestamp'2000-01-02'")
    frame = got.where("member = 'prices.CSV'").withColumn("path", F.lit("p"))
    assert {(r.doc_id, str(r.publish_date)) for r in payloads.report_rows(frame, catalog).collect()} == {("p", "2000-01-01 00:00:00")}
    for bad in ({"../a.csv": "x"}, {"/a.csv": "x"}, {f"{i}.csv": "a\n1" for i in range(65)}):
        with pytest.raises(Exception, match="unsafe|too many"):
            rows(bad).collect()
    os.mkdir(tmp_path / "none")
    assert archives.read_zip_csv(spark, f"{tmp_path}/none").collect() == []


def test_a_member_is_read_by_chunks(tmp_path):
    archives.write_archive(f"{tmp_path}/x.zip", {"a.csv": "n\n" + "\n".join(map(str, range(1000)))})
    reader = archives.ZipCsvReader(str(tmp_path), 64)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert max(b.num_rows for b in batches) == 64 and sum(b.num_rows for b in batches) == 1000


def test_catalog(spark):
    def doc(i, name, ext, when):
        return {"Document": {"DocID": i, "FriendlyName": name, "ConstructedName": "c", "Extension": ext, "PublishDate": when, "ReportName": "r", "ReportTypeID": "1", "ContentSize": "10"}}

    page = json.dumps({"ListDocsByRptTypeRes": {"DocumentList": [doc("111", "X_csv", "zip", "2026-01-02T00:00:00-06:00"), doc("222", "X_xml", "xml", "2026-01-03T00:00:00-06:00"), doc("333", "old", "csv", "2025-01-03T00:00:00-06:00")]}})
    assert [r.doc_id for r in payloads.doc_catalog(values(spark, page)).collect()] == ["111", "333"]
    assert [r.doc_id for r in payloads.doc_catalog(values(spark, page), since="2026-01-01", limit=1).collect()] == ["111"]
    assert payloads.doc_catalog(values(spark, page), csv_only=False).count() == 3


def test_storm_times(spark):
    rows = spark.createDataFrame([(1996, "28-APR-96 14:30:05"), (2024, "28-APR-24 14:30:00"), (2020, "junk")], "YEAR int, BEGIN_DATE_TIME string")
    assert [str(r.ts_utc) for r in payloads.storm_events(rows).collect()] == ["1996-04-28 14:30:05", "2024-04-28 14:30:00", "None"]
    assert str(payloads.storm_events(rows.drop("BEGIN_DATE_TIME")).first().ts_utc) == "1996-01-01 00:00:00"


def test_index_takes_the_newest_revision_of_a_year(spark):
    names = ["x_details_d1971_c19990102.csv.gz", "x_details_d1971_c20101112.csv.gz", "y_details_d1988_c20050607.csv.gz", "x_deaths_d1971_c20200101.csv.gz", "x_details_d1990_c20000101.txt"]
    page = "<ul>" + "".join(f'<li><a href="{n}">{n}</a></li>' for n in names) + "</ul>"
    assert {(r.year, r.revision) for r in payloads.latest_revisions(values(spark, page)).collect()} == {(1971, 20101112), (1988, 20050607)}


def test_grib_records(spark):
    lines = ["7:90:d=2031050418:HGT: 500 mb :anl:", "8:250:d=2031050418:RH:850 mb:anl:extra:fields", "9:300:d=2031050418::850 mb:anl:", "10:x:d=2031050418:RH:850 mb:anl:", "11:400:2031050418:RH:850 mb:anl:", "12:500:d=2031050418:RH:700 mb:anl"]
    records = payloads.grib_index(values(spark, *lines).withColumn("file", F.lit("f")))
    assert {(r.record_no, r.variable, r.level, r.byte_start, r.byte_end) for r in records.collect()} == {(7, "HGT", "500 mb", 90, 249), (8, "RH", "850 mb", 250, None)}
    assert payloads.find_record(records, "RH").first().record_no == 8
    assert payloads.find_record(records, "HGT", "500 mb").count() == 1 and payloads.find_record(records, "HGT", "2 mb").count() == 0


def test_date_windows(spark):
    def spans(start, end, days=None):
        rows = payloads.date_windows(spark.sql(f"SELECT timestamp'{start}' AS start, timestamp'{end}' AS end"), days)
        return [(str(r.w_start)[:10], str(r.w_end)[:10]) for r in rows.orderBy("w_start").collect()]

    assert spans("1999-12-20", "2000-01-09", 10) == [("1999-12-20", "1999-12-30"), ("1999-12-30", "2000-01-09")]
    assert spans("1999-12-20", "2000-01-10", 10)[-1] == ("2000-01-09", "2000-01-10")
    assert spans("2011-11-11", "2013-03-03") == [("2011-11-11", "2012-01-01"), ("2012-01-01", "2013-01-01"), ("2013-01-01", "2013-03-03")]
    assert spans("2000-01-01", "2000-01-01") == []


def test_union_ragged(spark):
    out = payloads.union_ragged([spark.sql("SELECT 1 AS a, 'x' AS b"), spark.sql("SELECT 2.5D AS a, 7 AS c"), spark.sql("SELECT 3 AS b")])
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "int"} and out.count() == 3


@pytest.mark.parametrize(
    "url, want",
    [("http://h/p?api_key=1&b=2", "http://h/p?api_key=REDACTED&b=2"), ("http://h/p?b=2&TOKEN=x#f", "http://h/p?b=2&TOKEN=REDACTED#f"), ("http://h/p", "http://h/p"), ("http://h/p?tokens=1", "http://h/p?tokens=1"), ("http://h/p?secret=1", "http://h/p?secret=REDACTED")],
)
def test_redact_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(text.redact_url(F.col("u"))).first()[0] == want


def test_redact_text(spark):
    def masked(x):
        return spark.createDataFrame([(x,)], "t string").select(text.redact_text(F.col("t"))).first()[0]

    assert masked('see Password=abc "x" apikey=z&q=1') == 'see Password=REDACTED "x" apikey=REDACTED&q=1'
    assert masked("a my_token=1\nsubscription-key='x' token= token=password=2") == "a my_token=REDACTED\nsubscription-key='x' token= token=REDACTED"
    assert masked("") == "" and masked("plain text & 'quotes'") == "plain text & 'quotes'" and masked(None) is None


class Crash(Exception):
    pass


def crash_after(step):
    def after(done):
        if done == step:
            raise Crash(step)

    return after


@pytest.mark.parametrize("step", ["data", "manifest"])
def test_write_through_survives_a_crash(spark, step):
    root = scratch_path(spark, "through")
    rows = spark.sql("SELECT 'PJM' AS ba, timestamp'2024-01-30' + make_interval(0,0,0,0,id) AS ts_utc, cast(id AS double) AS load_mw, 'eia' AS source, cast(id div 10 AS string) AS key FROM range(100)")
    kind = "ba string, ts_utc timestamp, load_mw double, source string, key string"
    published.write_through(rows.where("key < '3'"), root, "2024-02-01")
    with pytest.raises(Crash):
        published.write_through(rows, root, "2024-02-02", after=crash_after(step))
    seen = published.scan(spark, root, kind)
    assert seen.count() == 30 and published.manifest(spark, root).count() == 3  # nothing of the broken batch
    published.write_through(rows.where("key < '5'"), root, "2024-02-03")
    published.write_through(rows, root, "2024-02-04")
    assert published.write_through(rows, root, "2024-02-05") is None
    got = published.scan(spark, root, kind)
    assert sorted(r.load_mw for r in got.collect()) == [float(i) for i in range(100)]
    assert {(r.year, r.month) for r in got.collect()} == {(2024, 1), (2024, 2)}
    kept = published.manifest(spark, root).collect()
    assert sorted(r.key for r in kept) == [str(i) for i in range(10)] and {r.n_rows for r in kept} == {10}
    finished = {"data": {"2024-02-03", "2024-02-04"}, "manifest": {"2024-02-02"}}[step]  # a batch that was whole is finished
    assert {str(r.fetched_at)[:10] for r in kept} == {"2024-02-01"} | finished


def test_published_documents_change_at_once(spark):
    root = scratch_path(spark, "docs")
    points = spark.sql("SELECT ba, step, timestamp'2024-01-01' + make_interval(0,0,0,0,step) AS ts_utc, 1.0D AS lo, 2.0D AS median, 3.0D AS hi FROM range(3) t(step) CROSS JOIN (VALUES ('PJM'), ('A B')) v(ba)")
    docs = [sinks.forecast_docs(points, m, m) for m in ("1", "2", "3")]
    models = lambda: {r.ba: r.model for r in published.read_docs(spark, root, docs[0].schema).collect()}
    assert published.publish_docs(docs[0].limit(0), root) is None and not published.committed(spark, root)
    published.publish_docs(docs[0], root)
    for step in ("by_ba", "combined"):
        with pytest.raises(Crash):
            published.publish_docs(docs[1], root, after=crash_after(step))
        assert models() == {"PJM": "1", "A B": "1"}
    published.publish_docs(docs[2].where("ba = 'PJM'"), root)  # the whole second version is finished first
    assert models() == {"PJM": "3", "A B": "2"}
    assert published.publish_docs(docs[0].limit(0), root) is None and models() == {"PJM": "3", "A B": "2"}
    whole = json.loads(published.read_combined(spark, root).first()[0])
    assert [(f["ba"], f["model"], f["horizon"]) for f in whole["forecasts"]] == [("A B", "2", 3), ("PJM", "3", 3)]
    assert published.read_docs(spark, root, docs[0].schema, "PJM").count() == 1
    assert len(published.committed(spark, root)) == 2


def test_redact_text_equals_one_pattern_and_cuts_no_text_into_pieces(spark):
    import random
    import re

    rng = random.Random(7)
    parts = ["api_key", "APIKEY", "token", "access_token", "Subscription-Key", "password", "secret", "=", "=", "=", "&", " ", "\t", "\v", " ", '"', "'", "x", "é", "ſ", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    out = df.select("t", text.redact_text(F.col("t")).alias("got"))
    want = lambda x: re.sub(r"""(?ai)((?:api_key|apikey|token|subscription-key|access_token|password)=)[^\s&"']+""", r"\1REDACTED", x)
    assert all(r.got == (None if r.t is None else want(r.t)) for r in out.collect())
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()  # no array of a long text's pieces
