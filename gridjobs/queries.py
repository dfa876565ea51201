"""The registered queries, by operator name; their SQL is in ``oracles``.

Times are returned as text and derived doubles rounded to seven decimals, so that results compare by value.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import oracles, registry, schemas
from .functions import calendar
from .operators import blocks, conformal, joins, live, metrics, peers, series
from .plans import audit, jobs, regression
from .session import scratch_path, stored
from .sources import archives, payloads, published, sinks, store, text
from .streaming import jobs as streams
from .streaming import progress

K = 3.0  # the cleaning rule's width on the test tables
LOAD = "ba string, ts_utc timestamp, load_mw double"
REVISED = "ba string, ts_utc timestamp, load_mw double, as_of timestamp, tie bigint"
_QUERIES: dict = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def t(c: str = "ts_utc", name: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def r(c: str, name: str | None = None) -> Column:
    return F.round(c, 7).alias(name or c)


def filled(spark: SparkSession, d: str) -> DataFrame:
    return stored(series.row_index(series.fill(series.robust_clean(stored(A.load_hourly(spark, d), "load"), k=K))), "filled")


def prepared(spark: SparkSession, d: str, k: float = K):
    return jobs.prepare(A.load_hourly(spark, d), A.SPLITS, k)


def scored(spark: SparkSession, d: str):
    """(scored rows with a band, denominators, series, bounds) of the seasonal-naive test forecasts."""
    indexed, meta, denom = prepared(spark, d)
    rows, _ = jobs.naive_backtest(indexed, meta, denom)
    return jobs.with_band(rows), denom, indexed, meta


def temperatures(spark: SparkSession, d: str) -> DataFrame:
    """Load and temperature by hour, both filled, indexed."""
    both = joins.left_on_ts(A.load_hourly(spark, d), A.weather(spark, d))
    return stored(series.row_index(series.fill(series.fill(both), "temp_c")), "temperatures")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return joins.forecast_alignment(temperatures(spark, d), A.archived(spark, d))


def landed(spark: SparkSession, rows: DataFrame, what: str, text_: bool = True) -> DataFrame:
    """Write payload text to files and read it back, as a landing zone would."""
    path = scratch_path(spark, what)
    rows.write.text(path)
    return spark.read.text(path)


# --- sources and sinks -------------------------------------------------------------------------------------------


@query
def src_parquet_scan(spark, d):
    path = scratch_path(spark, "load")
    store.append(A.daily_orders(spark, d), path)
    few = store.scan(spark, path, LOAD).where(live.in_months(F.lit("1996-11-01").cast("timestamp"), F.lit("1997-02-01").cast("timestamp")))
    return few.select("ba", t(), "load_mw", "year", "month")


@query
def sink_partitioned_append(spark, d):
    path = scratch_path(spark, "orders")
    rows = A.daily_orders(spark, d)
    store.append(rows, path)
    store.append(rows.where("ts_utc >= timestamp'2001-01-01'"), path)
    return store.scan(spark, path, LOAD).groupBy("year", "month").agg(F.count("*").alias("n"), A.exact_sum("load_mw").alias("total"))


@query
def sink_compact_snapshot(spark, d):
    path, to = scratch_path(spark, "load"), scratch_path(spark, "compact")
    rows = A.load_hourly(spark, d)
    store.append(rows, path)
    store.append(rows, path)
    store.compact(spark, path, to, LOAD)
    return store.scan(spark, to, LOAD).groupBy("ba", "year", "month").agg(F.count("*").alias("n"), F.countDistinct("ts_utc").alias("hours"))


def _batches(spark, d):
    """One batch a day: (source, key, n_rows, sha256)."""
    rows = A.load_hourly(spark, d).withColumn("key", F.date_format("ts_utc", "yyyy-MM-dd"))
    return store.content_hash(rows, ["key"]).withColumn("source", F.lit("eia-930"))


@query
def ingest_manifest_record(spark, d):
    path = scratch_path(spark, "manifest")
    store.record(spark, path, _batches(spark, d).withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp")))
    return spark.read.parquet(path).select("source", "key", t("fetched_at"), "n_rows")


@query
def ingest_skip_known_keys(spark, d):
    batches = _batches(spark, d)
    return store.skip_known(batches, batches.where("day(to_date(key)) % 3 = 0")).select("source", "key", "n_rows")


@query
def ingest_write_through(spark, d):
    """Three overlapping fetches, the second of them broken off after its data: each key is stored and recorded once."""
    root = scratch_path(spark, "through")
    rows = A.load_hourly(spark, d).withColumn("source", F.lit("eia-930")).withColumn("key", F.date_format("ts_utc", "yyyy-MM-dd"))

    def stop(step: str) -> None:
        raise InterruptedError(step)

    published.write_through(rows.where("day(ts_utc) <= 10"), root, "2024-02-01 00:00:00")
    try:
        published.write_through(rows.where("day(ts_utc) <= 20"), root, "2024-02-02 00:00:00", after=stop)
    except InterruptedError:
        published.write_through(rows.where("day(ts_utc) BETWEEN 5 AND 20"), root, "2024-02-03 00:00:00")
    published.write_through(rows, root, "2024-02-04 00:00:00")
    stored_ = published.scan(spark, root, LOAD + ", source string, key string").groupBy("source", "key").agg(F.count("*").alias("n"), A.exact_sum("load_mw").alias("total"))
    return published.manifest(spark, root).join(stored_, ["source", "key"]).select("source", "key", t("fetched_at"), "n_rows", "n", "total")


@query
def ingest_content_hash(spark, d):
    a = _batches(spark, d)
    b = store.content_hash(A.load_hourly(spark, d).orderBy(F.desc("load_mw")).withColumn("key", F.date_format("ts_utc", "yyyy-MM-dd")), ["key"])
    return a.join(b.select("key", F.col("sha256").alias("again")), "key").select("key", "n_rows", (F.col("sha256") == F.col("again")).alias("same"), F.length("sha256").alias("digits"))


def _eia_pages(spark, d, extra=()):
    rows = A.grouped_load(spark, d) if not extra else A.generation(spark, d).groupBy("ba", "ts_utc", "fuel").agg(A.exact_sum("gen_mw").alias("load_mw"))
    item = F.struct(F.date_format("ts_utc", "yyyy-MM-dd'T'HH").alias("period"), F.col("ba").alias("respondent"), *extra, F.format_string("%.2f", "load_mw").alias("value"))
    pages = rows.groupBy("ba", F.to_date("ts_utc").alias("day")).agg(F.collect_list(item).alias("data"))
    return landed(spark, pages.select(F.to_json(F.struct(F.struct("data").alias("response"))).alias("value")), "pages")


@query
def src_eia_json_pages(spark, d):
    return payloads.eia_load(_eia_pages(spark, d)).select("ba", t(), "load_mw")


@query
def src_genmix_json_pages(spark, d):
    return payloads.eia_genmix(_eia_pages(spark, d, (F.col("fuel").alias("fueltype"),))).select("ba", t(), "fuel", "gen_mw")


@query
def src_parallel_arrays_json(spark, d):
    x = F.struct(F.date_format("ts_utc", "MM/dd/yyyy HH:mm:ss").alias("d"), F.when(F.pmod(F.hour("ts_utc"), F.lit(6)) != 0, F.col("load_mw")).alias("x"))
    pages = A.load_hourly(spark, d).groupBy("ba").agg(F.sort_array(F.collect_list(x)).alias("v"))
    body = F.to_json(F.array(F.struct(F.array(F.struct(F.struct(F.col("v.d").alias("DATES"), F.col("v.x").alias("DATA")).alias("VALUES"))).alias("data"))), {"ignoreNullFields": "false"})
    files = landed(spark, pages.select(F.concat_ws("\t", "ba", body).alias("value")), "arrays").select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].alias("ba"), F.col("p")[1].alias("value"))
    return payloads.parallel_arrays(files).select("ba", t(), "load_mw")


@query
def src_openmeteo_hourly_arrays(spark, d):
    w = A.observations(spark, d).groupBy("ba", F.date_trunc("hour", "ts").alias("ts_utc")).agg(F.max("f").alias("f"), F.min("f").alias("g"))
    x = F.struct(F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm").alias("a"), F.when(F.col("f") != 13, F.col("f")).alias("b"), F.col("g").alias("c"))
    pages = w.groupBy("ba").agg(F.sort_array(F.collect_list(x)).alias("v"))
    hourly = F.struct(F.col("v.a").alias("time"), F.col("v.b").alias("temperature_2m_gfs"), F.col("v.c").alias("wind_speed_100m"))
    body = F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"})
    files = landed(spark, pages.select(F.concat_ws("\t", "ba", body).alias("value")), "meteo").select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].alias("ba"), F.col("p")[1].alias("value"))
    return payloads.openmeteo_hourly(files, {"temp": "temperature_2m", "wind": "wind_speed_100m"}, "gfs").select("ba", t(), "temp", "wind")


@query
def src_asos_csv(spark, d):
    obs = A.observations(spark, d)
    cell = F.when(F.col("f") == 7, "M").when(F.col("f") == 8, "").otherwise(F.format_string("%.1f", "f"))
    lines = landed(spark, obs.select(F.concat_ws(",", "ba", F.date_format("ts", "yyyy-MM-dd HH:mm"), cell).alias("value")), "asos")
    return payloads.asos_hourly(lines).select("station", t(), r("temp_c"))


@query
def src_zip_csv(spark, d):
    """An archive for each series and day is written, and all are read back."""
    import pandas as pd

    root = scratch_path(spark, "archives")

    def pack(batches):
        for b in batches:
            for name, body in zip(b["name"], b["body"]):
                archives.write_archive(f"{root}/{name}.zip", {"a.csv": "ts,node,lmp\n" + body, "readme.txt": "not data", "blank.csv": " "})
            yield pd.DataFrame({"name": b["name"]})

    days = A.load_hourly(spark, d).groupBy(F.concat_ws("/", "ba", F.to_date("ts_utc")).alias("name")).agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(",", F.date_format("ts_utc", "yyyy-MM-dd HH:mm:ss"), "ba", F.format_string("%.2f", "load_mw"))))).alias("body"))
    days.mapInPandas(pack, "name string").write.format("noop").mode("overwrite").save()
    rows = archives.read_zip_csv(spark, root, 5).select(F.regexp_replace("path", r"^.*/([^/]+/[^/]+)[.]zip$", "$1").alias("path"), F.from_json("row", "ts string, node string, lmp string").alias("x"))
    return rows.select("path", F.col("x.ts").alias("ts"), F.col("x.lmp").cast("double").alias("lmp"))


def _catalog(spark, d):
    o = A.table(spark, d, "orders")
    doc = F.struct(F.col("o_orderkey").cast("string").alias("DocID"), F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "_CSV").otherwise("")).alias("FriendlyName"), F.lit("x").alias("ConstructedName"), F.when(F.col("o_orderstatus") == "O", "csv").otherwise("xml").alias("Extension"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("PublishDate"), F.lit("r").alias("ReportName"), F.lit("1").alias("ReportTypeID"), F.format_string("%d", F.floor("o_totalprice")).alias("ContentSize"))
    pages = o.groupBy("o_custkey").agg(F.collect_list(F.struct(doc.alias("Document"))).alias("DocumentList"))
    return landed(spark, pages.select(F.to_json(F.struct(F.struct("DocumentList").alias("ListDocsByRptTypeRes"))).alias("value")), "catalog")


@query
def src_doc_catalog(spark, d):
    return payloads.doc_catalog(_catalog(spark, d), since="2000-01-01", limit=500).select("doc_id", "friendly_name", "extension", t("publish_date"), "content_size")


@query
def src_storm_events_csv(spark, d):
    o = A.table(spark, d, "orders")
    text_ = F.when(F.pmod("o_orderkey", F.lit(10)) == 0, "bad").otherwise(F.upper(F.date_format(F.col("o_orderdate").cast("timestamp"), "dd-MMM-yy HH:mm:ss")))
    lines = landed(spark, o.select(F.concat_ws(",", "o_orderkey", F.year("o_orderdate"), text_).alias("value")), "storm")
    rows = lines.select(F.from_csv("value", "id bigint, YEAR int, BEGIN_DATE_TIME string").alias("x")).select("x.*")
    return payloads.storm_events(rows).select("id", t())


@query
def src_index_latest_revision(spark, d):
    o = A.table(spark, d, "orders")
    link = F.concat(F.lit('<a href="StormEvents_details-ftp_v1.0_d'), F.year("o_orderdate"), F.lit("_c"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('.csv.gz">x</a> <a href="StormEvents_locations-ftp_v1.0_d2030_c20300101.csv.gz">y</a>'))
    return payloads.latest_revisions(landed(spark, o.select(link.alias("value")), "index"))


@query
def src_station_daily_json(spark, d):
    o = A.table(spark, d, "orders")
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("o_orderstatus").alias("datatype"), F.col("o_custkey").cast("string").alias("station"), F.col("o_totalprice").alias("value"))
    pages = o.groupBy("o_custkey").agg(F.collect_list(item).alias("results"))
    return payloads.station_daily(landed(spark, pages.select(F.to_json(F.struct("results")).alias("value")), "station")).select(t(), "station", "datatype", "value", "source")


@query
def src_grib_idx_text(spark, d):
    i = A.table(spark, d, "lineitem")
    line = F.concat_ws(":", "l_linenumber", F.col("l_linenumber") * 524288 + F.col("l_quantity").cast("int"), F.concat(F.lit("d="), F.date_format("l_shipdate", "yyyyMMddHH")), F.when(F.col("l_returnflag") == "A", "TMP").otherwise("UGRD"), F.lit("2 m above ground"), F.lit("1 hour fcst"), F.lit(""))
    bad = F.when(F.col("l_linestatus") == "F", line).otherwise("not a record")
    files = landed(spark, i.select(F.concat_ws("\t", "l_orderkey", bad).alias("value")), "idx").select(F.split("value", "\t").alias("p")).select(F.col("p")[0].cast("bigint").alias("file"), F.col("p")[1].alias("value"))
    return payloads.grib_index(files)


@query
def src_union_ragged(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    p = A.table(spark, d, "part").select((F.col("p_partkey") + 0.5).cast("double").alias("key"), F.col("p_size").alias("size"))
    return payloads.union_ragged([c, s, p])


def _points(spark, d):
    """Forecast points (ba, step, ts_utc, lo, median, hi) from the last origin of each series' test span."""
    rows, _, indexed, _ = scored(spark, d)
    last = rows.groupBy("ba").agg(F.max("origin").alias("origin"))
    own = rows.join(last, ["ba", "origin"])
    return own.join(indexed.select("ba", "idx", "ts_utc"), ["ba", "idx"]).select("ba", "step", "ts_utc", F.col("q_lo").alias("lo"), F.col("q_mid").alias("median"), F.col("q_hi").alias("hi"))


@query
def sink_forecast_docs(spark, d):
    root = scratch_path(spark, "docs")
    first = sinks.forecast_docs(_points(spark, d), "seasonal-naive", "2024-01-30T00:00:00Z")
    published.publish_docs(first, root)
    published.publish_docs(sinks.forecast_docs(_points(spark, d).where("ba = 'view'"), "second", "2024-01-30T01:00:00Z"), root)
    published.publish_docs(first.limit(0), root)
    docs = published.read_docs(spark, root, first.schema)
    return docs.select("ba", "model", F.explode("points").alias("p")).select("ba", "model", F.col("p.step").cast("int").alias("step"), F.col("p.ts_utc").alias("ts_utc"), F.round("p.median_mw", 7).alias("median_mw"))


@query
def sink_forecast_csv(spark, d):
    path = scratch_path(spark, "csv")
    points = _points(spark, d).withColumn("temp_c", F.lit(None).cast("double")).withColumn("median", F.round("median", 1)).withColumn("lo", F.floor("lo").cast("double")).withColumn("hi", F.floor("hi").cast("double"))
    sinks.forecast_csv(points).write.option("header", True).option("emptyValue", "").csv(path)
    return spark.read.option("header", True).schema("ba string, ts_utc string, median string, lo string, hi string, temp_c string").csv(path).fillna("")


@query
def text_redact_secrets(spark, d):
    docs = A.table(spark, d, "pages")
    url = F.concat(F.regexp_replace("url", r"[?#].*", ""), F.lit("?api_key=k"), "page_id", F.lit("&b=1&TOKEN=t"), "page_id")
    line = F.concat(F.lit("GET "), F.lit("password=p"), "page_id", F.lit(' "x" apikey=z&c=2'))
    made = docs.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.redact_url(url).alias("url"), text.redact_text(line).alias("line"), text.redact_text(F.col("html")).alias("body"))
    texts = A.table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("line"), text.redact_text(F.col("text")).alias("body"))
    return made.unionByName(texts).select("kind", "id", "url", "line", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_length"))


# --- projections and scalar functions ------------------------------------------------------------------------------


@query
def schema_enforce(spark, d):
    raw = A.revisions(spark, d).select(F.col("load_mw").cast("string").alias("load_mw"), "tie", "source", "ba", "as_of", "ts_utc")
    return schemas.enforce(raw, schemas.LOAD).select(t(), "ba", "load_mw", "source", t("as_of"))


@query
def registry_lookup(spark, d):
    rows = A.load_by_user(spark, d).withColumn("code", F.element_at(F.array(*map(F.lit, ["PJM", "ciso", "ERCO", "SEPA", "none"])), (F.pmod(F.col("ba").cast("bigint"), F.lit(5)) + 1).cast("int")))
    met = registry.lookup(rows.select(F.upper("code").alias("ba"), "load_mw"), registry.registry(spark))
    return met.groupBy("ba", "name", "interconnect", "utc_offset", "peak_mw").agg(F.count("*").alias("n"), A.exact_sum("load_mw").alias("total"))


@query
def registry_filter(spark, d):
    nations = A.nations(spark, d).withColumn("position", F.col("utc_offset")).withColumn("has_demand", F.col("peak_mw") > 0)
    return registry.select(nations, has_demand=True, interconnect="ASIA").select("code", "interconnect", "peak_mw")


@query
def size_tier(spark, d):
    scaled = A.nations(spark, d).withColumn("peak_mw", F.col("peak_mw") * 100)
    return live.size_tier(scaled).select("code", "peak_mw", "tier")


@query
def unit_convert(spark, d):
    f = A.observations(spark, d).groupBy("ba").agg(F.avg("f").alias("f"))
    f = f.join(A.load_hourly(spark, d).groupBy("ba").agg(F.max("load_mw").alias("m")), "ba")
    return f.select("ba", F.round(live.to_celsius(F.col("f")), 7).alias("temp_c"), F.round(live.to_gw(F.col("m")), 7).alias("peak_gw"))


@query
def sane_range_filter(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") - 20000).alias("load_mw"))
    return rows.where(live.sane())


@query
def local_hour(spark, d):
    n = A.nations(spark, d).select(F.col("code").alias("ba"), "utc_offset")
    hours = A.load_hourly(spark, d).select("ts_utc").distinct()
    return hours.join(F.broadcast(n)).groupBy("ba", series.local_hour("ts_utc", F.col("utc_offset")).alias("local_hour")).agg(F.count("*").alias("n"))


@query
def calendar_features(spark, d):
    rows = A.daily_orders(spark, d).select("ba", F.expr("ts_utc + make_interval(0, 0, 0, 0, pmod(datediff(ts_utc, date'1970-01-01'), 24))").alias("ts_utc"))
    out = calendar.calendar_features(rows, calendar.holiday_table(spark))
    return out.select("ba", t(), r("hour_sin"), r("hour_cos"), r("dow_sin"), r("dow_cos"), "is_weekend", "is_holiday")


@query
def special_day_features(spark, d):
    out = calendar.special_days(A.daily_orders(spark, d), calendar.holiday_table(spark))
    return out.select(F.col("day").cast("string").alias("day"), "is_bridge", r("hol_prox"))


@query
def covariate_policy(spark, d):
    rows = [(m, k, p) for m in joins.MODES for k, p in joins.resolve_policy(m).items()]
    table = spark.createDataFrame(rows, "mode string, covariate string, policy string")
    modes = A.load_hourly(spark, d).select(F.element_at(F.array(*map(F.lit, joins.MODES)), F.pmod(F.hour("ts_utc"), F.lit(8)) + 1).alias("mode"))
    return modes.join(F.broadcast(table), "mode").groupBy("mode", "covariate", "policy").agg(F.count("*").alias("n"))


@query
def nwp_spread(spark, d):
    m = A.observations(spark, d).groupBy("ba", F.date_trunc("hour", "ts").alias("ts_utc")).agg(*(F.max(F.when(F.pmod("user_id", F.lit(3)) == i, F.col("f"))).alias(f"m{i}") for i in range(3)))
    return m.select("ba", t(), live.nwp_spread(["m0", "m1", "m2"]).alias("spread"))


@query
def forecast_freshness(spark, d):
    rows = A.load_by_user(spark, d).groupBy("ba").agg(F.max("ts_utc").alias("as_of_utc"), F.sort_array(F.collect_list(F.struct("ts_utc", "load_mw"))).alias("points"))
    out = live.freshness(rows, "2024-01-31 00:00:00", 20)
    return out.select("ba", r("age_h"), "status", F.coalesce(F.size("points"), F.lit(-1)).alias("n_points"))


@query
def temp_kind(spark, d):
    w = A.observations(spark, d).withColumn("ba", F.col("user_id").cast("string")).withColumn("temp_c", F.when(F.pmod("user_id", F.lit(4)) == 0, 1.0).when(F.pmod("user_id", F.lit(4)) == 1, None).otherwise(F.col("f")))
    return live.temp_kind(w)


@query
def date_windows(spark, d):
    spans = A.daily_orders(spark, d).groupBy("ba").agg(F.min("ts_utc").alias("start"), F.max("ts_utc").alias("end"))
    a = payloads.date_windows(spans, 28, ["ba"]).withColumn("kind", F.lit("days"))
    b = payloads.date_windows(spans, None, ["ba"]).withColumn("kind", F.lit("years"))
    return a.unionByName(b).select("ba", "kind", t("w_start"), t("w_end"))


@query
def hourly_spine(spark, d):
    rows = A.load_by_user(spark, d)
    spine = series.hourly_spine(rows).unionByName(series.next_hours(rows, 24))
    met = spine.join(rows, ["ba", "ts_utc"], "left")
    return met.groupBy("ba").agg(F.count("*").alias("hours"), F.count("load_mw").alias("known"), t_max())


def t_max() -> Column:
    return F.date_format(F.max("ts_utc"), "yyyy-MM-dd HH:mm:ss").alias("last")


# --- joins ---------------------------------------------------------------------------------------------------------


@query
def join_load_weather(spark, d):
    w = A.weather(spark, d).where("pmod(hour(ts_utc), 4) <> 1")
    return joins.left_on_ts(A.load_hourly(spark, d), w).select("ba", t(), "load_mw", r("temp_c"))


@query
def join_gen_pivot(spark, d):
    gen = A.generation(spark, d).where("NOT (ba = 'U3' AND fuel = 'SUN')")
    return joins.gen_pivot(A.grouped_load(spark, d), gen).select("ba", t(), "load_mw", r("WND", "wnd"), r("SUN", "sun"))


@query
def join_forecast_alignment(spark, d):
    return aligned(spark, d).select("ba", "idx", r("temp_fcst"), r("temp_anal"), "fcst_start", "fcst_lead_hours")


@query
def join_analysis_past_channel(spark, d):
    return joins.analysis_past(aligned(spark, d), "forecast").select("ba", "idx", r("temp_c"))


@query
def join_asof_ffill(spark, d):
    target = A.load_hourly(spark, d)
    source = A.weather(spark, d).where("pmod(hour(ts_utc), 3) = 0")
    return joins.reindex_ffill(target, source, "temp_c").select("ba", t(), r("temp_c"))


@query
def join_actual_vs_forecast(spark, d):
    return joins.actual_vs_forecast(A.load_hourly(spark, d), A.operator_forecast(spark, d)).select("ba", t(), "actual", r("forecast"))


@query
def join_overlay_chart(spark, d):
    actual = A.load_hourly(spark, d).where("ts_utc < timestamp'2024-01-28'")
    fc = A.load_hourly(spark, d).where("ts_utc >= timestamp'2024-01-27 12:00:00' AND ts_utc < timestamp'2024-01-29'").select("ba", "ts_utc", (F.col("load_mw") * 0.9).alias("lo"), F.col("load_mw").alias("median"), (F.col("load_mw") * 1.1).alias("hi"))
    out = joins.overlay(actual, fc, A.operator_forecast(spark, d))
    return out.select("ba", t(), "load", r("lo"), "median", r("hi"), r("operator"))


@query
def join_peer_pairs(spark, d):
    return joins.peer_pairs(A.load_hourly(spark, d)).select("ba", "peer", t(), "y", "x")


@query
def join_window_range(spark, d):
    indexed, meta, _ = prepared(spark, d)
    origins = series.rolling_origins(meta, horizon=24, step=24, context=48)
    after = series.window_rows(indexed, origins, 24).groupBy("ba", "origin").agg(F.count("*").alias("n_after"), F.round(F.sum("y"), 4).alias("sum_after"))
    before = series.context_rows(indexed, origins, 48).groupBy("ba", "origin").agg(F.count("*").alias("n_before"), F.round(F.sum("x"), 4).alias("sum_before"))
    return after.join(before, ["ba", "origin"])


@query
def semi_holdout(spark, d):
    rows = A.load_by_user(spark, d)
    held = metrics.holdout_flags(rows, 0.2).where("holdout").select("ba")
    inside = rows.join(held, "ba", "left_semi").groupBy("ba").agg(F.count("*").alias("n")).withColumn("part", F.lit("holdout"))
    return inside.unionByName(rows.join(held, "ba", "left_anti").groupBy("ba").agg(F.count("*").alias("n")).withColumn("part", F.lit("tuned")))


# --- aggregation ---------------------------------------------------------------------------------------------------


@query
def agg_current_load(spark, d):
    out = live.current_load(A.user_revisions(spark, d), 200, 10, ["tie"], 400.0)
    return out.select(t(), r("total_mw"), "ba_count")


@query
def agg_centre_mean(spark, d):
    centres = registry.load_centres(spark, registry.registry(spark))
    return live.centre_mean(A.point_weather(spark, d, centres), centres, ["temp_c", "wind"]).select("ba", t(), r("temp_c"), r("wind"))


@query
def agg_hourly_mean(spark, d):
    rows = A.events(spark, d)
    return payloads.hourly_mean(rows, "ts", "value", ["event_type"]).select("event_type", t(), r("value"))


@query
def agg_data_end(spark, d):
    return live.data_end(A.load_hourly(spark, d)).select(t("data_end"))


@query
def agg_split_bounds(spark, d):
    return series.split_bounds(A.load_by_user(spark, d), *A.SPLITS)


@query
def agg_inner_split(spark, d):
    starts = aligned(spark, d).groupBy("ba").agg(F.min("fcst_start").alias("fcst_start"))
    meta = series.split_bounds(A.load_hourly(spark, d), *A.SPLITS).join(starts, "ba")
    return series.inner_split(meta, True, 96).select("ba", "inner_start", "inner_end")


@query
def agg_mase_denominator(spark, d):
    return prepared(spark, d)[2].select("ba", r("denom"))


@query
def agg_mase_denominator_dropna(spark, d):
    rows = series.robust_clean(A.load_hourly(spark, d), k=K)
    return series.mase_denominator_dropna(rows, A.SPLITS[0]).select("ba", r("denom"))


@query
def agg_robust_mad(spark, d):
    return series.mad_stats(A.load_by_user(spark, d)).select("ba", r("med"), r("mad"))


@query
def agg_point_metrics(spark, d):
    rows, denom, _, _ = scored(spark, d)
    return metrics.point_metrics(rows, denom).select("ba", r("mae"), r("rmse"), r("mase"), "n_points", "n_windows")


@query
def agg_crps(spark, d):
    return metrics.crps(scored(spark, d)[0]).select("ba", F.round("crps", 10).alias("crps"))


@query
def agg_pi_coverage(spark, d):
    return metrics.coverage(scored(spark, d)[0]).select("ba", r("coverage"))


@query
def agg_error_scores(spark, d):
    pairs = joins.actual_vs_forecast(A.load_hourly(spark, d), A.operator_forecast(spark, d))
    denom = series.mase_denominator_dropna(A.load_hourly(spark, d), A.SPLITS[0])
    return metrics.error_scores(pairs, denom).select("ba", "n", r("mae"), r("rmse"), r("mape"), r("bias"), r("mase"))


@query
def agg_week_mape(spark, d):
    rows = A.load_hourly(spark, d).withColumn("load_mw", F.col("load_mw") - 150)
    pairs = joins.actual_vs_forecast(rows, A.operator_forecast(spark, d))
    return metrics.week_mape(pairs).select("ba", r("mape"), r("peak_error"))


@query
def agg_macro(spark, d):
    rows, denom, _, _ = scored(spark, d)
    return metrics.macro(metrics.point_metrics(rows, denom), ["mae", "rmse", "mase"]).select(r("mae"), r("rmse"), r("mase"), "n_series")


@query
def agg_holdout_gap(spark, d):
    rows, denom, _, _ = scored(spark, d)
    return metrics.holdout_gap(metrics.point_metrics(rows, denom), "mase", 0.4).select(r("tuned"), r("holdout"), r("gap"))


@query
def agg_step_mase(spark, d):
    rows, denom, _, _ = scored(spark, d)
    by_step = metrics.step_mase(rows, denom)
    return by_step.join(metrics.break_even(by_step)).select("step", r("mase"), "break_even")


@query
def agg_skill_vs_baseline(spark, d):
    rows, denom, indexed, meta = scored(spark, d)
    other = series.with_truth(series.forecast_persistence(indexed, series.rolling_origins(meta, context=24), 24), indexed)
    return metrics.skill(metrics.point_metrics(rows, denom), metrics.point_metrics(other, denom)).select("ba", r("own"), r("baseline"), r("ratio"), r("improvement_pct"))


@query
def agg_bootstrap_ci(spark, d):
    rows, denom, _, _ = scored(spark, d)
    return metrics.bootstrap_ci(metrics.window_errors(rows, denom), 200, 0).select(r("lo"), r("hi"), "replicates")


@query
def agg_bootstrap_ci_seeded(spark, d):
    rows, denom, _, _ = scored(spark, d)
    return metrics.bootstrap_ci(metrics.window_errors(rows, denom), 500, 11).select(r("lo"), r("hi"), "replicates")


@query
def agg_bootstrap_ci_exact(spark, d):
    rows, denom, _, _ = scored(spark, d)
    return metrics.bootstrap_ci_exact(metrics.window_errors(rows, denom), 500, 3).select(r("lo"), r("hi"), "replicates")


@query
def agg_conformal_delta(spark, d):
    indexed, meta, denom = prepared(spark, d)
    rows, _ = jobs.naive_backtest(indexed, meta, denom, start="train_end", end="val_end")
    return conformal.conformal_delta(jobs.with_band(rows)).select("ba", r("delta_mw"))


@query
def agg_peer_correlation(spark, d):
    return peers.peer_correlation(filled(spark, d), A.SPLITS[0]).select("ba", "peer", r("r"))


@query
def agg_weather_skill(spark, d):
    return metrics.weather_skill(A.archived(spark, d).withColumn("temp_c_fcst", F.col("temp_c_fcst") + F.hour("ts_utc") / 10)).select("ba", r("mae"), r("rmse"), r("corr"), r("bias"))


@query
def agg_forecast_stats(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("ba"), F.posexplode("embedding").alias("step", "x"))
    points = e.select("ba", "step", ((F.col("x").cast("double") + 2) * 0.9).alias("lo"), (F.col("x").cast("double") + 2).alias("median"), ((F.col("x").cast("double") + 2) * 1.1).alias("hi"))
    return metrics.forecast_stats(points, 24).select("ba", r("peak"), "peak_step", r("mean"), r("pi_pct_first"), r("peak_over_mean_pct"), r("peak_all"))


@query
def agg_peak_utilisation(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("ba"), F.posexplode("embedding").alias("step", "median"))
    peaks = A.table(spark, d, "embeddings").where("vec_id % 5 <> 0").select(F.col("vec_id").cast("string").alias("ba"), (F.col("label") + 1).cast("double").alias("peak_mw"))
    points = e.withColumn("median", F.col("median").cast("double"))
    return metrics.peak_utilisation(points, peaks).select("ba", r("utilisation"), "status")


@query
def agg_ingest_counts(spark, d):
    rows = A.load_by_user(spark, d).groupBy("ba", F.to_date("ts_utc").alias("day")).agg(F.count("*").alias("n_rows")).select(F.lit("load").alias("feed"), "ba", "n_rows", F.when(F.col("n_rows") < 2, "short").alias("error"))
    return store.ingest_counts(rows)


# --- windows -------------------------------------------------------------------------------------------------------


@query
def win_dedupe_latest(spark, d):
    return series.dedupe_latest(A.revisions(spark, d), ties=["tie"]).select("ba", t(), "load_mw", t("as_of"), "tie")


@query
def win_robust_clean(spark, d):
    return series.robust_clean(A.load_hourly(spark, d), k=K).select("ba", t(), "load_mw")


@query
def win_ffill_bfill(spark, d):
    spine = series.hourly_spine(A.load_hourly(spark, d)).join(series.robust_clean(A.load_hourly(spark, d), k=K), ["ba", "ts_utc"], "left")
    return series.fill(spine).select("ba", t(), "load_mw")


@query
def win_block_fill(spark, d):
    rows = A.daily_orders(spark, d).withColumn("load_mw", F.when(F.pmod(F.dayofyear("ts_utc"), F.lit(3)) == 0, F.col("load_mw")))
    return series.block_fill(rows, "load_mw", ["ba"]).select("ba", t(), "load_mw")


@query
def win_seasonal_lag(spark, d):
    return blocks.seasonal_lags(filled(spark, d), block=256).select("ba", "idx", "load_mw", "lag24", "lag48", "lag168")


@query
def win_row_index(spark, d):
    return blocks.row_index(A.load_by_user(spark, d)).select("ba", t(), "idx")


@query
def win_rolling_origins(spark, d):
    meta = series.split_bounds(A.load_hourly(spark, d), *A.SPLITS)
    return series.rolling_origins(meta, "train_end", "test_end", 30, 24, 400)


@query
def win_training_pairs(spark, d):
    indexed, meta, _ = prepared(spark, d)
    pairs = series.training_pairs(indexed, meta, 48, 24, 12)
    return pairs.select("ba", "idx", F.element_at("context", 1).alias("c_first"), F.element_at("context", -1).alias("c_last"), F.element_at("target", 1).alias("t_first"), F.element_at("target", -1).alias("t_last"))


@query
def win_fcst_persistence(spark, d):
    indexed, meta, _ = prepared(spark, d)
    return series.with_truth(series.forecast_persistence(indexed, series.rolling_origins(meta, context=24), 24), indexed).select("ba", "origin", "step", "mean", "y")


@query
def win_fcst_seasonal_naive(spark, d):
    indexed, meta, _ = prepared(spark, d)
    origins = series.rolling_origins(meta, "train_end", "test_end", 30, 24, 168)
    return series.with_truth(series.forecast_seasonal_naive(indexed, origins, 30), indexed).select("ba", "origin", "step", "mean", "y")


@query
def win_future_known(spark, d):
    rows = calendar.calendar_features(filled(spark, d), calendar.holiday_table(spark))
    _, meta, _ = prepared(spark, d)
    return joins.future_covariate(rows, series.rolling_origins(meta), 24, "known", "hour_sin").select("ba", "origin", "step", r("hour_sin"))


def _future(spark, d, policy, value="temp_c", source=None, horizon=24):
    rows = aligned(spark, d)
    meta = series.split_bounds(rows, *A.SPLITS)
    return joins.future_covariate(rows, series.rolling_origins(meta, horizon=horizon), horizon, policy, value, source).select("ba", "origin", "step", r(value))


@query
def win_future_persistence(spark, d):
    return _future(spark, d, "persistence")


@query
def win_future_lag24(spark, d):
    return _future(spark, d, "lag24", horizon=30)


@query
def win_future_forecast(spark, d):
    rows = joins.forecast_alignment(temperatures(spark, d), A.archived(spark, d), {"rad_fcst": "rad_wm2_fcst", "wind_fcst": "wind100_fcst"})
    origins = series.rolling_origins(series.split_bounds(rows, *A.SPLITS))
    out = joins.future_channels(rows, origins, 24, {"temp_c": "temp_fcst", "rad_fcst": "rad_fcst", "wind_fcst": "wind_fcst"})
    return out.select("ba", "origin", "step", r("temp_c"), r("rad_fcst"), r("wind_fcst"))


@query
def win_future_oracle(spark, d):
    return _future(spark, d, "oracle")


@query
def win_lead_guard(spark, d):
    meta = aligned(spark, d).groupBy("ba").agg(F.min("fcst_lead_hours").alias("fcst_lead_hours"))
    joins.check_lead(meta, 24)
    return meta.withColumn("longest_horizon", F.col("fcst_lead_hours"))


@query
def win_temp_for_baseline(spark, d):
    rows = stored(aligned(spark, d), "aligned")
    origins = stored(series.rolling_origins(series.split_bounds(rows, *A.SPLITS)), "origins")
    out = [joins.baseline_temperature(rows, origins, 24, p).withColumn("policy", F.lit(p)) for p in ("past_only", "persistence", "lag24", "forecast", "oracle")]
    return functools.reduce(DataFrame.unionByName, out).select("ba", "origin", "step", r("temp_c"), "policy")


@query
def win_flatline_runs(spark, d):
    rows = blocks.row_index(A.load_by_user(spark, d).withColumn("load_mw", F.floor(F.col("load_mw") / 100).cast("double")))
    return blocks.flatline_runs(rows, block=64).withColumn("flat", F.col("longest") >= 8)


@query
def win_peak_week(spark, d):
    rows = A.daily_orders(spark, d)
    indexed = series.row_index(rows)
    meta = series.split_bounds(indexed, "1995-03-01", "1995-06-01", "2001-01-01")
    return series.peak_week(indexed, meta, "1-URGENT", "5-LOW", 0.0).select("week", "peak")


@query
def win_night_bands(spark, d):
    hours = series.hourly_spine(A.load_hourly(spark, d))
    return series.night_bands(hours, F.lit(-5)).select("ba", t("start"), t("end"))


@query
def win_conformal_apply(spark, d):
    rows = scored(spark, d)[0]
    deltas = A.load_hourly(spark, d).groupBy(F.upper("ba").alias("ba")).agg(F.when(F.max("ba") == "view", F.lit(float("nan"))).when(F.max("ba") == "click", F.lit(-500.0)).otherwise(F.lit(12.5)).alias("delta_mw")).where("ba <> 'ERROR'")
    return conformal.apply_delta(rows, deltas).select("ba", "origin", "step", r("q_lo"), r("q_mid"), r("q_hi"))


# --- top-k and set operations --------------------------------------------------------------------------------------


@query
def topk_last_hours_per_ba(spark, d):
    return live.last_hours(A.load_by_user(spark, d), 5).select("ba", t(), "load_mw")


@query
def topk_peers(spark, d):
    rows = filled(spark, d)
    best = peers.top_peers(peers.peer_correlation(rows, A.SPLITS[0]), 3)
    out = peers.peer_channels(rows, best, 3)
    return out.select("ba", t(), *(F.col(f"nbr{i}") for i in (1, 2, 3)))


@query
def sort_ba_grid(spark, d):
    return live.sort_grid(A.nations(spark, d), "peak").select("code", "peak_mw")


@query
def set_common_timestamps(spark, d):
    x = A.load_hourly(spark, d)
    return x.where("ba = 'click'").select("ts_utc").intersect(x.where("ba = 'error'").select("ts_utc")).select(t())


@query
def set_missing_columns(spark, d):
    made = A.generation(spark, d).select("ba", "ts_utc", "fuel").distinct()
    declared = made.select("ba", "ts_utc").distinct().select("*", F.explode(F.array(*map(F.lit, ("WND", "SUN", "OTH")))).alias("fuel"))
    return declared.exceptAll(made).select("ba", t(), "fuel")


@query
def set_union_sources(spark, d):
    x = A.load_hourly(spark, d)
    a = x.where("ts_utc < timestamp'2024-01-20'")
    return a.unionByName(x.where("ts_utc >= timestamp'2024-01-10'")).dropDuplicates(["ba", "ts_utc"]).select("ba", t(), "load_mw")


# --- jobs ----------------------------------------------------------------------------------------------------------


@query
def job_feature_table(spark, d):
    out = jobs.feature_table(A.load_hourly(spark, d), A.weather(spark, d), A.generation(spark, d).withColumn("ba", F.when(F.col("fuel") == "WND", "click").otherwise("view")), A.archived(spark, d), calendar.holiday_table(spark), A.SPLITS, k=K, extras={"rad_fcst": "rad_wm2_fcst", "wind_fcst": "wind100_fcst", "spread_fcst": "temp_spread_c"})
    return out.select("ba", "idx", "load_mw", r("temp_c"), r("WND", "wnd"), r("SUN", "sun"), r("temp_fcst"), r("rad_fcst"), r("wind_fcst"), r("spread_fcst"), "is_weekend", "is_holiday", "nbr1", "nbr2")


@query
def job_backtest(spark, d):
    indexed, meta, denom = prepared(spark, d, 20.0)
    return jobs.backtest(indexed, meta, denom).select("ba", "step", r("mae"), r("rmse"), r("mase"), "n_points", "n_windows", *(r(c) for c in ("ci_lo", "ci_hi", "delta_mw", "coverage_raw", "coverage")))


@query
def job_ensemble(spark, d):
    rows, denom, indexed, meta = scored(spark, d)
    other = jobs.with_band(series.with_truth(series.forecast_persistence(indexed, series.rolling_origins(meta, context=24), 24), indexed))
    mean = metrics.ensemble(rows.drop("y").unionByName(other.drop("y")))
    return metrics.point_metrics(series.with_truth(mean, indexed), denom).select("ba", *(F.round(c, 10).alias(c) for c in ("mae", "rmse", "mase")), "n_points", "n_windows")


@query
def job_hourly_regression(spark, d):
    rows = temperatures(spark, d)
    features = regression.regression_features(rows, series.split_bounds(rows, "2024-01-26", "2024-01-26", "2024-01-31"), calendar.holiday_table(spark))
    return regression.hourly_regression(features, min_rows=12).select("ba", "idx", r("y"), F.round("mean", 4).alias("mean"))


def _builder(leak: bool):
    def build(rows, origins):
        a = joins.future_covariate(rows, origins, 24, "persistence", "temp_c").select("ba", "origin", "step", F.lit("temp_c").alias("covariate"), F.col("temp_c").alias("value"))
        b = joins.future_covariate(rows, origins, 24, "oracle" if leak else "lag24", "load_mw").select("ba", "origin", "step", F.lit("load_mw").alias("covariate"), F.col("load_mw").alias("value"))
        return a.unionByName(b)

    return build


@query
def job_causal_audit(spark, d):
    rows = temperatures(spark, d)
    origins = audit.audit_origins(series.split_bounds(rows, *A.SPLITS))
    return audit.causal_audit(rows, origins, _builder(True), ["temp_c", "load_mw"], ["temp_c", "load_mw", "hour_sin"])


@query
def job_timestamp_only_audit(spark, d):
    rows = calendar.calendar_features(A.load_hourly(spark, d), calendar.holiday_table(spark))
    skewed = rows.withColumn("dow_sin", F.when((F.col("ba") == "view") & (F.hour("ts_utc") == 3), F.col("dow_sin") + 0.1).otherwise(F.col("dow_sin")))
    return audit.timestamp_only_audit(skewed, ["hour_sin", "hour_cos", "dow_sin", "is_weekend", "is_holiday"])


@query
def job_operator_comparison(spark, d):
    rows, denom, indexed, _ = scored(spark, d)
    own = rows.join(indexed.select("ba", "idx", "ts_utc"), ["ba", "idx"]).select("ba", "ts_utc", F.col("mean").alias("forecast_mw"))
    out = jobs.operator_comparison(A.load_hourly(spark, d), own, A.operator_forecast(spark, d), denom)
    return out.select("ba", "n", r("mae_own"), r("mase_own"), r("mae_op"), r("mase_op"), r("mae_ratio"))


@query
def job_conformal_fit(spark, d):
    indexed, meta, denom = prepared(spark, d)
    rows, _ = jobs.naive_backtest(indexed, meta, denom, start="train_end", end="val_end")
    return jobs.conformal_fit(jobs.with_band(rows))


@query
def job_serve_batch(spark, d):
    rows = filled(spark, d)
    ends = rows.groupBy("ba").agg(F.max("ts_utc").alias("e"))
    future = ends.select("ba", F.explode(F.expr("sequence(e + interval 1 hour, e + interval 24 hour, interval 1 hour)")).alias("ts_utc")).withColumn("temp_c", F.hour("ts_utc").cast("double")).where("NOT (ba = 'click' AND hour(ts_utc) = 3)")
    out = jobs.serve_batch(rows, calendar.holiday_table(spark), future, 100, 24)
    return out.select("ba", "step", t(), r("hour_sin"), "is_weekend", "temp_c")


@query
def udf_forecaster(spark, d):
    indexed, meta, _ = prepared(spark, d)
    origins = series.rolling_origins(meta, context=48)
    contexts = series.context_rows(indexed, origins, 48).groupBy("ba", "origin").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("k"), "x"))).alias("v")).select("ba", "origin", F.col("v.x").alias("context"))
    return jobs.run_forecaster(contexts, jobs.MODELS["seasonal_naive_24"], 24).select("ba", F.col("origin").cast("bigint").alias("origin"), "step", "mean")


# --- streams -------------------------------------------------------------------------------------------------------


def _stream(spark, d, rows: DataFrame, schema: str, days: int = 10) -> DataFrame:
    """The rows as a stream of files in order of their time, ``days`` days a file."""
    path = scratch_path(spark, "stream")
    rows = rows.select(*(c for c, _ in schemas.columns(schema)))
    for first in range(1, 32, days):
        rows.where(F.dayofmonth("ts_utc").between(first, first + days - 1)).repartition(1).write.mode("append").parquet(path)
    return streams.source(spark, path, schema, 1)


@query
def stream_ingest_append(spark, d):
    path, check = scratch_path(spark, "landed"), scratch_path(spark, "checkpoint")
    rows = A.load_hourly(spark, d)
    streams.land(_stream(spark, d, rows.unionByName(rows.where("ts_utc >= timestamp'2024-01-27'")), LOAD), path, check)
    return store.scan(spark, path, LOAD).groupBy("ba", "year", "month").agg(F.count("*").alias("n"), A.exact_sum("load_mw").alias("total"))


@query
def stream_dedupe_revisions(spark, d):
    path, check = scratch_path(spark, "changes"), scratch_path(spark, "checkpoint")
    return streams.latest(_stream(spark, d, A.revisions(spark, d), REVISED), path, check, ["tie"]).select("ba", t(), "load_mw", "tie")


@query
def stream_current_load(spark, d):
    path, check = scratch_path(spark, "changes"), scratch_path(spark, "checkpoint")
    out = streams.current_load(_stream(spark, d, A.user_revisions(spark, d), REVISED, 5), path, check, 5, ["tie"])
    return out.where("ts_utc < timestamp'2024-01-20'").select(t(), r("total_mw"), "ba_count")


def _appended(spark, stream: DataFrame) -> DataFrame:
    return streams.run_to_table(stream, scratch_path(spark, "sink"), scratch_path(spark, "checkpoint"))


@query
def stream_rolling_24h(spark, d):
    out = _appended(spark, streams.rolling_24h(_stream(spark, d, A.load_hourly(spark, d), LOAD)))
    return out.where("w_end <= timestamp'2024-01-25'").select(t("w_start"), t("w_end"), r("total_mw"), "n")


@query
def stream_gap_sessions(spark, d):
    out = _appended(spark, streams.gap_sessions(_stream(spark, d, A.load_by_user(spark, d), LOAD)))
    return out.where("s_end < timestamp'2024-01-24'").select("ba", t("s_start"), t("s_end"), "n")


@query
def stream_late_rows(spark, d):
    rows = A.load_hourly(spark, d)
    path = scratch_path(spark, "stream")
    late = rows.where("ts_utc < timestamp'2024-01-03'").withColumn("load_mw", F.lit(1e6))
    for i, part in enumerate((rows.where("ts_utc < timestamp'2024-01-20'"), rows.where("ts_utc >= timestamp'2024-01-20'"), late)):
        part.select("ba", "ts_utc", "load_mw").coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    out = _appended(spark, streams.rolling_24h(streams.source(spark, f"{path}/*", LOAD, 1)))
    return out.where("w_end <= timestamp'2024-01-25'").select(t("w_start"), F.round("total_mw", 4).alias("total_mw"))


@query
def stream_late_counts(spark, d):
    """Rows a batch took in and dropped as late: the last file brings back two days long past beside one that is on time."""
    path, log = scratch_path(spark, "stream"), scratch_path(spark, "batches")
    rows = A.revisions(spark, d).select(*(c for c, _ in schemas.columns(REVISED)))
    parts = ("ts_utc < timestamp'2024-01-10'", "ts_utc >= timestamp'2024-01-10' AND ts_utc < timestamp'2024-01-20'", "ts_utc >= timestamp'2024-01-20'", "ts_utc < timestamp'2024-01-03' OR ts_utc >= timestamp'2024-01-29'")
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = progress.observed(streams.source(spark, path, REVISED, 1))
    progress.run_logged(spark, lambda: streams.log_changes(stream, scratch_path(spark, "changes"), scratch_path(spark, "checkpoint"), ["tie"]), log)
    return progress.read_log(spark, log).select("batch", "n_rows", "late_rows", t("latest"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
