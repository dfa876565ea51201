"""Raw payloads to rows: JSON pages, parallel arrays, CSV, HTML and GRIB indexes.

Each reader takes a frame of raw text (column ``value``, one payload or line a row, as ``spark.read.text`` gives), so that
many payloads are parsed in parallel.  Zip archives have a data source of their own, in ``archives``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def eia_load(pages: DataFrame) -> DataFrame:
    """response.data[] of {period, respondent, value} to (ts_utc, ba, load_mw)."""
    kind = "struct<response: struct<data: array<struct<period: string, respondent: string, value: string>>>>"
    rows = pages.select(F.explode(F.from_json("value", kind)["response"]["data"]).alias("d"))
    return rows.select(_period("d.period"), F.col("d.respondent").alias("ba"), F.col("d.value").try_cast("double").alias("load_mw"))


def eia_genmix(pages: DataFrame) -> DataFrame:
    """The same with a fuel: (ts_utc, ba, fuel, gen_mw)."""
    kind = "struct<response: struct<data: array<struct<period: string, respondent: string, fueltype: string, value: string>>>>"
    rows = pages.select(F.explode(F.from_json("value", kind)["response"]["data"]).alias("d"))
    return rows.select(_period("d.period"), F.col("d.respondent").alias("ba"), F.col("d.fueltype").alias("fuel"), F.col("d.value").try_cast("double").alias("gen_mw"))


def _period(name: str) -> Column:
    return F.to_timestamp(F.concat(F.col(name), F.lit(":00")), "yyyy-MM-dd'T'HH:mm").alias("ts_utc")


def parallel_arrays(pages: DataFrame) -> DataFrame:
    """[0].data[0].VALUES{DATES[], DATA[]} with MM/dd/yyyy HH:mm:ss dates to (ts_utc, load_mw), nulls dropped."""
    kind = "array<struct<data: array<struct<VALUES: struct<DATES: array<string>, DATA: array<double>>>>>>"
    v = F.from_json("value", kind)[0]["data"][0]["VALUES"]
    rows = pages.select("*", F.explode(F.arrays_zip(v["DATES"].alias("d"), v["DATA"].alias("x"))).alias("z"))
    keep = [c for c in pages.columns if c != "value"]
    return rows.select(*keep, F.to_timestamp("z.d", "MM/dd/yyyy HH:mm:ss").alias("ts_utc"), F.col("z.x").alias("load_mw")).where("load_mw IS NOT NULL")


def openmeteo_hourly(pages: DataFrame, variables: dict[str, str], model: str) -> DataFrame:
    """hourly{time[], <variable>_<model>[] or <variable>[]} to ts_utc and a column for each output name.

    ``variables``: output name -> variable.  Rows without the first variable are dropped.
    """
    fields = [f"`{v}{s}`: array<double>" for v in variables.values() for s in (f"_{model}", "")]
    h = F.from_json("value", f"struct<hourly: struct<time: array<string>, {', '.join(fields)}>>")["hourly"]
    series = [F.coalesce(h[f"{v}_{model}"], h[v]).alias(name) for name, v in variables.items()]
    keep = [c for c in pages.columns if c != "value"]
    rows = pages.select(*keep, F.explode(F.arrays_zip(h["time"].alias("time"), *series)).alias("z"))
    out = rows.select(*keep, F.to_timestamp("z.time", "yyyy-MM-dd'T'HH:mm").alias("ts_utc"), *(F.col(f"z.{name}").alias(name) for name in variables))
    return out.where(F.col(next(iter(variables))).isNotNull())


def asos_hourly(lines: DataFrame) -> DataFrame:
    """CSV lines station,valid,tmpf (nulls M, T, empty) to hourly mean temperature in °C: (station, ts_utc, temp_c)."""
    cells = F.split("value", ",")
    rows = lines.where(~F.col("value").startswith("station,")).select(cells[0].alias("station"), F.to_timestamp(cells[1], "yyyy-MM-dd HH:mm").alias("t"), F.when(~F.trim(cells[2]).isin("M", "T", ""), cells[2]).try_cast("double").alias("f"))
    return hourly_mean(rows.where("t IS NOT NULL").withColumnRenamed("t", "ts"), "ts", "f", ["station"]).select("station", "ts_utc", ((F.col("f") - 32) * 5 / 9).alias("temp_c"))


def hourly_mean(rows: DataFrame, ts: str, value: str, keys: list[str]) -> DataFrame:
    """Observations to the mean of their hour."""
    return rows.groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias("ts_utc")).agg(F.avg(value).alias(value))


def doc_catalog(pages: DataFrame, csv_only: bool = True, since: str | None = None, limit: int | None = None) -> DataFrame:
    """A catalog's documents, newest first: (doc_id, friendly_name, constructed_name, extension, publish_date, ...)."""
    doc = "DocID: string, FriendlyName: string, ConstructedName: string, Extension: string, PublishDate: string, ReportName: string, ReportTypeID: string, ContentSize: string"
    kind = f"struct<ListDocsByRptTypeRes: struct<DocumentList: array<struct<Document: struct<{doc}>>>>>"
    d = pages.select(F.explode(F.from_json("value", kind)["ListDocsByRptTypeRes"]["DocumentList"]).alias("x")).select("x.Document.*")
    out = d.select(F.col("DocID").alias("doc_id"), F.col("FriendlyName").alias("friendly_name"), F.col("ConstructedName").alias("constructed_name"), F.lower("Extension").alias("extension"), F.to_timestamp("PublishDate").alias("publish_date"), F.col("ReportName").alias("report_name"), F.col("ReportTypeID").alias("report_type_id"), F.col("ContentSize").cast("bigint").alias("content_size"))
    if csv_only:
        out = out.where(F.lower("friendly_name").contains("csv") | (F.col("extension") == "csv"))
    if since:
        out = out.where(F.col("publish_date") >= F.lit(since).cast("timestamp"))
    out = out.orderBy(F.desc("publish_date"), "doc_id")
    return out.limit(limit) if limit else out


def lenient_storm_time(text: Column, year: Column) -> Column:
    """dd-MMM-yy HH:mm:ss, two-digit years 69-99 in the 1900s; null on failure; 1 January of ``year`` without text."""
    t = F.try_to_timestamp(F.initcap(F.lower(text)), F.lit("dd-MMM-yy HH:mm:ss"))
    t = F.when(F.year(t) > 2068, F.add_months(t, -1200).cast("timestamp") + F.make_dt_interval(F.lit(0), F.hour(t), F.minute(t), F.second(t))).otherwise(t)
    return F.when(text.isNull(), F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).otherwise(t)


def storm_events(rows: DataFrame, begin: str = "BEGIN_DATE_TIME", year: str = "YEAR") -> DataFrame:
    text = F.col(begin) if begin in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("ts_utc", lenient_storm_time(text, F.col(year).cast("int")))


def latest_revisions(pages: DataFrame, pattern: str = r'href="([^"]*details[^"]*_d(\d{4})_c(\d{8})[^"]*\.csv\.gz)"') -> DataFrame:
    """(year, revision, file) of an HTML index's links, newest revision of each year, newest year first."""
    found = lambda g: F.regexp_extract_all("value", F.lit(pattern), F.lit(g))
    rows = pages.select(F.explode(F.arrays_zip(found(1).alias("file"), found(2).alias("year"), found(3).alias("revision"))).alias("z"))
    rows = rows.select(F.col("z.year").cast("int").alias("year"), F.col("z.revision").cast("int").alias("revision"), F.col("z.file").alias("file"))
    w = Window.partitionBy("year").orderBy(F.desc("revision"), "file")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def station_daily(pages: DataFrame, source: str = "ghcnd") -> DataFrame:
    """Station-daily JSON pages (results[] of {date, datatype, station, value}) to rows with ts_utc and source."""
    kind = "struct<results: array<struct<date: string, datatype: string, station: string, value: double>>>"
    rows = pages.select(F.explode(F.from_json("value", kind)["results"]).alias("d")).select("d.*")
    return rows.select(F.to_timestamp("date", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_utc"), "station", "datatype", "value", F.lit(source).alias("source"))


def grib_index(lines: DataFrame, file: str = "file") -> DataFrame:
    """Index lines number:byte:d=reference:variable:level:forecast:... to records with their byte range.

    Lines with fewer fields, with an empty one, or whose number, byte or reference time are not digits are skipped;
    variable, level and forecast are trimmed.  The last record of a file has no end.
    """
    cell = F.split("value", ":")
    named = ["n", "byte", "reference", "variable", "level", "forecast"]
    rows = lines.where(F.size(cell) > len(named)).select(file, *(cell[i].alias(c) for i, c in enumerate(named)))
    rows = rows.where(F.col("reference").startswith("d=")).withColumn("reference", F.substr("reference", F.lit(3)))
    digits = [F.col(c).rlike("^[0-9]+$") for c in named[:3]]
    filled = [F.col(c) != "" for c in named[3:]]
    rows = rows.where(reduce(lambda a, b: a & b, digits + filled))
    rows = rows.select(file, F.col("n").cast("int").alias("record_no"), F.col("byte").cast("bigint").alias("byte_start"), F.col("reference").alias("ref_time"), *(F.trim(c).alias(c) for c in named[3:]))
    return rows.withColumn("byte_end", F.lead("byte_start").over(Window.partitionBy(file).orderBy("record_no", "byte_start", "ref_time", "variable")) - 1)


def find_record(records: DataFrame, variable: str, level: str | None = None, file: str = "file") -> DataFrame:
    """The first record of each file for a variable (and a level, if one is named); files without one are absent."""
    wanted = records.where((F.col("variable") == variable) & (F.lit(True) if level is None else F.col("level") == level))
    w = Window.partitionBy(file).orderBy("record_no", "byte_start")
    return wanted.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of unpacked reports with the document they come from: adds doc_id and publish_date by ``path`` = doc_id."""
    docs = catalog.select(F.col("doc_id").alias("path"), "doc_id", "publish_date").dropDuplicates(["path"])
    return rows.join(docs, "path", "left")


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with differing columns; a column with differing types becomes double, or else string."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c, k in f.dtypes:
            kinds.setdefault(c, set()).add(k)
    numeric = {"int", "bigint", "float", "double", "smallint", "tinyint"}
    target = {c: next(iter(k)) if len(k) == 1 else "double" if k <= numeric else "string" for c, k in kinds.items()}
    cast = [f.select(*(F.col(c).cast(target[c]) for c in f.columns)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def date_windows(ranges: DataFrame, days: int | None = None, keep: list[str] = ()) -> DataFrame:
    """[start, end) of each row in chunks of ``days``, or of calendar years; the last one is cut off: (w_start, w_end)."""
    if days:
        rows = ranges.where("start < end").select(*keep, "end", F.explode(F.expr(f"sequence(start, greatest(start, end - interval 1 second), interval {days} day)")).alias("w_start"))
        return rows.select(*keep, "w_start", F.least(F.expr(f"w_start + interval {days} day"), "end").alias("w_end"))
    rows = ranges.where("start < end").select(*keep, "start", "end", F.explode(F.expr("sequence(date_trunc('year', start), greatest(start, end - interval 1 second), interval 1 year)")).alias("y"))
    return rows.select(*keep, F.greatest("y", "start").alias("w_start"), F.least(F.expr("y + interval 1 year"), "end").alias("w_end"))
