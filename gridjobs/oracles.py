"""DuckDB SQL of the registered queries, written independently of the Spark plans from shared CTEs."""

from __future__ import annotations

import math
import re

from . import registry


# Covariate modes, written down apart from the library's own list.
MODES = ("persistence", "lag24", "forecast", "forecast_full", "analysis_only", "none", "oracle", "oracle_om")
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def t(c: str = "ts_utc", name: str | None = None) -> str:
    return f"{_T.format(c)} AS {name or c.split('.')[-1]}"


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, 7) AS {name or c.split('.')[-1]}"


def _sum(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def _holidays() -> str:
    """Federal holidays and observed days as a rule over days, independent of the library's own."""

    def fixed(x: str) -> str:
        return f"(strftime({x}, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25') OR (strftime({x}, '%m-%d') = '06-19' AND year({x}) >= 2021))"

    monday = "isodow(day) = 1 AND (month(day), ((day(day) - 1) // 7)) IN ((1, 2), (2, 2), (9, 0), (10, 1))"
    memorial, thanks = "isodow(day) = 1 AND month(day) = 5 AND day(day) > 24", "isodow(day) = 4 AND month(day) = 11 AND day(day) BETWEEN 22 AND 28"
    moved = f"(isodow(day) = 5 AND {fixed('day + INTERVAL 1 DAY')}) OR (isodow(day) = 1 AND {fixed('day - INTERVAL 1 DAY')})"
    return f"SELECT day FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2035-12-31', INTERVAL 1 DAY)) AS DATE) AS day) WHERE {fixed('day')} OR ({monday}) OR ({memorial}) OR ({thanks}) OR {moved}"


# name -> (text, names it uses)
_CTES = {
    "L": f"SELECT event_type AS ba, date_trunc('hour', ts) AS ts_utc, {_sum('value')} AS load_mw FROM events GROUP BY 1, 2",
    "S": f"SELECT CAST(user_id AS VARCHAR) AS ba, date_trunc('hour', ts) AS ts_utc, {_sum('value')} AS load_mw FROM events GROUP BY 1, 2",
    "GL": f"SELECT 'U' || (user_id % 5) AS ba, date_trunc('hour', ts) AS ts_utc, {_sum('value')} AS load_mw FROM events GROUP BY 1, 2",
    "G": "SELECT 'U' || (user_id % 5) AS ba, date_trunc('hour', ts) AS ts_utc, CASE event_type WHEN 'click' THEN 'WND' WHEN 'view' THEN 'SUN' ELSE 'OTH' END AS fuel, value AS gen_mw FROM events",
    "OB": "SELECT event_type AS ba, ts, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f FROM events",
    "W": "SELECT ba, date_trunc('hour', ts) AS ts_utc, (avg(f) - 32) * 5 / 9 AS temp_c FROM OB GROUP BY 1, 2",
    "AR": "SELECT ba, ts_utc, temp_c + 0.5 AS temp_c_fcst, temp_c - 0.25 AS temp_c_anal, CASE WHEN hour(ts_utc) % 2 = 0 THEN 24 ELSE 30 END AS lead_hours FROM W WHERE ts_utc >= TIMESTAMP '2024-01-11' AND hour(ts_utc) % 7 <> 0",
    "OP": "SELECT ba, ts_utc, load_mw * (1 + (hour(ts_utc) - 12) / 100.0::DOUBLE) AS forecast_mw FROM L WHERE hour(ts_utc) % 5 <> 0",
    "D": f"SELECT o_orderpriority AS ba, CAST(o_orderdate AS TIMESTAMP) AS ts_utc, {_sum('o_totalprice')} AS load_mw FROM orders GROUP BY 1, 2",
    "N": "SELECT n_name AS code, r_name AS interconnect, n_nationkey - 12 AS utc_offset, coalesce(c.n, 0) AS peak_mw, n_regionkey = 1 AS is_rto FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey",
    "HOL": _holidays(),
    "MED": "SELECT ba, median(load_mw) AS med FROM L GROUP BY 1",
    "MAD": "SELECT L.ba, any_value(med) AS med, median(abs(load_mw - med)) AS mad FROM L JOIN MED USING (ba) GROUP BY 1",
    "C": "SELECT ba, ts_utc, CASE WHEN (mad > 0 AND abs(load_mw - med) > 3.0 * 1.4826 * mad) OR abs(load_mw) > 500000 THEN NULL ELSE load_mw END AS load_mw FROM L JOIN MAD USING (ba)",
    "C20": "SELECT ba, ts_utc, CASE WHEN (mad > 0 AND abs(load_mw - med) > 20.0 * 1.4826 * mad) OR abs(load_mw) > 500000 THEN NULL ELSE load_mw END AS load_mw FROM L JOIN MAD USING (ba)",
}


def _filled(value: str = "load_mw") -> str:
    return f"coalesce(last_value({value} IGNORE NULLS) OVER (PARTITION BY ba ORDER BY ts_utc ROWS UNBOUNDED PRECEDING), first_value({value} IGNORE NULLS) OVER (PARTITION BY ba ORDER BY ts_utc ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.0)"


def _bounds(source: str) -> str:
    return f"SELECT ba, count(*) AS n, count(*) FILTER (ts_utc < TIMESTAMP '2024-01-21') AS train_end, count(*) FILTER (ts_utc < TIMESTAMP '2024-01-26') AS val_end, count(*) FILTER (ts_utc < TIMESTAMP '2024-01-31') AS test_end FROM {source} GROUP BY 1"


def _denom(i: str) -> str:
    return f"SELECT x.ba, avg(abs(d)) AS denom FROM (SELECT ba, idx, y - lag(y, 24) OVER (PARTITION BY ba ORDER BY idx) AS d FROM {i}) x JOIN ME USING (ba) WHERE idx < train_end GROUP BY 1"


def _origins(start: str = "val_end", end: str = "test_end", h: int = 24, step: int = 24, context: int = 0) -> str:
    return f"SELECT ba, origin FROM (SELECT ba, unnest(generate_series({start}, {end} - {h}, {step})) AS origin FROM ME WHERE {end} - {h} >= {start}) WHERE origin >= {context}"


def _naive(i: str, o: str, h: int = 24) -> str:
    return f"SELECT o.ba, o.origin, s.step, o.origin + s.step AS idx, f.y AS mean, v.y AS y FROM {o} o CROSS JOIN (SELECT unnest(range({h})) AS step) s JOIN {i} f ON f.ba = o.ba AND f.idx = o.origin - 24 + s.step % 24 JOIN {i} v ON v.ba = o.ba AND v.idx = o.origin + s.step"


_CTES |= {
    "I": f"SELECT ba, ts_utc, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) - 1 AS idx, {_filled()} AS y FROM C",
    "I20": f"SELECT ba, ts_utc, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) - 1 AS idx, {_filled()} AS y FROM C20",
    "ME": _bounds("L"),
    "DE": _denom("I"),
    "DE20": _denom("I20"),
    "O": _origins(context=24),
    "SC": "SELECT *, mean * 0.9 AS q_lo, mean AS q_mid, mean * 1.1 AS q_hi FROM (" + _naive("I", "O") + ")",
    "SC20": _naive("I20", "O"),
    "OV": _origins("train_end", "val_end", context=24),
    "SV": "SELECT *, mean * 0.9 AS q_lo, mean AS q_mid, mean * 1.1 AS q_hi FROM (" + _naive("I", "OV") + ")",
    "PM": "SELECT ba, avg(abs(y - mean)) AS mae, sqrt(avg((y - mean) ** 2)) AS rmse, avg(abs(y - mean)) / any_value(denom) AS mase, count(*) AS n_points, count(DISTINCT origin) AS n_windows FROM SC JOIN DE USING (ba) GROUP BY 1",
    "PE": "SELECT o.ba, o.origin, s.step, o.origin + s.step AS idx, f.y AS mean, v.y AS y FROM O o CROSS JOIN (SELECT unnest(range(24)) AS step) s JOIN I f ON f.ba = o.ba AND f.idx = o.origin - 1 JOIN I v ON v.ba = o.ba AND v.idx = o.origin + s.step",
    "T0": "SELECT L.ba, L.ts_utc, load_mw, temp_c FROM L LEFT JOIN W ON L.ba = W.ba AND L.ts_utc = W.ts_utc",
    "TI": f"SELECT ba, ts_utc, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) - 1 AS idx, load_mw, {_filled('temp_c')} AS temp_c FROM T0",
    "AL": "SELECT TI.*, coalesce(last_value(temp_c_fcst IGNORE NULLS) OVER w, temp_c) AS temp_fcst, last_value(temp_c_anal IGNORE NULLS) OVER w AS temp_anal, min(CASE WHEN temp_c_fcst IS NOT NULL THEN idx END) OVER (PARTITION BY TI.ba) AS fcst_start, min(lead_hours) OVER (PARTITION BY TI.ba) AS fcst_lead_hours FROM TI LEFT JOIN AR ON TI.ba = AR.ba AND TI.ts_utc = AR.ts_utc WINDOW w AS (PARTITION BY TI.ba ORDER BY idx ROWS UNBOUNDED PRECEDING)",
    "XA": "SELECT TI.ba, TI.idx, TI.ts_utc, 3 * (AR.temp_c_fcst - 0.5) + 100 AS rad, CASE WHEN hour(TI.ts_utc) % 5 <> 0 THEN (AR.temp_c_fcst - 0.5) / 2 + 4 END AS wind, CASE WHEN hour(TI.ts_utc) % 3 <> 1 THEN abs(AR.temp_c_fcst - 0.5) / 10 END AS spread FROM TI LEFT JOIN AR ON TI.ba = AR.ba AND TI.ts_utc = AR.ts_utc",
    "XF": "SELECT ba, idx, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER p, first_value({c} IGNORE NULLS) OVER f) AS {c}" for c in ("rad", "wind", "spread")) + " FROM XA WINDOW p AS (PARTITION BY ba ORDER BY idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY ba ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "O0": _origins(),
    "DN": "SELECT ba, avg(abs(d)) AS denom FROM (SELECT ba, load_mw - lag(load_mw, 24) OVER (PARTITION BY ba ORDER BY ts_utc) AS d FROM L WHERE ts_utc < TIMESTAMP '2024-01-21') GROUP BY 1",
    "CAL": "SELECT ba, ts_utc, sin(hour(ts_utc) * (2 * pi() / 24)) AS hour_sin, cos(hour(ts_utc) * (2 * pi() / 24)) AS hour_cos, sin((isodow(ts_utc) - 1) * (2 * pi() / 7)) AS dow_sin, cos((isodow(ts_utc) - 1) * (2 * pi() / 7)) AS dow_cos, CAST(isodow(ts_utc) >= 6 AS INT) AS is_weekend, CAST(CAST(ts_utc AS DATE) IN (SELECT day FROM HOL) AS INT) AS is_holiday FROM L",
    "PC": "SELECT a.ba, b.ba AS peer, corr(a.y, b.y) AS r FROM I a JOIN I b ON a.ts_utc = b.ts_utc AND a.ba <> b.ba WHERE a.ts_utc < TIMESTAMP '2024-01-21' GROUP BY 1, 2 HAVING stddev_pop(a.y) > 0 AND stddev_pop(b.y) > 0",
}


def sql(text: str, **own: str) -> str:
    """``text`` with the CTEs that it uses in front, in order of use; ``own`` adds some for one query."""
    table, order = _CTES | own, []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in _uses(table[name], table):
            if n != name:
                visit(n)
        order.append(name)

    for n in _uses(text, table):
        visit(n)
    head = ", ".join(f"{n} AS ({table[n]})" for n in order)
    return f"WITH {head} {text}" if head else text


def _uses(text: str, table: dict) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b[A-Z][A-Z0-9]*\b", text)) if n in table]


def _future(at: str, column: str, name: str, h: int = 24, o: str = "O0", i: str = "AL", extra: str = "") -> str:
    return f"SELECT q.ba, q.origin, q.step, {r('v.' + column, name)}{extra} FROM (SELECT o.ba, o.origin, s.step, o.origin + s.step AS idx, (SELECT max(idx) + 1 FROM {i} z WHERE z.ba = o.ba) AS n FROM {o} o CROSS JOIN (SELECT unnest(range({h})) AS step) s) q JOIN {i} v ON v.ba = q.ba AND v.idx = {at}"


def _delta_of(source: str) -> str:
    ranked = f"SELECT ba, max(CASE WHEN k = floor(a) THEN s END) AS lo, max(CASE WHEN k = ceil(a) THEN s END) AS hi, max(a - floor(a)) AS f FROM (SELECT ba, s, row_number() OVER (PARTITION BY ba ORDER BY s) - 1 AS k, (n - 1) * least(ceil((n + 1) * 0.8 - 1e-9) / n, 1.0) AS a FROM (SELECT ba, greatest(q_lo - y, y - q_hi) AS s, count(*) OVER (PARTITION BY ba) AS n FROM {source})) GROUP BY 1"
    return f"SELECT ba, lo + (hi - lo) * f AS d FROM ({ranked})"


def _delta(rounded: bool) -> str:
    if rounded:
        return f"SELECT * FROM (SELECT ba, round(d, 2) AS delta_mw FROM ({_delta_of('SV')})) WHERE delta_mw <> 0"
    return f"SELECT ba, round(d, 7) AS delta_mw FROM ({_delta_of('SV')})"


def _regression_sql() -> str:
    """Sums of products and Gauss-Jordan elimination on a table (ba, h, i, j, v) of each group's system."""
    steps = {"A0": "SELECT x.ba, x.h, x.i, x.j, s / (a.sd * b.sd) + CASE WHEN x.i = x.j THEN 1 ELSE 0 END AS v FROM XX x JOIN SD a ON a.ba = x.ba AND a.h = x.h AND a.i = x.i JOIN SD b ON b.ba = x.ba AND b.h = x.h AND b.i = x.j WHERE x.i < 12 AND x.j < 12 UNION ALL SELECT x.ba, x.h, x.i, 12, s / sd FROM XX x JOIN SD a ON a.ba = x.ba AND a.h = x.h AND a.i = x.i WHERE x.j = 12 AND x.i < 12"}
    for k in range(1, 12):
        a = f"A{k - 1}"
        steps[f"A{k}"] = f"SELECT x.ba, x.h, x.i, x.j, CASE WHEN x.i = {k} THEN x.v / p.v ELSE x.v - q.v * r.v / p.v END AS v FROM {a} x JOIN {a} p ON p.ba = x.ba AND p.h = x.h AND p.i = {k} AND p.j = {k} JOIN {a} q ON q.ba = x.ba AND q.h = x.h AND q.i = x.i AND q.j = {k} JOIN {a} r ON r.ba = x.ba AND r.h = x.h AND r.i = {k} AND r.j = x.j"
    xs = ", ".join(f"x{i}" for i in range(1, 12))
    return sql(
        "SELECT ba, idx, round(y, 7) AS y, round(CASE WHEN w IS NULL THEN x1 ELSE m + w END, 4) AS mean FROM (SELECT TE.ba, TE.idx, any_value(TE.y) AS y, any_value(TE.x1) AS x1, any_value(YM.m) AS m, sum(v * (x - MO.m) / sd) AS w FROM TE JOIN TL ON TL.ba = TE.ba AND TL.idx = TE.idx LEFT JOIN A11 ON A11.ba = TE.ba AND A11.h = TE.h AND A11.i = TL.i AND A11.j = 12 LEFT JOIN MO ON MO.ba = TE.ba AND MO.h = TE.h AND MO.i = TL.i LEFT JOIN MO YM ON YM.ba = TE.ba AND YM.h = TE.h AND YM.i = 12 LEFT JOIN SD ON SD.ba = TE.ba AND SD.h = TE.h AND SD.i = TL.i GROUP BY TE.ba, TE.idx)",
        FE="SELECT TI.ba, TI.idx, hour(TI.ts_utc) AS h, load_mw AS y, lag(load_mw, 24, 0.0) OVER w AS x1, lag(load_mw, 48, 0.0) OVER w AS x2, lag(load_mw, 168, 0.0) OVER w AS x3, temp_c AS x4, hour_sin AS x5, hour_cos AS x6, dow_sin AS x7, dow_cos AS x8, is_weekend::DOUBLE AS x9, is_holiday::DOUBLE AS x10, month(TI.ts_utc)::DOUBLE AS x11, (SELECT count(*) FROM L z WHERE z.ba = TI.ba AND z.ts_utc < TIMESTAMP '2024-01-26') AS e FROM TI JOIN CAL ON CAL.ba = TI.ba AND CAL.ts_utc = TI.ts_utc WINDOW w AS (PARTITION BY TI.ba ORDER BY TI.idx)",
        TR="SELECT * FROM FE WHERE idx < e AND idx >= 168",
        TE="SELECT FE.* REPLACE (o.temp_c AS x4) FROM FE JOIN TI o ON o.ba = FE.ba AND o.idx = e + (FE.idx - e) // 24 * 24 - 1 WHERE FE.idx >= e",
        XL=f"SELECT ba, h, idx, unnest(range(1, 13)) AS i, unnest([{xs}, y]) AS x FROM TR",
        TL=f"SELECT ba, h, idx, unnest(range(1, 12)) AS i, unnest([{xs}]) AS x FROM TE",
        MO="SELECT ba, h, i, count(*) AS n, avg(x) AS m, min(x) = max(x) AS flat FROM XL GROUP BY 1, 2, 3 HAVING count(*) >= 12",
        CE="SELECT XL.ba, XL.h, idx, XL.i, CASE WHEN flat THEN 0 ELSE x - m END AS c FROM XL JOIN MO ON MO.ba = XL.ba AND MO.h = XL.h AND MO.i = XL.i",
        XX="SELECT a.ba, a.h, a.i, b.i AS j, sum(a.c * b.c) AS s FROM CE a JOIN CE b ON a.ba = b.ba AND a.h = b.h AND a.idx = b.idx GROUP BY 1, 2, 3, 4",
        SD="SELECT x.ba, x.h, x.i, CASE WHEN s > 0 THEN sqrt(s / n) ELSE 1 END AS sd FROM XX x JOIN MO ON MO.ba = x.ba AND MO.h = x.h AND MO.i = x.i WHERE x.i = x.j",
        **steps,
    )


def _policies() -> str:
    temp = "CASE WHEN mode IN ('oracle', 'oracle_om') THEN 'oracle' WHEN mode IN ('persistence', 'lag24') THEN mode WHEN mode IN ('forecast', 'forecast_full') THEN 'forecast' ELSE 'past_only' END"
    kinds = ", ".join(f"('{c}', 'known')" for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_holiday"))
    modes = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"
    per = f"SELECT {modes}[hour(ts_utc) % 8 + 1] AS mode, count(*) AS n FROM L GROUP BY 1"
    return f"""SELECT mode, covariate, policy, n FROM (
        SELECT mode, c.covariate, c.policy, n FROM ({per}) CROSS JOIN (VALUES {kinds}) c(covariate, policy)
        UNION ALL SELECT mode, 'temp_c', {temp}, n FROM ({per})
        UNION ALL SELECT mode, f.x, CASE WHEN mode = 'oracle' THEN 'oracle' ELSE 'past_only' END, n FROM ({per}) CROSS JOIN (VALUES ('WND'), ('SUN')) f(x)
        UNION ALL SELECT mode, f.x, 'fcst_extra', n FROM ({per}) CROSS JOIN (VALUES ('rad_fcst'), ('wind_fcst')) f(x) WHERE mode = 'forecast_full')"""


def _ratio(own: str, base: str) -> str:
    metric = "SELECT x.ba, avg(abs(y - mean)) AS mae FROM {} x JOIN DE USING (ba) GROUP BY 1"
    return f"SELECT a.ba, {r('a.mae', 'own')}, {r('b.mae', 'baseline')}, {r('b.mae / a.mae', 'ratio')}, {r('100 * (1 - a.mae / b.mae)', 'improvement_pct')} FROM ({metric.format(own)}) a JOIN ({metric.format(base)}) b USING (ba)"


def _centres() -> str:
    """Load centres, or the BA's own place, as SQL values."""
    listed = [(row[0], lat, lon) for row in registry.ROWS for lat, lon in registry.LOAD_CENTRES.get(row[0], [(row[8], row[7])])]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{ba}', {lat!r}::DOUBLE, {lon!r}::DOUBLE)" for ba, lat, lon in listed) + ") v(ba, lat, lon)"


def _masked(c: str) -> str:
    """Secret values of a text, by one pattern."""
    return f"""regexp_replace({c}, '((api_key|apikey|token|subscription-key|access_token|password)=)[^\\s\\x0B&"'']+', '\\1REDACTED', 'gi')"""


def _bootstrap_sql(replicates: int, seed: int, whole: str | None = None) -> str:
    whole = whole or sql("SELECT x.ba, origin, avg(abs(y - mean)) / any_value(denom) AS err FROM SC x JOIN DE USING (ba) GROUP BY 1, 2")
    limits, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        limits.append(total)
    weight = " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INT)" for x in limits)
    drawn = f"SELECT b, err, CAST('0x' || substr(md5('{seed}/' || b || '/' || ba || '/' || CAST(origin AS BIGINT)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM ({whole}) CROSS JOIN (SELECT unnest(range({replicates})) AS b)"
    return f"SELECT round(quantile_cont(m, 0.025), 7) AS lo, round(quantile_cont(m, 0.975), 7) AS hi, count(*) AS replicates FROM (SELECT b, sum(w * err) / sum(w) AS m FROM (SELECT b, err, {weight} AS w FROM ({drawn})) GROUP BY 1 HAVING sum(w) > 0)"


_POINTS = f"SELECT x.ba, step, I.ts_utc, q_lo AS lo, q_mid AS median, q_hi AS hi FROM SC x JOIN (SELECT ba, max(origin) AS origin FROM SC GROUP BY 1) m ON m.ba = x.ba AND m.origin = x.origin JOIN I ON I.ba = x.ba AND I.idx = x.idx"


def oracle_sql() -> dict[str, str]:
    day = "CAST(ts_utc AS DATE)"
    out = {
        "src_parquet_scan": sql(f"SELECT ba, {t()}, load_mw, CAST(year(ts_utc) AS INT) AS year, CAST(month(ts_utc) AS INT) AS month FROM D WHERE ts_utc >= TIMESTAMP '1996-11-01' AND ts_utc < TIMESTAMP '1997-03-01'"),
        "sink_partitioned_append": sql(f"SELECT CAST(year(ts_utc) AS INT) AS year, CAST(month(ts_utc) AS INT) AS month, count(*) * (CASE WHEN year(ts_utc) >= 2001 THEN 2 ELSE 1 END) AS n, {_sum('load_mw')} * (CASE WHEN year(ts_utc) >= 2001 THEN 2 ELSE 1 END) AS total FROM D GROUP BY year(ts_utc), month(ts_utc)"),
        "sink_compact_snapshot": sql("SELECT ba, CAST(2024 AS INT) AS year, CAST(1 AS INT) AS month, 2 * count(*) AS n, count(DISTINCT ts_utc) AS hours FROM L GROUP BY 1"),
        "ingest_manifest_record": sql("SELECT 'eia-930' AS source, strftime(ts_utc, '%Y-%m-%d') AS key, '2024-02-01 00:00:00' AS fetched_at, count(*) AS n_rows FROM L GROUP BY 2"),
        "ingest_skip_known_keys": sql("SELECT 'eia-930' AS source, strftime(ts_utc, '%Y-%m-%d') AS key, count(*) AS n_rows FROM L WHERE day(ts_utc) % 3 <> 0 GROUP BY 2"),
        "ingest_write_through": sql(f"SELECT 'eia-930' AS source, strftime(ts_utc, '%Y-%m-%d') AS key, CASE WHEN day(any_value(ts_utc)) <= 10 THEN '2024-02-01' WHEN day(any_value(ts_utc)) <= 20 THEN '2024-02-03' ELSE '2024-02-04' END || ' 00:00:00' AS fetched_at, count(*) AS n_rows, count(*) AS n, {_sum('load_mw')} AS total FROM L GROUP BY 2"),
        "ingest_content_hash": sql("SELECT strftime(ts_utc, '%Y-%m-%d') AS key, count(*) AS n_rows, TRUE AS same, CAST(64 AS INT) AS digits FROM L GROUP BY 1"),
        "src_eia_json_pages": sql(f"SELECT ba, {t()}, load_mw FROM GL"),
        "src_genmix_json_pages": sql(f"SELECT ba, {t()}, fuel, {_sum('gen_mw')} AS gen_mw FROM G GROUP BY ba, ts_utc, fuel"),
        "src_parallel_arrays_json": sql(f"SELECT ba, {t()}, load_mw FROM L WHERE hour(ts_utc) % 6 <> 0"),
        "src_openmeteo_hourly_arrays": sql(f"SELECT ba, {t('h', 'ts_utc')}, temp, wind FROM (SELECT ba, date_trunc('hour', ts) AS h, max(f) AS temp, min(f) AS wind FROM OB GROUP BY 1, 2) WHERE temp <> 13"),
        "src_asos_csv": sql(f"SELECT ba AS station, {t('h', 'ts_utc')}, {r('(avg(f) - 32) * 5 / 9', 'temp_c')} FROM (SELECT ba, date_trunc('hour', ts) AS h, CASE WHEN f NOT IN (7, 8) THEN f END AS f FROM OB) GROUP BY ba, h"),
        "src_zip_csv": sql(f"SELECT ba || '/' || {day} AS path, {t('ts_utc', 'ts')}, load_mw AS lmp FROM L"),
        "src_doc_catalog": f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '_CSV' ELSE '' END AS friendly_name, CASE WHEN o_orderstatus = 'O' THEN 'csv' ELSE 'xml' END AS extension, {t('CAST(o_orderdate AS TIMESTAMP)', 'publish_date')}, CAST(floor(o_totalprice) AS BIGINT) AS content_size FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '2000-01-01' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 500",
        "src_storm_events_csv": f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN {_T.format('CAST(o_orderdate AS TIMESTAMP)')} END AS ts_utc FROM orders",
        "src_index_latest_revision": "SELECT year, CAST(max(rev) AS INT) AS revision, 'StormEvents_details-ftp_v1.0_d' || year || '_c' || max(rev) || '.csv.gz' AS file FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%Y%m%d') AS rev FROM orders) GROUP BY 1",
        "src_station_daily_json": f"SELECT {t('CAST(o_orderdate AS TIMESTAMP)', 'ts_utc')}, CAST(o_custkey AS VARCHAR) AS station, o_orderstatus AS datatype, o_totalprice AS value, 'ghcnd' AS source FROM orders",
        "src_grib_idx_text": "SELECT l_orderkey AS file, CAST(l_linenumber AS INT) AS record_no, byte_start, strftime(l_shipdate, '%Y%m%d%H') AS ref_time, CASE WHEN l_returnflag = 'A' THEN 'TMP' ELSE 'UGRD' END AS variable, '2 m above ground' AS level, '1 hour fcst' AS forecast, lead(byte_start) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, byte_start, l_shipdate, CASE WHEN l_returnflag = 'A' THEN 'TMP' ELSE 'UGRD' END) - 1 AS byte_end FROM (SELECT *, CAST(l_linenumber AS BIGINT) * 524288 + CAST(trunc(l_quantity) AS BIGINT) AS byte_start FROM lineitem WHERE l_linestatus = 'F')",
        "src_union_ragged": "SELECT CAST(c_custkey AS DOUBLE) AS key, c_name AS name, c_acctbal AS bal, NULL AS size FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier UNION ALL SELECT p_partkey + 0.5, NULL, NULL, p_size FROM part",
        "sink_forecast_docs": sql(f"SELECT ba, CASE ba WHEN 'view' THEN 'second' ELSE 'seasonal-naive' END AS model, CAST(step AS INT) AS step, strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, {r('median', 'median_mw')} FROM ({_POINTS})"),
        "sink_forecast_csv": sql(f"SELECT ba, strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ') AS ts_utc, format('{{:.2f}}', round(median, 1)) AS median, format('{{:.2f}}', floor(lo)) AS lo, format('{{:.2f}}', floor(hi)) AS hi, '' AS temp_c FROM ({_POINTS})"),
        "text_redact_secrets": f"SELECT 'page' AS kind, page_id AS id, regexp_replace(url, '[?#].*', '') || '?api_key=REDACTED&b=1&TOKEN=REDACTED' AS url, 'GET password=REDACTED \"x\" apikey=REDACTED&c=2' AS line, md5({_masked('html')}) AS body_md5, length({_masked('html')}) AS body_length FROM pages UNION ALL SELECT 'document', doc_id, NULL, NULL, md5({_masked('text')}), length({_masked('text')}) FROM documents",
        "schema_enforce": f"SELECT {t('h', 'ts_utc')}, event_type AS ba, value AS load_mw, 'events' AS source, {t('ts', 'as_of')} FROM (SELECT *, date_trunc('hour', ts) AS h FROM events)",
        "registry_lookup": sql(f"SELECT c.code AS ba, name, interconnect, CAST(utc_offset AS INT) AS utc_offset, CAST(peak_mw AS INT) AS peak_mw, count(*) AS n, {_sum('load_mw')} AS total FROM (SELECT ['PJM', 'CISO', 'ERCO', 'SEPA', 'NONE'][CAST(ba AS BIGINT) % 5 + 1] AS code, load_mw FROM S) c LEFT JOIN (VALUES ('PJM', 'PJM Interconnection', 'Eastern', -5, 165500), ('CISO', 'California ISO', 'Western', -8, 52000), ('ERCO', 'ERCOT', 'Texas', -6, 85500), ('SEPA', 'Southeastern Power Administration', 'Eastern', -5, NULL)) v(code, name, interconnect, utc_offset, peak_mw) ON v.code = c.code GROUP BY 1, 2, 3, 4, 5"),
        "registry_filter": sql("SELECT code, interconnect, peak_mw FROM N WHERE peak_mw > 0 AND interconnect = 'ASIA'"),
        "size_tier": sql("SELECT code, peak_mw * 100 AS peak_mw, CASE WHEN is_rto THEN 'RTO' WHEN peak_mw * 100 >= 5000 THEN 'Utility' ELSE 'Small' END AS tier FROM N"),
        "unit_convert": sql(f"SELECT ba, {r('(f - 32) * 5 / 9', 'temp_c')}, {r('m / 1000', 'peak_gw')} FROM (SELECT ba, avg(f) AS f FROM OB GROUP BY 1) JOIN (SELECT ba, max(load_mw) AS m FROM L GROUP BY 1) USING (ba)"),
        "sane_range_filter": "SELECT o_orderkey, o_totalprice - 20000 AS load_mw FROM orders WHERE o_totalprice - 20000 > 0 AND o_totalprice - 20000 < 200000",
        "local_hour": sql("SELECT code AS ba, CAST(((hour(ts_utc) + utc_offset) % 24 + 24) % 24 AS INT) AS local_hour, count(*) AS n FROM (SELECT DISTINCT ts_utc FROM L) CROSS JOIN N GROUP BY 1, 2"),
        "calendar_features": sql(
            f"SELECT ba, {t()}, {r('sin(hour(ts_utc) * (2 * pi() / 24))', 'hour_sin')}, {r('cos(hour(ts_utc) * (2 * pi() / 24))', 'hour_cos')}, {r('sin((isodow(ts_utc) - 1) * (2 * pi() / 7))', 'dow_sin')}, {r('cos((isodow(ts_utc) - 1) * (2 * pi() / 7))', 'dow_cos')}, CAST(isodow(ts_utc) >= 6 AS INT) AS is_weekend, CAST({day} IN (SELECT day FROM HOL) AS INT) AS is_holiday FROM (SELECT ba, ts_utc + to_hours(CAST(datediff('day', DATE '1970-01-01', {day}) % 24 AS INT)) AS ts_utc FROM D)"
        ),
        "special_day_features": sql(
            f"SELECT CAST(day AS VARCHAR) AS day, CAST(NOT o AND coalesce(lag(o) OVER w, FALSE) AND coalesce(lead(o) OVER w, FALSE) AS INT) AS is_bridge, round(greatest(-7, least(7, CASE WHEN nx IS NULL AND pv IS NULL THEN 7 WHEN pv IS NULL OR nx - pos <= pos - pv THEN pos - nx ELSE pos - pv END)) / 7.0::DOUBLE, 7) AS hol_prox FROM (SELECT *, min(CASE WHEN h THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, max(CASE WHEN h THEN pos END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pv FROM (SELECT day, row_number() OVER (ORDER BY day) AS pos, day IN (SELECT day FROM HOL) AS h, day IN (SELECT day FROM HOL) OR isodow(day) >= 6 AS o FROM (SELECT DISTINCT {day} AS day FROM D))) WINDOW w AS (ORDER BY pos)"
        ),
        "covariate_policy": sql(_policies()),
        "nwp_spread": sql(f"SELECT ba, {t('h', 'ts_utc')}, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 THEN greatest(a, b, c) - least(a, b, c) END AS spread FROM (SELECT ba, date_trunc('hour', ts) AS h, max(f) FILTER (user_id % 3 = 0) AS a, max(f) FILTER (user_id % 3 = 1) AS b, max(f) FILTER (user_id % 3 = 2) AS c FROM OB GROUP BY 1, 2)"),
        "forecast_freshness": sql("SELECT ba, round(age, 7) AS age_h, CASE WHEN age > 25 THEN 'stale' WHEN n < 20 THEN 'short' ELSE 'ok' END AS status, CAST(CASE WHEN age > 25 OR n < 20 THEN -1 ELSE 20 END AS INT) AS n_points FROM (SELECT ba, epoch(TIMESTAMP '2024-01-31' - max(ts_utc)) / 3600 AS age, count(*) AS n FROM S GROUP BY 1)"),
        "temp_kind": sql("SELECT CAST(user_id AS VARCHAR) AS ba, CASE WHEN user_id % 4 = 1 THEN 'absent' WHEN user_id % 4 = 0 OR max(f) - min(f) < 1 THEN 'constant' ELSE 'varying' END AS kind FROM OB GROUP BY user_id"),
        "date_windows": sql(
            f"SELECT ba, 'days' AS kind, {t('s', 'w_start')}, {t('least(s + INTERVAL 28 DAY, e)', 'w_end')} FROM (SELECT ba, e, unnest(generate_series(a, e - INTERVAL 1 SECOND, INTERVAL 28 DAY)) AS s FROM (SELECT ba, min(ts_utc) AS a, max(ts_utc) AS e FROM D GROUP BY 1)) UNION ALL SELECT ba, 'years', {t('greatest(y, a)', 'w_start')}, {t('least(y + INTERVAL 1 YEAR, e)', 'w_end')} FROM (SELECT ba, a, e, unnest(generate_series(CAST(date_trunc('year', a) AS TIMESTAMP), e - INTERVAL 1 SECOND, INTERVAL 1 YEAR)) AS y FROM (SELECT ba, min(ts_utc) AS a, max(ts_utc) AS e FROM D GROUP BY 1))"
        ),
        "hourly_spine": sql(f"SELECT ba, CAST(epoch(max(ts_utc) - min(ts_utc)) / 3600 AS BIGINT) + 25 AS hours, count(*) AS known, {t('max(ts_utc) + INTERVAL 24 HOUR', 'last')} FROM S GROUP BY 1"),
        "join_load_weather": sql(f"SELECT L.ba, {t('L.ts_utc')}, load_mw, {r('temp_c')} FROM L LEFT JOIN (SELECT * FROM W WHERE hour(ts_utc) % 4 <> 1) w2 ON L.ba = w2.ba AND L.ts_utc = w2.ts_utc"),
        "join_gen_pivot": sql(
            f"SELECT GL.ba, {t('GL.ts_utc')}, load_mw, CASE WHEN GL.ba IN (SELECT ba FROM G2 WHERE fuel = 'WND') THEN round(w, 7) ELSE 0 END AS wnd, CASE WHEN GL.ba IN (SELECT ba FROM G2 WHERE fuel = 'SUN') THEN round(s, 7) ELSE 0 END AS sun FROM GL LEFT JOIN (SELECT ba, ts_utc, avg(gen_mw) FILTER (fuel = 'WND') AS w, avg(gen_mw) FILTER (fuel = 'SUN') AS s FROM G2 GROUP BY 1, 2) p ON p.ba = GL.ba AND p.ts_utc = GL.ts_utc",
            G2="SELECT * FROM G WHERE NOT (ba = 'U3' AND fuel = 'SUN')",
        ),
        "join_forecast_alignment": sql(f"SELECT ba, CAST(idx AS INT) AS idx, {r('temp_fcst')}, {r('temp_anal')}, CAST(fcst_start AS INT) AS fcst_start, CAST(fcst_lead_hours AS INT) AS fcst_lead_hours FROM AL"),
        "join_analysis_past_channel": sql("SELECT ba, CAST(idx AS INT) AS idx, round(CASE WHEN idx >= fcst_start THEN coalesce(temp_anal, temp_c) ELSE temp_c END, 7) AS temp_c FROM AL"),
        "join_asof_ffill": sql(f"SELECT L.ba, {t('L.ts_utc')}, round(last_value(temp_c IGNORE NULLS) OVER (PARTITION BY L.ba ORDER BY L.ts_utc ROWS UNBOUNDED PRECEDING), 7) AS temp_c FROM L LEFT JOIN (SELECT * FROM W WHERE hour(ts_utc) % 3 = 0) x ON x.ba = L.ba AND x.ts_utc = L.ts_utc"),
        "join_actual_vs_forecast": sql(f"SELECT L.ba, {t('L.ts_utc')}, load_mw AS actual, {r('forecast_mw', 'forecast')} FROM L JOIN OP ON L.ba = OP.ba AND L.ts_utc = OP.ts_utc"),
        "join_overlay_chart": sql(
            f"SELECT x.ba, {t('x.ts_utc')}, load, round(lo, 7) AS lo, median, round(hi, 7) AS hi, round(forecast_mw, 7) AS operator FROM (SELECT *, CASE WHEN k = 1 THEN load END AS lo, CASE WHEN k = 1 THEN load END AS median, CASE WHEN k = 1 THEN load END AS hi FROM (SELECT L.ba, L.ts_utc, load_mw AS load, row_number() OVER (PARTITION BY L.ba ORDER BY L.ts_utc DESC) AS k FROM L JOIN (SELECT ba, min(ts_utc) AS s FROM F2 GROUP BY 1) f ON f.ba = L.ba AND L.ts_utc < s AND L.ts_utc < TIMESTAMP '2024-01-28') UNION ALL SELECT ba, ts_utc, NULL, NULL, load_mw * 0.9, load_mw, load_mw * 1.1 FROM F2) x LEFT JOIN OP ON OP.ba = x.ba AND OP.ts_utc = x.ts_utc",
            F2="SELECT * FROM L WHERE ts_utc >= TIMESTAMP '2024-01-27 12:00:00' AND ts_utc < TIMESTAMP '2024-01-29'",
        ),
        "join_peer_pairs": sql(f"SELECT a.ba, b.ba AS peer, {t('a.ts_utc')}, a.load_mw AS y, b.load_mw AS x FROM L a JOIN L b ON a.ts_utc = b.ts_utc AND a.ba <> b.ba"),
        "join_window_range": sql("SELECT o.ba, o.origin, count(*) FILTER (I.idx >= origin) AS n_after, round(sum(y) FILTER (I.idx >= origin), 4) AS sum_after, count(*) FILTER (I.idx < origin) AS n_before, round(sum(y) FILTER (I.idx < origin), 4) AS sum_before FROM (SELECT * FROM O0 WHERE origin >= 48) o JOIN I ON I.ba = o.ba AND I.idx BETWEEN origin - 48 AND origin + 23 GROUP BY 1, 2"),
        "semi_holdout": sql("SELECT ba, n, CASE WHEN k % 5 = 0 THEN 'holdout' ELSE 'tuned' END AS part FROM (SELECT ba, count(*) AS n, row_number() OVER (ORDER BY ba) - 1 AS k FROM S GROUP BY 1)"),
        "agg_current_load": sql(f"SELECT * FROM (SELECT {t()}, round(sum(load_mw), 7) AS total_mw, count(*) AS ba_count FROM (SELECT CAST(user_id AS VARCHAR) AS ba, date_trunc('hour', ts) AS ts_utc, arg_max(value, (ts, event_id)) AS load_mw FROM events GROUP BY 1, 2) WHERE load_mw > 0 AND load_mw < 400 GROUP BY ts_utc HAVING count(*) >= 10 ORDER BY 1 DESC LIMIT 200)"),
        "agg_centre_mean": sql(
            f"SELECT ba, {t('h', 'ts_utc')}, round(avg(a), 7) AS temp_c, round(avg(b), 7) AS wind FROM PW JOIN CE USING (lat, lon) GROUP BY ba, h",
            CE=_centres(),
            PK="SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) - 1 AS k FROM (SELECT DISTINCT lat, lon FROM CE)",
            PW="SELECT lat, lon, date_trunc('hour', ts) AS h, avg(f) AS a, max(f) FILTER (f > 20) AS b FROM OB JOIN PK ON k = user_id % (SELECT count(*) FROM PK) GROUP BY 1, 2, 3",
        ),
        "agg_hourly_mean": f"SELECT event_type, {t('h', 'ts_utc')}, round(avg(value), 7) AS value FROM (SELECT event_type, date_trunc('hour', ts) AS h, value FROM events) GROUP BY event_type, h",
        "agg_data_end": sql(f"SELECT {t('max(ts_utc)', 'data_end')} FROM L"),
        "agg_split_bounds": sql(_bounds("S")),
        "agg_inner_split": sql("SELECT ba, CAST(fs AS INT) AS inner_start, greatest(train_end - 96, train_end // 2) AS inner_end FROM ME JOIN (SELECT ba, min(fcst_start) AS fs FROM AL GROUP BY 1) USING (ba)"),
        "agg_mase_denominator": sql(f"SELECT ba, {r('denom')} FROM DE"),
        "agg_mase_denominator_dropna": sql("SELECT ba, round(avg(abs(d)), 7) AS denom FROM (SELECT ba, load_mw - lag(load_mw, 24) OVER (PARTITION BY ba ORDER BY ts_utc) AS d FROM C WHERE load_mw IS NOT NULL AND ts_utc < TIMESTAMP '2024-01-21') GROUP BY 1"),
        "agg_robust_mad": sql("SELECT S.ba, round(any_value(m), 7) AS med, round(median(abs(load_mw - m)), 7) AS mad FROM S JOIN (SELECT ba, median(load_mw) AS m FROM S GROUP BY 1) x USING (ba) GROUP BY 1"),
        "agg_point_metrics": sql(f"SELECT ba, {r('mae')}, {r('rmse')}, {r('mase')}, n_points, n_windows FROM PM"),
        "agg_crps": sql("SELECT ba, round((avg(CASE WHEN y >= q_lo THEN 0.1 * (y - q_lo) ELSE 0.9 * (q_lo - y) END) + avg(0.5 * abs(y - q_mid)) + avg(CASE WHEN y >= q_hi THEN 0.9 * (y - q_hi) ELSE 0.1 * (q_hi - y) END)) / 3, 10) AS crps FROM SC GROUP BY 1"),
        "agg_pi_coverage": sql("SELECT ba, round(avg(CASE WHEN y >= q_lo AND y <= q_hi THEN 1.0::DOUBLE ELSE 0.0 END), 7) AS coverage FROM SC GROUP BY 1"),
        "agg_error_scores": sql("SELECT L.ba, count(*) AS n, round(avg(abs(forecast_mw - load_mw)), 7) AS mae, round(sqrt(avg((forecast_mw - load_mw) ** 2)), 7) AS rmse, round(100 * avg(abs(forecast_mw - load_mw) / greatest(load_mw, 1.0)), 7) AS mape, round(avg(forecast_mw - load_mw), 7) AS bias, round(avg(abs(forecast_mw - load_mw)) / any_value(denom), 7) AS mase FROM L JOIN OP ON L.ba = OP.ba AND L.ts_utc = OP.ts_utc LEFT JOIN DN ON DN.ba = L.ba GROUP BY 1"),
        "agg_week_mape": sql("SELECT ba, round(100 * avg(abs(f - a) / CASE WHEN a > 0 THEN a ELSE 1.0 END), 7) AS mape, round(max(CASE WHEN k = 1 THEN f - a END), 7) AS peak_error FROM (SELECT L.ba, load_mw - 150 AS a, forecast_mw AS f, row_number() OVER (PARTITION BY L.ba ORDER BY load_mw - 150 DESC, L.ts_utc) AS k FROM L JOIN OP ON L.ba = OP.ba AND L.ts_utc = OP.ts_utc) GROUP BY 1"),
        "agg_macro": sql("SELECT round(avg(mae), 7) AS mae, round(avg(rmse), 7) AS rmse, round(avg(mase), 7) AS mase, count(*) AS n_series FROM PM"),
        "agg_holdout_gap": sql("SELECT round(a, 7) AS tuned, round(b, 7) AS holdout, round(b - a, 7) AS gap FROM (SELECT avg(mase) FILTER (k % 2 <> 0) AS a, avg(mase) FILTER (k % 2 = 0) AS b FROM (SELECT mase, row_number() OVER (ORDER BY ba) - 1 AS k FROM PM))"),
        "agg_step_mase": sql("SELECT CAST(step AS INT) AS step, round(m, 7) AS mase, CAST(min(CASE WHEN m >= 1 THEN step + 1 END) OVER () AS INT) AS break_even FROM (SELECT step, avg(e / denom) AS m FROM (SELECT ba, step, avg(abs(y - mean)) AS e FROM SC GROUP BY 1, 2) JOIN DE USING (ba) GROUP BY 1)"),
        "agg_skill_vs_baseline": sql(_ratio("SC", "PE")),
        "agg_bootstrap_ci": _bootstrap_sql(200, 0),
        "agg_bootstrap_ci_seeded": _bootstrap_sql(500, 11),
        "agg_conformal_delta": sql(_delta(False)),
        "agg_peer_correlation": sql(f"SELECT ba, peer, {r('r')} FROM PC"),
        "agg_weather_skill": sql("SELECT ba, round(avg(abs(f - a)), 7) AS mae, round(sqrt(avg((f - a) ** 2)), 7) AS rmse, round(corr(f, a), 7) AS corr, round(avg(f - a), 7) AS bias FROM (SELECT ba, temp_c_fcst + hour(ts_utc) / 10.0::DOUBLE AS f, temp_c_anal AS a FROM AR) GROUP BY 1"),
        "agg_forecast_stats": "SELECT CAST(vec_id AS VARCHAR) AS ba, round(max(m) FILTER (step < 24), 7) AS peak, CAST(arg_min(step, (-m, step)) FILTER (step < 24) AS INT) AS peak_step, round(avg(m) FILTER (step < 24), 7) AS mean, round(max(100 * (m * 1.1 - m * 0.9) / m) FILTER (step = 0), 7) AS pi_pct_first, round(100 * (max(m) FILTER (step < 24) / avg(m) FILTER (step < 24) - 1), 7) AS peak_over_mean_pct, round(max(m), 7) AS peak_all FROM (SELECT vec_id, unnest(range(len(embedding))) AS step, CAST(unnest(embedding) AS DOUBLE) + 2 AS m FROM embeddings) GROUP BY vec_id",
        "agg_peak_utilisation": "SELECT ba, round(u, 7) AS utilisation, CASE WHEN u >= 85 THEN 'near-peak' WHEN u >= 55 THEN 'moderate' ELSE 'low' END AS status FROM (SELECT CAST(vec_id AS VARCHAR) AS ba, CASE WHEN vec_id % 5 <> 0 THEN 100 * list_max(embedding[1:24])::DOUBLE / (label + 1) ELSE 0.0 END AS u FROM embeddings)",
        "agg_ingest_counts": sql(f"SELECT 'load' AS feed, ba, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n < 2) AS failures FROM (SELECT ba, {day} AS d, count(*) AS n FROM S GROUP BY 1, 2) GROUP BY 2"),
        "win_dedupe_latest": f"SELECT event_type AS ba, {t('h', 'ts_utc')}, value AS load_mw, {t('ts', 'as_of')}, event_id AS tie FROM (SELECT *, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "win_robust_clean": sql(f"SELECT ba, {t()}, load_mw FROM C"),
        "win_ffill_bfill": sql(
            f"SELECT ba, {t()}, {_filled()} AS load_mw FROM X",
            X="SELECT s.ba, s.ts_utc, load_mw FROM (SELECT ba, unnest(generate_series(min(ts_utc), max(ts_utc), INTERVAL 1 HOUR)) AS ts_utc FROM L GROUP BY ba) s LEFT JOIN C ON C.ba = s.ba AND C.ts_utc = s.ts_utc",
        ),
        "win_block_fill": sql(f"SELECT ba, {t()}, last_value(CASE WHEN dayofyear(ts_utc) % 3 = 0 THEN load_mw END IGNORE NULLS) OVER (PARTITION BY ba ORDER BY ts_utc ROWS UNBOUNDED PRECEDING) AS load_mw FROM D"),
        "win_seasonal_lag": sql("SELECT ba, CAST(idx AS INT) AS idx, y AS load_mw, lag(y, 24, 0.0) OVER w AS lag24, lag(y, 48, 0.0) OVER w AS lag48, lag(y, 168, 0.0) OVER w AS lag168 FROM I WINDOW w AS (PARTITION BY ba ORDER BY idx)"),
        "win_row_index": sql(f"SELECT ba, {t()}, CAST(row_number() OVER (PARTITION BY ba ORDER BY S.ts_utc) - 1 AS INT) AS idx FROM S"),
        "win_rolling_origins": sql(_origins("train_end", "test_end", 30, 24, 400)),
        "win_training_pairs": sql("SELECT I.ba, CAST(idx AS INT) AS idx, c_first, c_last, y AS t_first, t_last FROM (SELECT I.ba, idx, y, train_end, lag(y, 48) OVER w AS c_first, lag(y, 1) OVER w AS c_last, lead(y, 23) OVER w AS t_last FROM I JOIN ME USING (ba) WHERE idx < train_end WINDOW w AS (PARTITION BY I.ba ORDER BY idx)) I WHERE idx >= 48 AND idx + 23 < train_end AND (idx - 48) % 12 = 0"),
        "win_fcst_persistence": sql("SELECT ba, origin, CAST(step AS INT) AS step, mean, y FROM PE"),
        "win_fcst_seasonal_naive": sql("SELECT ba, origin, CAST(step AS INT) AS step, mean, y FROM (" + _naive("I", "O3", 30) + ")", O3=_origins("train_end", "test_end", 30, 24, 168)),
        "win_future_known": sql(
            _future("q.idx", "hour_sin", "hour_sin", i="IC", extra="").replace("q.step,", "CAST(q.step AS INT) AS step,"),
            IC="SELECT ba, idx, sin(hour(ts_utc) * (2 * pi() / 24)) AS hour_sin FROM I",
        ),
        "win_future_persistence": sql(_future("greatest(0, q.origin - 1)", "temp_c", "temp_c").replace("q.step,", "CAST(q.step AS INT) AS step,")),
        "win_future_lag24": sql(_future("greatest(0, least(q.n - 1, q.origin - 24 + q.step % 24))", "temp_c", "temp_c", 30, "O30").replace("q.step,", "CAST(q.step AS INT) AS step,", 1), O30=_origins(h=30)),
        "win_future_forecast": sql(
            f"SELECT o.ba, o.origin, CAST(s.step AS INT) AS step, {r('a.temp_fcst', 'temp_c')}, {r('x.rad', 'rad_fcst')}, {r('x.wind', 'wind_fcst')} FROM O0 o CROSS JOIN (SELECT unnest(range(24)) AS step) s JOIN AL a ON a.ba = o.ba AND a.idx = o.origin + s.step JOIN XF x ON x.ba = o.ba AND x.idx = o.origin + s.step",
        ),
        "win_future_oracle": sql(_future("q.idx", "temp_c", "temp_c").replace("q.step,", "CAST(q.step AS INT) AS step,")),
        "win_lead_guard": sql("SELECT ba, CAST(min(fcst_lead_hours) AS INT) AS fcst_lead_hours, CAST(min(fcst_lead_hours) AS INT) AS longest_horizon FROM AL GROUP BY 1"),
        "win_temp_for_baseline": sql(" UNION ALL ".join(_future(at, c, "temp_c", extra=f", '{p}' AS policy").replace("q.step,", "CAST(q.step AS INT) AS step,", 1) for p, at, c in (("past_only", "greatest(0, q.origin - 1)", "temp_c"), ("persistence", "greatest(0, q.origin - 1)", "temp_c"), ("lag24", "greatest(0, least(q.n - 1, q.origin - 24 + q.step % 24))", "temp_c"), ("forecast", "q.idx", "temp_fcst"), ("oracle", "q.idx", "temp_c")))),
        "win_flatline_runs": sql("SELECT ba, max(n) AS longest, max(n) >= 8 AS flat FROM (SELECT ba, g, count(*) AS n FROM (SELECT ba, k - row_number() OVER (PARTITION BY ba, v ORDER BY k) AS g, v FROM (SELECT ba, floor(load_mw / 100) AS v, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) AS k FROM S)) GROUP BY ba, v, g) GROUP BY 1"),
        "win_peak_week": sql(
            "SELECT CAST(w AS INT) AS week, peak FROM (SELECT w, max(v) FILTER (ba = '1-URGENT') AS peak FROM Z WHERE w * 24 < (SELECT max(rel) + 1 FROM R2 WHERE ba = '1-URGENT') - 168 GROUP BY w HAVING count(*) = 168 * (SELECT count(DISTINCT ba) FROM D) AND min(v) FILTER (ba = '5-LOW') >= 0) ORDER BY peak DESC, w LIMIT 1",
            R2="SELECT ba, v, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) - 1 AS rel FROM (SELECT ba, ts_utc, load_mw AS v FROM D WHERE ts_utc >= TIMESTAMP '1995-06-01')",
            Z="SELECT R2.ba, v, rel, w FROM R2 CROSS JOIN (SELECT unnest(range(200)) AS w) WHERE rel >= w * 24 AND rel < w * 24 + 168",
        ),
        "win_night_bands": sql(
            f"SELECT ba, {t('min(ts_utc)', 'start')}, {t('max(ts_utc)', 'end')} FROM (SELECT ba, ts_utc, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) - k AS g FROM (SELECT ba, ts_utc, row_number() OVER (PARTITION BY ba ORDER BY ts_utc) AS k, (hour(ts_utc) + 19) % 24 AS h FROM (SELECT ba, unnest(generate_series(min(ts_utc), max(ts_utc), INTERVAL 1 HOUR)) AS ts_utc FROM L GROUP BY ba)) WHERE h >= 20 OR h < 6) GROUP BY ba, g"
        ),
        "win_conformal_apply": sql("SELECT ba, origin, CAST(step AS INT) AS step, round(CASE ba WHEN 'click' THEN least(q_lo + 500, q_mid) WHEN 'view' THEN q_lo WHEN 'error' THEN q_lo ELSE least(q_lo - 12.5, q_mid) END, 7) AS q_lo, round(q_mid, 7) AS q_mid, round(CASE ba WHEN 'click' THEN greatest(q_hi - 500, q_mid) WHEN 'view' THEN q_hi WHEN 'error' THEN q_hi ELSE greatest(q_hi + 12.5, q_mid) END, 7) AS q_hi FROM SC"),
        "topk_last_hours_per_ba": sql(f"SELECT ba, {t('x.ts_utc')}, load_mw FROM (SELECT *, row_number() OVER (PARTITION BY ba ORDER BY ts_utc DESC) AS k FROM S WHERE load_mw > 0 AND load_mw < 200000) x WHERE k <= 5"),
        "topk_peers": sql(
            f"SELECT ba, {t('w0.ts_utc')}, " + ", ".join(f"coalesce(last_value(x{i} IGNORE NULLS) OVER w, 0.0) AS nbr{i}" for i in (1, 2, 3)) + " FROM (SELECT I.ba, I.ts_utc, " + ", ".join(f"max(p.y) FILTER (k = {i}) AS x{i}" for i in (1, 2, 3)) + " FROM I LEFT JOIN K3 ON K3.ba = I.ba LEFT JOIN I p ON p.ba = K3.peer AND p.ts_utc = I.ts_utc GROUP BY 1, 2) w0 WINDOW w AS (PARTITION BY ba ORDER BY w0.ts_utc ROWS UNBOUNDED PRECEDING)",
            K3="SELECT ba, peer, k FROM (SELECT *, row_number() OVER (PARTITION BY ba ORDER BY abs(r) DESC, peer DESC) AS k FROM PC) WHERE k <= 3",
        ),
        "sort_ba_grid": sql("SELECT code, peak_mw FROM N"),
        "set_common_timestamps": sql(f"SELECT {t('q.ts_utc')} FROM (SELECT ts_utc FROM L WHERE ba = 'click' INTERSECT SELECT ts_utc FROM L WHERE ba = 'error') q"),
        "set_missing_columns": sql(f"SELECT x.ba, {t('x.ts_utc')}, f.fuel FROM (SELECT DISTINCT ba, ts_utc FROM G) x CROSS JOIN (VALUES ('WND'), ('SUN'), ('OTH')) f(fuel) ANTI JOIN G ON G.ba = x.ba AND G.ts_utc = x.ts_utc AND G.fuel = f.fuel"),
        "set_union_sources": sql(f"SELECT ba, {t()}, load_mw FROM L"),
        "job_feature_table": sql(
            "SELECT x.ba, CAST(x.idx AS INT) AS idx, x.y AS load_mw, round(CASE WHEN x.idx >= fcst_start THEN coalesce(temp_anal, AL.temp_c) ELSE AL.temp_c END, 7) AS temp_c, round(coalesce(wnd, 0), 7) AS wnd, round(coalesce(sun, 0), 7) AS sun, round(temp_fcst, 7) AS temp_fcst, round(XF.rad, 7) AS rad_fcst, round(XF.wind, 7) AS wind_fcst, round(XF.spread, 7) AS spread_fcst, CAST(isodow(x.ts_utc) >= 6 AS INT) AS is_weekend, CAST(CAST(x.ts_utc AS DATE) IN (SELECT day FROM HOL) AS INT) AS is_holiday, nbr1, nbr2 FROM I x JOIN AL ON AL.ba = x.ba AND AL.idx = x.idx JOIN XF ON XF.ba = x.ba AND XF.idx = x.idx LEFT JOIN GF ON GF.ba = x.ba AND GF.idx = x.idx JOIN NB ON NB.ba = x.ba AND NB.ts_utc = x.ts_utc",
            GW="SELECT I.ba, I.ts_utc, idx, CASE WHEN I.ba = 'click' THEN (SELECT avg(value) FROM events e WHERE e.event_type = 'click' AND date_trunc('hour', e.ts) = I.ts_utc) END AS w, CASE WHEN I.ba = 'view' THEN (SELECT avg(value) FROM events e WHERE e.event_type = 'view' AND date_trunc('hour', e.ts) = I.ts_utc) END AS s FROM I",
            GF=f"SELECT ba, idx, {_filled('w')} AS wnd, {_filled('s')} AS sun FROM GW",
            K2="SELECT ba, peer, k FROM (SELECT *, row_number() OVER (PARTITION BY ba ORDER BY abs(r) DESC, peer DESC) AS k FROM PC) WHERE k <= 2",
            NB="SELECT ba, ts_utc, coalesce(last_value(x1 IGNORE NULLS) OVER w, 0.0) AS nbr1, coalesce(last_value(x2 IGNORE NULLS) OVER w, 0.0) AS nbr2 FROM (SELECT I.ba, I.ts_utc, max(p.y) FILTER (k = 1) AS x1, max(p.y) FILTER (k = 2) AS x2 FROM I LEFT JOIN K2 ON K2.ba = I.ba LEFT JOIN I p ON p.ba = K2.peer AND p.ts_utc = I.ts_utc GROUP BY 1, 2) WINDOW w AS (PARTITION BY ba ORDER BY ts_utc ROWS UNBOUNDED PRECEDING)",
        ),
        "job_backtest": sql(
            f"SELECT ba, CAST(NULL AS INT) AS step, {r('mae')}, {r('rmse')}, {r('mase')}, n_points, n_windows, CAST(NULL AS DOUBLE) AS ci_lo, CAST(NULL AS DOUBLE) AS ci_hi, round(coalesce(d, 0), 7) AS delta_mw, {r('coverage_raw')}, {r('coverage')} FROM P20 LEFT JOIN D20 USING (ba) JOIN V20 USING (ba)"
            " UNION ALL SELECT 'MACRO', NULL, round(avg(mae), 7), round(avg(rmse), 7), round(avg(mase), 7), CAST(sum(n_points) AS BIGINT), CAST(sum(n_windows) AS BIGINT), any_value(lo), any_value(hi), round(avg(coalesce(d, 0)), 7), round(avg(coverage_raw), 7), round(avg(coverage), 7) FROM P20 LEFT JOIN D20 USING (ba) JOIN V20 USING (ba) CROSS JOIN CI20"
            " UNION ALL SELECT 'MACRO', CAST(step AS INT), NULL, NULL, round(avg(e / denom), 7), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT ba, step, avg(abs(y - mean)) AS e FROM SC20 GROUP BY 1, 2) JOIN DE20 USING (ba) GROUP BY step",
            P20="SELECT ba, avg(abs(y - mean)) AS mae, sqrt(avg((y - mean) ** 2)) AS rmse, avg(abs(y - mean)) / any_value(denom) AS mase, count(*) AS n_points, count(DISTINCT origin) AS n_windows FROM SC20 JOIN DE20 USING (ba) GROUP BY 1",
            SV20=_naive("I20", "OV"),
            D20=f"SELECT ba, d FROM ({_delta_of('(SELECT *, mean * 0.9 AS q_lo, mean * 1.1 AS q_hi FROM SV20)')})",
            V20="SELECT SC20.ba, avg(CASE WHEN y BETWEEN mean * 0.9 AND mean * 1.1 THEN 1.0::DOUBLE ELSE 0.0 END) AS coverage_raw, avg(CASE WHEN y BETWEEN mean * 0.9 - coalesce(d, 0) AND mean * 1.1 + coalesce(d, 0) THEN 1.0::DOUBLE ELSE 0.0 END) AS coverage FROM SC20 LEFT JOIN D20 USING (ba) GROUP BY 1",
            E20="SELECT x.ba, origin, avg(abs(y - mean)) / any_value(denom) AS err FROM SC20 x JOIN DE20 USING (ba) GROUP BY 1, 2",
            CI20=_bootstrap_sql(200, 0, "SELECT * FROM E20"),
        ),
        "job_hourly_regression": _regression_sql(),
        "job_ensemble": sql("SELECT ba, round(avg(abs(y - m)), 10) AS mae, round(sqrt(avg((y - m) ** 2)), 10) AS rmse, round(avg(abs(y - m)) / any_value(denom), 10) AS mase, count(*) AS n_points, count(DISTINCT origin) AS n_windows FROM (SELECT ba, origin, step, any_value(y) AS y, avg(mean) AS m FROM (SELECT ba, origin, step, y, mean FROM SC UNION ALL SELECT ba, origin, step, y, mean FROM PE) GROUP BY 1, 2, 3) JOIN DE USING (ba) GROUP BY 1"),
        "job_causal_audit": sql(
            "SELECT ba, origin, covariate, problem FROM AO CROSS JOIN (VALUES ('load_mw', 'leak'), ('hour_sin', 'missing')) v(covariate, problem)",
            AO="SELECT DISTINCT ba, lo + ((hi - lo) * i) // 3 AS origin FROM (SELECT ba, CASE WHEN test_end - val_end >= 24 THEN val_end ELSE train_end END AS lo, CASE WHEN test_end - val_end >= 24 THEN test_end ELSE val_end END - 24 AS hi FROM ME) CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) WHERE hi >= lo",
        ),
        "job_timestamp_only_audit": sql("SELECT 'dow_sin' AS covariate, count(*) AS timestamps FROM (SELECT ts_utc FROM L GROUP BY 1 HAVING hour(ts_utc) = 3 AND count(*) > 1 AND bool_or(ba = 'view')) HAVING count(*) > 0"),
        "job_operator_comparison": sql(
            "SELECT L.ba, count(*) AS n, round(avg(abs(F.mean - load_mw)), 7) AS mae_own, round(avg(abs(F.mean - load_mw)) / any_value(denom), 7) AS mase_own, round(avg(abs(forecast_mw - load_mw)), 7) AS mae_op, round(avg(abs(forecast_mw - load_mw)) / any_value(denom), 7) AS mase_op, round(avg(abs(forecast_mw - load_mw)) / avg(abs(F.mean - load_mw)), 7) AS mae_ratio FROM L JOIN F ON F.ba = L.ba AND F.ts_utc = L.ts_utc JOIN OP ON OP.ba = L.ba AND OP.ts_utc = L.ts_utc JOIN DE ON DE.ba = L.ba GROUP BY 1",
            F="SELECT SC.ba, I.ts_utc, mean FROM SC JOIN I ON I.ba = SC.ba AND I.idx = SC.idx",
        ),
        "job_conformal_fit": sql(_delta(True)),
        "job_serve_batch": sql(f"SELECT ba, CAST(step AS INT) AS step, {t('x.ts_utc')}, round(sin(hour(x.ts_utc) * (2 * pi() / 24)), 7) AS hour_sin, CAST(isodow(x.ts_utc) >= 6 AS INT) AS is_weekend, CASE WHEN ba <> 'click' THEN hour(x.ts_utc)::DOUBLE END AS temp_c FROM (SELECT ba, s - 1 AS step, e + to_hours(CAST(s AS INT)) AS ts_utc FROM (SELECT ba, max(ts_utc) AS e FROM I GROUP BY 1 HAVING count(*) >= 100) CROSS JOIN (SELECT unnest(range(1, 25)) AS s)) x"),
        "udf_forecaster": sql("SELECT o.ba, o.origin, CAST(s.step AS INT) AS step, I.y AS mean FROM (SELECT * FROM O0 WHERE origin >= 48) o CROSS JOIN (SELECT unnest(range(24)) AS step) s JOIN I ON I.ba = o.ba AND I.idx = o.origin - 24 + s.step"),
        "stream_ingest_append": sql(f"SELECT ba, CAST(2024 AS INT) AS year, CAST(1 AS INT) AS month, count(*) AS n, {_sum('load_mw')} AS total FROM (SELECT * FROM L UNION ALL SELECT * FROM L WHERE ts_utc >= TIMESTAMP '2024-01-27') GROUP BY 1"),
        "stream_dedupe_revisions": f"SELECT event_type AS ba, {t('h', 'ts_utc')}, value AS load_mw, event_id AS tie FROM (SELECT *, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "stream_current_load": sql(f"SELECT {t('ts_utc')}, round(sum(load_mw), 7) AS total_mw, count(*) AS ba_count FROM (SELECT user_id, date_trunc('hour', ts) AS ts_utc, arg_max(value, (ts, event_id)) AS load_mw FROM events GROUP BY 1, 2) WHERE load_mw > 0 AND load_mw < 200000 AND ts_utc < TIMESTAMP '2024-01-20' GROUP BY ts_utc HAVING count(*) >= 5"),
        "stream_rolling_24h": sql(f"SELECT {t('w', 'w_start')}, {t('w + INTERVAL 24 HOUR', 'w_end')}, round(sum(load_mw), 7) AS total_mw, count(*) AS n FROM (SELECT load_mw, ts_utc - to_hours(CAST(k AS INT)) AS w FROM L CROSS JOIN (SELECT unnest(range(24)) AS k)) WHERE w + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-25' GROUP BY w"),
        "stream_gap_sessions": sql(f"SELECT ba, {t('a', 's_start')}, {t('e', 's_end')}, n FROM (SELECT ba, min(ts_utc) AS a, max(ts_utc) + INTERVAL 3 HOUR AS e, count(*) AS n FROM (SELECT ba, ts_utc, sum(b) OVER (PARTITION BY ba ORDER BY ts_utc) AS g FROM (SELECT ba, ts_utc, CASE WHEN ts_utc <= lag(ts_utc) OVER (PARTITION BY ba ORDER BY ts_utc) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS b FROM S)) GROUP BY ba, g) WHERE e < TIMESTAMP '2024-01-24'"),
        "stream_late_counts": f"""
WITH e AS (SELECT date_trunc('hour', ts) AS h FROM events),
p AS (SELECT 0 AS batch, h FROM e WHERE h < TIMESTAMP '2024-01-10' UNION ALL SELECT 1, h FROM e WHERE h >= TIMESTAMP '2024-01-10' AND h < TIMESTAMP '2024-01-20'
    UNION ALL SELECT 2, h FROM e WHERE h >= TIMESTAMP '2024-01-20' UNION ALL SELECT 3, h FROM e WHERE h < TIMESTAMP '2024-01-03' OR h >= TIMESTAMP '2024-01-29'),
m AS (SELECT batch, max(h) AS latest, count(*) AS n_rows FROM p GROUP BY batch),
w AS (SELECT a.batch, max(b.latest) - INTERVAL 72 HOUR AS mark FROM m a LEFT JOIN m b ON b.batch < a.batch - 1 GROUP BY a.batch)
SELECT CAST(m.batch AS BIGINT) AS batch, any_value(n_rows) AS n_rows, count(*) FILTER (WHERE p.h <= mark) AS late_rows, {t('any_value(latest)', 'latest')}
FROM p JOIN m USING (batch) JOIN w USING (batch) GROUP BY m.batch""",
        "stream_late_rows": sql(f"SELECT {t('w', 'w_start')}, round(sum(load_mw), 4) AS total_mw FROM (SELECT load_mw, ts_utc - to_hours(CAST(k AS INT)) AS w FROM L CROSS JOIN (SELECT unnest(range(24)) AS k)) WHERE w + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-25' GROUP BY w"),
    }
    return out
