"""The registered queries in SQL for DuckDB, from the same ``events`` table.

Written independently of the Spark plans: JSON functions and CASE chains instead of declared schemas
and column builders. ``WITH`` clauses are put together from named steps.
"""

from __future__ import annotations

AS_OF = "timestamp '2024-01-30 18:00:00'"

_STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def _step(name: str, *needs: str):
    def add(sql: str) -> None:
        _STEPS[name] = (needs, sql)
    return add


_step("numbered")("""
SELECT event_id, user_id, event_type, value, ts AS measured,
       cast(json_extract_string(props, '$.k') AS int) AS k,
       'dev-' || user_id AS device,
       'site-' || ((user_id + CASE WHEN cast(json_extract_string(props, '$.k') AS int) = 11 THEN 1 ELSE 0 END) % 5)
         AS site
FROM events""")

_step("raw", "numbered")("""
SELECT device AS kafka_key,
       cast(user_id % 3 AS int) AS kafka_partition,
       event_id * 2 + copy AS kafka_offset,
       measured + INTERVAL 1 MINUTE AS kafka_ts,
       'farm/' || site || '/' || device || '/telemetry' AS topic,
       CASE k WHEN 1 THEN 'this is not json' WHEN 12 THEN '[1, 2, 3]' WHEN 14 THEN '{' WHEN 17 THEN '{}'
       ELSE '{' || concat_ws(',',
         CASE WHEN k = 9 THEN NULL WHEN k = 15 THEN '"device_id":""' ELSE '"device_id":"' || device || '"' END,
         CASE WHEN k = 10 THEN NULL ELSE '"site_id":"' || site || '"' END,
         CASE k WHEN 2 THEN NULL WHEN 5 THEN '"ts":"yesterday"'
           ELSE '"ts":"' || strftime(CASE k WHEN 3 THEN measured - INTERVAL 30 HOUR WHEN 4 THEN measured + INTERVAL 1 HOUR
                                     ELSE measured END, '%Y-%m-%dT%H:%M:%S.%fZ') || '"' END,
         '"soil_moisture_pct":' || CASE WHEN k IN (6, 10) THEN 'null' WHEN k = 20 THEN '"oops"'
                                   ELSE cast(cast(value AS decimal(10,2)) AS varchar)
                                     || lpad(cast(event_id * 7919 % 10000000 AS varchar), 7, '0') END,
         '"soil_raw":' || CASE WHEN k = 18 THEN '5000' ELSE cast(cast(trunc(3200 - value * 20) AS int) AS varchar) END,
         '"air_temp_c":' || CASE WHEN k = 8 THEN '999.9'
                            ELSE cast(cast((k * 9 - 200) / 10.0 AS decimal(5,1)) AS varchar)
                              || lpad(cast(event_id * 104729 % 100000000 AS varchar), 8, '0') END,
         '"air_humidity_pct":' || CASE WHEN k = 16 THEN 'null'
                                  ELSE cast(cast(40 + k * 6 / 10.0 AS decimal(5,1)) AS varchar)
                                  || lpad(cast(event_id * 15485863 % 100000000 AS varchar), 8, '0') END,
         '"battery_v":' || CASE WHEN k = 18 THEN '9.9' ELSE cast(cast(3 + k / 100.0 AS decimal(4,2)) AS varchar) END,
         '"fw_version":"1.' || (user_id % 12) || '.0"') || '}' END AS raw_value
FROM (SELECT *, unnest(CASE WHEN k = 7 THEN [0, 1] ELSE [0] END) AS copy FROM numbered)""")

_step("objects", "raw")("""
SELECT *, json_valid(raw_value) AS readable,
       CASE WHEN json_valid(raw_value) THEN json_type(raw_value) = 'OBJECT' END AS is_object,
       CASE WHEN json_valid(raw_value) AND json_type(raw_value) = 'OBJECT' THEN raw_value END AS obj
FROM raw""")

_step("parsed", "objects")("""
SELECT kafka_key, kafka_partition, kafka_offset, kafka_ts, raw_value,
       json_extract_string(obj, '$.device_id') AS device_id,
       json_extract_string(obj, '$.site_id') AS site_id,
       try_cast(json_extract_string(obj, '$.ts') AS timestamp) AS ts,
       try_cast(json_extract_string(obj, '$.soil_moisture_pct') AS double) AS soil_moisture_pct,
       try_cast(json_extract_string(obj, '$.soil_raw') AS int) AS soil_raw,
       try_cast(json_extract_string(obj, '$.air_temp_c') AS double) AS air_temp_c,
       try_cast(json_extract_string(obj, '$.air_humidity_pct') AS double) AS air_humidity_pct,
       try_cast(json_extract_string(obj, '$.battery_v') AS double) AS battery_v,
       json_extract_string(obj, '$.fw_version') AS fw_version
FROM objects""")

_step("structured", "objects")("""
SELECT *, nullif(json_extract_string(obj, '$.device_id'), '') AS record_key,
  CASE WHEN NOT readable THEN 'invalid_json'
       WHEN NOT is_object THEN 'not_an_object'
       WHEN absent <> '' THEN 'missing_fields:' || absent
       WHEN try_cast(json_extract_string(obj, '$.ts') AS timestamp) IS NULL THEN 'unparseable_ts' END AS verdict
FROM (SELECT *, concat_ws(',',
        CASE WHEN coalesce(json_extract_string(obj, '$.device_id'), '') = '' THEN 'device_id' END,
        CASE WHEN coalesce(json_extract_string(obj, '$.site_id'), '') = '' THEN 'site_id' END,
        CASE WHEN coalesce(json_extract_string(obj, '$.ts'), '') = '' THEN 'ts' END) AS absent
      FROM objects)""")

_step("checked", "parsed")("""
SELECT *, CASE
    WHEN device_id IS NULL AND site_id IS NULL AND ts IS NULL THEN 'unparseable_payload'
    WHEN device_id IS NULL OR site_id IS NULL OR ts IS NULL OR soil_moisture_pct IS NULL THEN
      'completeness:' || concat_ws(',', CASE WHEN device_id IS NULL THEN 'device_id' END,
        CASE WHEN site_id IS NULL THEN 'site_id' END, CASE WHEN ts IS NULL THEN 'ts' END,
        CASE WHEN soil_moisture_pct IS NULL THEN 'soil_moisture_pct' END)
    WHEN soil_moisture_pct NOT BETWEEN 0 AND 100 OR air_temp_c NOT BETWEEN -40 AND 80
      OR air_humidity_pct NOT BETWEEN 0 AND 100 OR soil_raw NOT BETWEEN 0 AND 4095
      OR battery_v NOT BETWEEN 2.5 AND 5.0 THEN
      'range:' || concat_ws(',', CASE WHEN soil_moisture_pct NOT BETWEEN 0 AND 100 THEN 'soil_moisture_pct' END,
        CASE WHEN air_temp_c NOT BETWEEN -40 AND 80 THEN 'air_temp_c' END,
        CASE WHEN air_humidity_pct NOT BETWEEN 0 AND 100 THEN 'air_humidity_pct' END,
        CASE WHEN soil_raw NOT BETWEEN 0 AND 4095 THEN 'soil_raw' END,
        CASE WHEN battery_v NOT BETWEEN 2.5 AND 5.0 THEN 'battery_v' END)
    WHEN ts > kafka_ts + INTERVAL 5 MINUTE THEN 'plausibility:future_ts'
    WHEN ts < kafka_ts - INTERVAL 24 HOUR THEN 'plausibility:stale_ts' END AS quality_reason
FROM parsed""")

_step("passed", "checked")("SELECT * FROM checked WHERE quality_reason IS NULL")

_step("clean", "passed")("""
SELECT device_id, site_id, ts, cast(ts AS date) AS date, soil_moisture_pct, soil_raw, air_temp_c,
       air_humidity_pct, battery_v, fw_version, kafka_partition, kafka_offset
FROM passed
QUALIFY row_number() OVER (PARTITION BY device_id, ts ORDER BY kafka_offset, kafka_partition) = 1""")

_step("quarantine", "checked")("""
SELECT split_part(quality_reason, ':', 1) AS quality_rule, quality_reason, device_id, site_id, ts,
       cast(kafka_ts AS date) AS date, kafka_ts, kafka_partition, kafka_offset, raw_value
FROM checked WHERE quality_reason IS NOT NULL""")

_step("stg", "clean")("""
SELECT device_id, site_id, ts AS measured_at, date AS measured_date, soil_moisture_pct, soil_raw,
       air_temp_c, air_humidity_pct, battery_v, fw_version FROM clean""")


def _round(value: str, digits: int) -> str:
    return f"cast(round(cast(cast({value} AS varchar) AS decimal(38,18)), {digits}) AS double)"


def _mean(column: str, digits: int = 2) -> str:
    return f"round(avg({column}), {digits})"


_step("facts", "stg")(f"""
SELECT device_id, site_id, date_trunc('hour', measured_at) AS hour_start,
       cast(date_trunc('hour', measured_at) AS date) AS measured_date,
       count(*) AS reading_count,
       {_mean('soil_moisture_pct')} AS avg_soil_moisture_pct,
       round(min(soil_moisture_pct), 2) AS min_soil_moisture_pct,
       round(max(soil_moisture_pct), 2) AS max_soil_moisture_pct,
       round(max(soil_moisture_pct) - min(soil_moisture_pct), 2) AS soil_moisture_range_pct,
       {_mean('air_temp_c')} AS avg_air_temp_c,
       {_mean('air_humidity_pct')} AS avg_air_humidity_pct,
       round(min(battery_v), 3) AS min_battery_v
FROM stg GROUP BY 1, 2, 3, 4""")

_step("dims", "stg")(f"""
SELECT device_id, max(site_id) AS site_id, max(fw_version) AS fw_version,
       min(measured_at) AS first_seen_at, max(measured_at) AS last_seen_at,
       date_diff('minute', max(measured_at), {AS_OF}) AS minutes_since_last_reading,
       count(*) AS total_readings, count(DISTINCT measured_date) AS active_days,
       round(min(battery_v), 3) AS min_battery_v,
       {_mean('soil_moisture_pct')} AS avg_soil_moisture_pct,
       round(min(soil_moisture_pct), 2) AS min_soil_moisture_pct,
       round(max(soil_moisture_pct), 2) AS max_soil_moisture_pct
FROM stg GROUP BY 1""")

_step("newest", "passed")("""
SELECT device_id, site_id, ts, soil_moisture_pct, battery_v, fw_version, kafka_partition, kafka_offset
FROM passed
QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, kafka_offset, kafka_partition) = 1""")

_step("parts", "passed", "numbered")("""
SELECT p.*, least((day(n.measured) - 1) // 8 + CASE WHEN n.k BETWEEN 40 AND 49 THEN 1 ELSE 0 END, 3) AS part
FROM passed p JOIN numbered n ON n.event_id = p.kafka_offset // 2""")

_step("late", "parts")("""
SELECT * FROM parts p JOIN (
  SELECT q.part AS part_no, max(date_trunc('millisecond', ts)) - INTERVAL 10 MINUTE AS watermark
  FROM (SELECT DISTINCT part FROM parts) q JOIN parts o ON o.part < q.part GROUP BY 1) w ON w.part_no = p.part
WHERE p.ts <= w.watermark""")

_step("status", "numbered")("""
SELECT device AS device_id,
       CASE event_type WHEN 'click' THEN 'unknown' WHEN 'error' THEN 'offline' ELSE 'online' END AS status,
       CASE event_type WHEN 'error' THEN 'last_will' END AS reason,
       event_id AS received_order
FROM numbered WHERE event_type <> 'purchase'
QUALIFY row_number() OVER (PARTITION BY device ORDER BY event_id DESC) = 1""")

_step("feat", "facts")("""
SELECT device_id, site_id, hour_start, avg_soil_moisture_pct, min_soil_moisture_pct, max_soil_moisture_pct,
       soil_moisture_range_pct, avg_air_temp_c, avg_air_humidity_pct,
       avg_soil_lag1, avg_soil_lag2, avg_soil_lag3, min_soil_lag1, min_soil_lag2, min_soil_lag3,
       avg_soil_moisture_pct - avg_soil_lag1 AS delta_1h, avg_soil_moisture_pct - avg_soil_lag3 AS delta_3h,
       sin(2 * pi() * hour(hour_start) / 24) AS hour_sin, cos(2 * pi() * hour(hour_start) / 24) AS hour_cos,
       reading_count,
       CASE WHEN next_min < 32.0 THEN 1.0::double ELSE 0.0::double END AS needs_irrigation_next_hour
FROM (SELECT *,
        lag(avg_soil_moisture_pct, 1) OVER w AS avg_soil_lag1, lag(avg_soil_moisture_pct, 2) OVER w AS avg_soil_lag2,
        lag(avg_soil_moisture_pct, 3) OVER w AS avg_soil_lag3, lag(min_soil_moisture_pct, 1) OVER w AS min_soil_lag1,
        lag(min_soil_moisture_pct, 2) OVER w AS min_soil_lag2, lag(min_soil_moisture_pct, 3) OVER w AS min_soil_lag3,
        lead(min_soil_moisture_pct, 1) OVER w AS next_min
      FROM facts WINDOW w AS (PARTITION BY device_id ORDER BY hour_start, site_id))
WHERE avg_soil_lag3 IS NOT NULL AND avg_air_temp_c IS NOT NULL AND avg_air_humidity_pct IS NOT NULL""")


def _ratio(part: str, whole: str) -> str:
    return f"round_even(CASE WHEN ({whole}) = 0 THEN 0.0::double ELSE cast({part} AS double) / ({whole}) END, 4)"


def _scores(said: str, truth: str = "needs_irrigation_next_hour = 1") -> dict[str, str]:
    hit = f"count(*) FILTER (WHERE {said} AND {truth})"
    claimed = f"count(*) FILTER (WHERE {said})"
    real = f"count(*) FILTER (WHERE {truth})"
    return {
        "accuracy": _ratio(f"count(*) FILTER (WHERE ({said}) = ({truth}))", "count(*)"),
        "precision": _ratio(hit, claimed),
        "recall": _ratio(hit, real),
        "f1": _ratio(f"2 * {hit}", f"{claimed} + {real}"),
    }


_F1 = {
    "base": _scores("min_soil_moisture_pct < 34.0")["f1"],
    "lr": _scores("min_soil_moisture_pct < 30.0")["f1"],
    "rf": _scores("(min_soil_moisture_pct < 36.0 AND min_soil_lag1 < 60.0)")["f1"],
}

_step("versions", "feat")(f"""
SELECT version, CASE WHEN rf > lr THEN 'random_forest' ELSE 'logistic_regression' END AS selected_model,
       greatest(lr, rf) AS f1, base AS baseline_f1
FROM (SELECT strftime(hour_start, '%Y%m%dT000000Z') AS version,
             {_F1['base']} AS base, {_F1['lr']} AS lr, {_F1['rf']} AS rf
      FROM feat GROUP BY 1)""")



def _query(step: str | tuple[str, ...], body: str) -> str:
    """``body`` behind a WITH clause of the steps it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in _STEPS[name][0]:
                visit(need)
            order.append(name)

    for name in (step,) if isinstance(step, str) else step:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_STEPS[n][1]})" for n in order) + "\n" + body


def _rate(source: str, time: str, minutes: int, *by: str) -> str:
    keys = "".join(f", {b}" for b in by)
    return (f"SELECT time_bucket(INTERVAL {minutes} MINUTE, {time}, timestamp '1970-01-01') AS window_start{keys}, "
            f"count(*) AS n, count(*) / {minutes * 60}.0::double AS per_second FROM {source} GROUP BY ALL")


_STATE = "device_id, site_id, ts, soil_moisture_pct, battery_v, fw_version, kafka_partition, kafka_offset"
_ALARM = "CASE WHEN silence_s >= 900 THEN 'alarm' WHEN silence_s >= 300 THEN 'warn' WHEN silence_s IS NOT NULL THEN 'ok' END"
_RULE = _scores("min_soil_moisture_pct < 34.0")
_CUT = "(SELECT make_timestamp(cast(floor(quantile_cont(epoch_us(hour_start), 0.7)) AS bigint)) FROM feat)"


def _checks(table: str, rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS check_name, count(*) AS failures, count(*) = 0 AS passed FROM {table} WHERE {bad}"
        for kind, bad in rules)


_COEFFICIENTS = [
    "avg_soil_moisture_pct", "min_soil_moisture_pct", "max_soil_moisture_pct", "soil_moisture_range_pct",
    "avg_air_temp_c", "avg_air_humidity_pct", "avg_soil_lag1", "avg_soil_lag2", "avg_soil_lag3", "min_soil_lag1",
    "min_soil_lag2", "min_soil_lag3", "delta_1h", "delta_3h", "hour_sin", "hour_cos", "reading_count", "(intercept)",
]


def _version(day: str) -> str:
    """A run on the history before a day: its sizes, and the rule's scores on the later part."""
    seen = f"(SELECT * FROM feat WHERE hour_start < timestamp '{day}')"
    split = f"""(SELECT *, needs_irrigation_next_hour AS y, hour_start <= (SELECT make_timestamp(cast(floor(
        quantile_cont(epoch_us(hour_start), 0.7)) AS bigint)) FROM {seen}) AS early FROM {seen})"""
    return f"""SELECT strftime(timestamp '{day}', '%Y%m%dT%H%M%SZ') AS version, sizes.*, scores.* FROM
        (SELECT count(*) AS rows_total, count(*) FILTER (WHERE early) AS rows_train,
           count(*) FILTER (WHERE NOT early) AS rows_test, count(DISTINCT device_id) AS devices,
           round_even(avg(y) FILTER (WHERE early), 4) AS positive_rate_train,
           round_even(avg(y) FILTER (WHERE NOT early), 4) AS positive_rate_test FROM {split}) sizes,
        (SELECT {", ".join(f'{c} AS "{n}"' for n, c in _RULE.items())} FROM {split} WHERE NOT early) scores"""


_NULLS = [(f"not_null_stg_telemetry_{c}", f"{c} IS NULL") for c in ("device_id", "measured_at", "soil_moisture_pct")]
_SUMMARY = " UNION ALL ".join([
    _checks("stg", _NULLS + [
        ("accepted_range_stg_telemetry_soil_moisture_pct", "soil_moisture_pct NOT BETWEEN 0 AND 100"),
        ("accepted_range_stg_telemetry_air_temp_c", "air_temp_c NOT BETWEEN -40 AND 80")]),
    _checks("facts", [(f"not_null_fct_readings_hourly_{c}", f"{c} IS NULL")
                          for c in ("device_id", "hour_start", "reading_count")] + [
        ("accepted_range_fct_readings_hourly_reading_count", "reading_count NOT BETWEEN 1 AND 100000"),
        ("accepted_range_fct_readings_hourly_avg_soil_moisture_pct", "avg_soil_moisture_pct NOT BETWEEN 0 AND 100")]),
    _checks("dims", [("not_null_dim_devices_device_id", "device_id IS NULL"),
                         ("not_null_dim_devices_total_readings", "total_readings IS NULL"),
                         ("accepted_range_dim_devices_min_battery_v", "min_battery_v NOT BETWEEN 2.5 AND 5.0")]),
    _checks("(SELECT device_id FROM dims WHERE device_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
            [("unique_dim_devices_device_id", "true")]),
])

_LETTERS = """SELECT record_key AS key, split_part(verdict, ':', 1) AS family, topic AS mqtt_topic,
    strftime(kafka_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS received_at, raw_value AS payload
    FROM structured WHERE verdict IS NOT NULL"""

ORACLE: dict[str, str] = {
    "parse_flatten": _query("parsed", "SELECT * FROM parsed"),
    "structural_verdicts": _query("structured", "SELECT kafka_partition, kafka_offset, record_key, verdict FROM structured"),
    "dead_letters": _query("structured", _LETTERS),
    "dead_letters_by_family": _query("structured", """SELECT
        CASE WHEN verdict IS NULL THEN 'forwarded' ELSE 'dead_lettered' END AS result,
        coalesce(split_part(verdict, ':', 1), 'none') AS family, count(*) AS messages FROM structured GROUP BY ALL"""),
    "gate_verdicts": _query("checked", "SELECT kafka_partition, kafka_offset, quality_reason FROM checked"),
    "clean_rows": _query("clean", "SELECT * FROM clean"),
    "state_candidates": _query("passed", f"SELECT {_STATE} FROM passed"),
    "quarantine_rows": _query("quarantine", "SELECT * FROM quarantine"),
    "quarantine_by_rule": _query("quarantine", "SELECT quality_rule, count(*) AS n FROM quarantine GROUP BY 1"),
    "rejection_rate": _query(("clean", "quarantine"), """SELECT clean, quarantined, clean + quarantined AS total,
        quarantined / cast(clean + quarantined AS double) AS rejection_rate
        FROM (SELECT (SELECT count(*) FROM clean) AS clean, (SELECT count(*) FROM quarantine) AS quarantined)"""),
    "clean_range_violations": _query(("parsed", "clean"), " UNION ALL ".join(
        f"SELECT count(*) AS violations, '{t}' AS stage FROM {t} WHERE soil_moisture_pct IS NULL "
        "OR soil_moisture_pct NOT BETWEEN 0 AND 100" for t in ("parsed", "clean"))),
    "duplicate_keys": _query(("passed", "clean"), " UNION ALL ".join(
        f"SELECT count(*) AS duplicate_keys, '{label}' AS stage FROM "
        f"(SELECT device_id, ts FROM {t} GROUP BY 1, 2 HAVING count(*) > 1)"
        for t, label in (("passed", "passing"), ("clean", "clean")))),
    "device_breakdown": _query("clean", f"""SELECT device_id, count(*) AS n,
        {_round('min(soil_moisture_pct)', 1)} AS lowest, {_round('max(soil_moisture_pct)', 1)} AS highest
        FROM clean GROUP BY 1"""),
    "partition_inventory": _query("clean", "SELECT site_id, date, count(*) AS n FROM clean GROUP BY 1, 2"),
    "staging": _query("stg", "SELECT * FROM stg"),
    "fct_readings_hourly": _query("facts", "SELECT * FROM facts"),
    "dim_devices": _query("dims", "SELECT * FROM dims"),
    "mart_validation": _query(("facts", "dims"), """SELECT fact_rows, devices, empty_buckets, lag_hours, concat_ws('; ',
        CASE WHEN fact_rows = 0 THEN 'no rows in fct_readings_hourly' END,
        CASE WHEN devices = 0 THEN 'no rows in dim_devices' END,
        CASE WHEN empty_buckets > 0 THEN empty_buckets || ' hours hold no reading' END,
        CASE WHEN lag_hours > 26 THEN 'newest hour lies ' || lag_hours || 'h back, 26h are allowed' END) AS problems
        FROM (SELECT count(*) AS fact_rows, (SELECT count(*) FROM dims) AS devices,
                     count(*) FILTER (WHERE reading_count < 1) AS empty_buckets,
                     date_diff('hour', max(hour_start), timestamp '2024-02-05 00:00:00') AS lag_hours FROM facts)"""),
    "late_records": _query("late", """SELECT device_id, ts, soil_moisture_pct, soil_raw, air_temp_c, air_humidity_pct, battery_v,
        fw_version, kafka_partition, kafka_offset, site_id, cast(ts AS date) AS date FROM late
        QUALIFY row_number() OVER (PARTITION BY device_id, ts ORDER BY kafka_offset, kafka_partition) = 1"""),
    "stream_recovered": _query("clean", "SELECT * EXCLUDE (kafka_partition, kafka_offset) FROM clean"),
    "watermark_drops": _query("late", "SELECT count(*) AS dropped_rows FROM late"),
    "last_batch_duration": "SELECT unnest(['clean', 'quarantine']) AS query, true AS timed",
    "mart_refreshes": _query("facts", "SELECT * FROM facts"),
    "dimension_refreshes": _query("dims", "SELECT * FROM dims"),
    "mart_changes": _query("clean", """SELECT DISTINCT CASE WHEN date > '2024-01-20' THEN 2
        WHEN date = '2024-01-15' AND kafka_partition = 2 THEN 3 ELSE 1 END::bigint AS version, date AS day, true AS grown,
        0::bigint AS lost_files FROM clean"""),
    "check_not_null": _query(("parsed", "stg"), " UNION ALL ".join(
        f"SELECT *, '{label}' AS stage FROM ({_checks(source, _NULLS)})"
        for source, label in (("(SELECT *, ts AS measured_at FROM parsed)", "parsed"), ("stg", "staging")))),
    "check_unique": _query(("facts", "dims"), """SELECT 'dim_devices' AS model, device_id,
        cast(NULL AS timestamp) AS hour_start, count(*) AS occurrences FROM dims GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'fct_readings_hourly', device_id, hour_start, count(*) FROM facts GROUP BY 2, 3 HAVING count(*) > 1"""),
    "check_accepted_range": _query("parsed", """SELECT air_temp_c AS offending_value, count(*) AS occurrences,
        'air_temp_c' AS "column" FROM parsed WHERE air_temp_c < -40 OR air_temp_c > 80 GROUP BY 1
        UNION ALL SELECT soil_moisture_pct, count(*), 'soil_moisture_pct' FROM parsed
        WHERE soil_moisture_pct <= 0 OR soil_moisture_pct >= 100 GROUP BY 1"""),
    "check_summary": _query(("facts", "dims"), _SUMMARY),
    "history_summary": _query("clean", f"""SELECT count(*) AS readings, min(ts) AS first_ts, max(ts) AS last_ts,
        count(DISTINCT device_id) AS devices, count(DISTINCT cast(ts AS date)) AS days,
        {_round('min(soil_moisture_pct)', 1)} AS lowest, {_round('max(soil_moisture_pct)', 1)} AS highest FROM clean"""),
    "latest_state": _query("newest", f"SELECT {_STATE} FROM newest"),
    "state_merge": _query("newest", f"SELECT {_STATE} FROM newest"),
    "device_status": _query("status", "SELECT * FROM status"),
    "silent_devices": _query(("newest", "status"), f"""SELECT device_id, site_id, age_minutes, status,
        CASE WHEN age_minutes <= 15 THEN 'healthy' WHEN status = 'offline' THEN 'expected_outage'
             WHEN status = 'online' THEN 'ghost' ELSE 'unknown' END AS "class"
        FROM (SELECT device_id, site_id, round_even((epoch_us({AS_OF}) - epoch_us(ts)) / 60000000.0::double, 1)
              AS age_minutes FROM newest) LEFT JOIN (SELECT device_id, status FROM status) USING (device_id)"""),
    "fleet_status": _query("newest", f"""
        SELECT device_id, site_id, silence_s, {_ALARM} AS severity, soil_moisture_pct, battery_v
        FROM (SELECT device_id, site_id,
                     cast(floor((epoch_us({AS_OF}) - epoch_us(ts)) / 1000000.0::double) AS bigint) AS silence_s FROM newest)
        FULL JOIN (SELECT device_id, soil_moisture_pct FROM newest WHERE soil_moisture_pct IS NOT NULL) USING (device_id)
        FULL JOIN (SELECT device_id, battery_v FROM newest WHERE battery_v IS NOT NULL) USING (device_id)"""),
    "features": _query("feat", "SELECT * FROM feat"),
    "next_hour_match": _query("feat", """SELECT f.device_id, f.site_id, f.hour_start, f.needs_irrigation_next_hour,
        n.min_soil_moisture_pct AS observed_min,
        CASE WHEN n.min_soil_moisture_pct < 32.0 THEN 1.0::double ELSE 0.0::double END AS observed_label
        FROM feat f JOIN facts n ON n.device_id = f.device_id AND n.site_id = f.site_id
         AND n.hour_start = f.hour_start + INTERVAL 1 HOUR"""),
    "time_split_summary": _query("feat", f"""SELECT count(*) AS rows_total,
        count(*) FILTER (WHERE early) AS rows_train, count(*) FILTER (WHERE NOT early) AS rows_test,
        count(DISTINCT device_id) AS devices, round_even(avg(y), 4) AS positive_rate_overall,
        round_even(avg(y) FILTER (WHERE early), 4) AS positive_rate_train,
        round_even(avg(y) FILTER (WHERE NOT early), 4) AS positive_rate_test,
        min(hour_start) FILTER (WHERE early) AS train_from, max(hour_start) FILTER (WHERE early) AS train_to,
        min(hour_start) FILTER (WHERE NOT early) AS test_from, max(hour_start) FILTER (WHERE NOT early) AS test_to
        FROM (SELECT device_id, hour_start, needs_irrigation_next_hour AS y, hour_start <= {_CUT} AS early FROM feat)"""),
    "rule_baseline_scores": _query("feat", "SELECT " + ", ".join(f'{c} AS "{n}"' for n, c in _RULE.items()) + " FROM feat"),
    "class_weights": _query("feat", """SELECT needs_irrigation_next_hour, count(*) AS n,
        (SELECT count(*) FROM feat) / cast((SELECT count(DISTINCT needs_irrigation_next_hour) FROM feat) * count(*) AS double)
          AS weight FROM feat GROUP BY 1"""),
    "model_selection": _query("versions", "SELECT version, selected_model, f1, baseline_f1 FROM versions"),
    "promotion_decision": _query("versions", """SELECT n.version AS candidate_version, n.selected_model AS candidate_model,
        n.f1 AS candidate_score, n.baseline_f1 AS baseline_score, o.version AS current_version,
        CASE WHEN n.f1 > n.baseline_f1 THEN o.f1 END AS current_score,
        n.f1 > n.baseline_f1 AND (o.version IS NULL OR n.f1 > o.f1) AS promoted,
        CASE WHEN n.f1 <= n.baseline_f1 THEN 'f1 ' || n.f1 || ' is not above the rule with ' || n.baseline_f1
             WHEN o.version IS NULL THEN 'no model in use yet'
             WHEN n.f1 <= o.f1 THEN 'f1 ' || n.f1 || ' is not above ' || o.f1 || ' of version ' || o.version || ' in use'
             ELSE 'f1 rises from ' || o.f1 || ' to ' || n.f1 END AS reason
        FROM (SELECT * FROM versions ORDER BY version DESC LIMIT 1) n
        LEFT JOIN (SELECT * FROM versions WHERE version = '20240110T000000Z') o ON true"""),
    "recalibrated": _query("stg", f"""SELECT s.device_id, s.measured_at, s.soil_raw, s.soil_moisture_pct,
        {_round('''cast(coalesce(dry, 3200) - s.soil_raw AS double) / (coalesce(dry, 3200) - coalesce(wet, 1200))
                   * 100.0::double''', 2)} AS recalibrated_pct
        FROM stg s LEFT JOIN (SELECT 'dev-' || user_id AS device_id, 3200 - count(*) AS dry, 1200 + count(*) AS wet
                              FROM events GROUP BY user_id HAVING count(*) > 60) e ON e.device_id = s.device_id"""),
    "throughput_5m": _query("raw", _rate("raw", "kafka_ts", 5)),
    "outcome_rate_5m": _query("structured", _rate(
        "(SELECT kafka_ts, CASE WHEN verdict IS NULL THEN 'forwarded' ELSE 'dead_lettered' END AS result FROM structured)",
        "kafka_ts", 5, "result")),
    "quarantine_pct_10m": _query("checked", """SELECT window_start, quarantined, clean,
        100.0::double * (quarantined / 600.0::double)
          / greatest(quarantined / 600.0::double + clean / 600.0::double, 0.0001::double) AS quarantine_pct
        FROM (SELECT time_bucket(INTERVAL 10 MINUTE, kafka_ts, timestamp '1970-01-01') AS window_start,
              count(quality_reason) AS quarantined, count(*) FILTER (WHERE quality_reason IS NULL) AS clean
              FROM checked GROUP BY 1)"""),
    "rule_rate_5m": _query("quarantine", _rate("quarantine", "kafka_ts", 5, "quality_rule")),
    "seen_recently": _query("newest", f"SELECT count(*) AS devices FROM newest "
                            "WHERE epoch_us(timestamp '2024-01-30 23:58:00') - epoch_us(ts) < 300000000"),
    "roc_auc": _query("feat", """SELECT round((sum(rank) FILTER (WHERE y = 1) - ones * (ones + 1) / 2.0::double)
          / (ones * zeros::double), 6) AS roc_auc
        FROM (SELECT y, ones, zeros, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::double AS rank
              FROM (SELECT needs_irrigation_next_hour AS y, -min_soil_moisture_pct AS s,
                           count(*) FILTER (WHERE needs_irrigation_next_hour = 1) OVER () AS ones,
                           count(*) FILTER (WHERE needs_irrigation_next_hour = 0) OVER () AS zeros FROM feat))
        GROUP BY ones, zeros"""),
    "moisture_series": _query("passed", """SELECT device_id, soil_moisture_pct FROM passed
        WHERE soil_moisture_pct IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, kafka_offset, kafka_partition) = 1"""),
    "state_table": _query("newest", f"SELECT {_STATE} FROM newest"),
    "backfill_rows": _query("clean", "SELECT * FROM clean WHERE ts < timestamp '2024-01-20 00:00:00'"),
    "stream_quarantine": _query("quarantine", "SELECT * FROM quarantine"),
    "stream_dead_letters": _query("structured", _LETTERS),
    "stream_clean": _query("clean", "SELECT * EXCLUDE (kafka_partition, kafka_offset) FROM clean"),
    "staged_clean": _query("clean", "SELECT * EXCLUDE (kafka_partition, kafka_offset) FROM clean"),
    "staged_quarantine": _query("quarantine", "SELECT * FROM quarantine"),
    "stream_state": _query("newest", f"SELECT {_STATE} FROM newest"),
    "progress_log": _query("checked", """SELECT 'clean' AS query, (SELECT count(*) FROM events) AS input_rows,
        0::bigint AS dropped_rows, count(*) FILTER (WHERE quality_reason IS NULL) AS passing_rows, """ + ", ".join(
        f"count(*) FILTER (WHERE split_part(quality_reason, ':', 1) = '{r}') AS {r}_rows"
        for r in ("unparseable_payload", "completeness", "range", "plausibility")) + " FROM checked"),
    "stored_versions": _query("feat", _version("2024-01-26 00:00:00") + " UNION ALL " + _version("2024-02-01 00:00:00")),
    # Zero derivatives of a convex loss are what makes a fit the optimum; SQL states them, the query measures them.
    "lr_optimality": "SELECT unnest([" + ", ".join(f"'{c}'" for c in _COEFFICIENTS) + "]) AS coefficient, true AS optimal",
}
