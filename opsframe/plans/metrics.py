"""Metric queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opsframe.functions import metrics as fm
from opsframe.functions.time import in_zone, to_ts
from opsframe.operators import metrics as om
from opsframe.plans.adapters import INVENTORY_SQL, SAMPLES_SQL, exprs, inventory, samples
from opsframe.plans.registry import query, table
from opsframe.session import scratch_path
from opsframe.sources.sinks import merge_metrics, write_metrics

DAY, HOUR = 86_400, 3_600
SERIES = ["event_type", "shard"]
_ALLOWED = ", ".join(f"'{m}'" for m in fm.CONTAINER_METRICS)

_STEPS_SQL = f"""
    SELECT *, epoch_us(ts) AS us, CASE WHEN before IS NULL THEN NULL
              WHEN value >= before THEN value - before ELSE value END AS inc
    FROM (SELECT *, lag(value) OVER s AS before, lag(epoch_us(ts)) OVER s AS prev_us
          FROM ({SAMPLES_SQL})
          WINDOW s AS (PARTITION BY event_type, shard ORDER BY ts, sample_id))"""


def _window_sql(range_s: int, step_s: int, series: str = "event_type, shard", source: str = _STEPS_SQL) -> str:
    """Every grid point joined to the samples of its window, one series at a time."""
    named = ", ".join(f"s.{c.strip()} AS {c.strip()}" for c in series.split(","))
    return f"""
    samples AS ({source}),
    edge AS (SELECT {series}, min(us) AS lo, max(us) AS hi FROM samples GROUP BY {series}),
    grid AS (SELECT {series}, unnest(generate_series(
                CAST(ceil(lo / ({step_s} * 1000000.0)) AS BIGINT) * {step_s},
                CAST(floor(hi / 1000000.0) AS BIGINT) + {range_s}, {step_s})) AS t FROM edge),
    member AS (SELECT {named}, grid.t, s.us, s.sample_id, s.value, s.inc, s.prev_us
        FROM grid JOIN samples s USING ({series})
        WHERE s.us <= grid.t * 1000000 AND s.us > (grid.t - {range_s}) * 1000000)"""


def _rate_sql(range_s: int, step_s: int) -> str:
    return f"""WITH {_window_sql(range_s, step_s)}
    SELECT event_type, shard, t, round(increase * 1000000 / span_us, 6) AS value
    FROM (SELECT event_type, shard, t, max(us) - min(us) AS span_us,
                 coalesce(sum(inc), 0) - coalesce(min_by(coalesce(inc, 0), (us, sample_id)), 0) AS increase
          FROM member GROUP BY ALL)
    WHERE span_us > 0"""


@query("metric_rate_hourly", "E1", _rate_sql(DAY, HOUR))
def metric_rate_hourly(spark, sf):
    out = om.rate(samples(spark, sf), SERIES, DAY, HOUR)
    return out.withColumn("value", F.round("value", 6))


@query("metric_rate_5m", "E1", _rate_sql(300, 60))
def metric_rate_5m(spark, sf):
    out = om.rate(samples(spark, sf), SERIES, 300, 60)
    return out.withColumn("value", F.round("value", 6))


@query("metric_irate", "E2", f"""WITH {_window_sql(DAY, HOUR)},
    last AS (SELECT event_type, shard, t, arg_max(us, (us, sample_id)) AS us,
                    arg_max(prev_us, (us, sample_id)) AS prev_us, arg_max(inc, (us, sample_id)) AS inc
             FROM member GROUP BY ALL)
    SELECT event_type, shard, t, round(inc * 1000000 / (us - prev_us), 6) AS value
    FROM last WHERE prev_us > (t - {DAY}) * 1000000 AND us > prev_us""")
def metric_irate(spark, sf):
    out = om.irate(samples(spark, sf), SERIES, DAY, HOUR)
    return out.withColumn("value", F.round("value", 6))


@query("metric_gauge", "E3", f"""WITH {_window_sql(DAY, HOUR)}
    SELECT event_type, shard, t, arg_max(value, (us, sample_id)) AS value FROM member GROUP BY ALL""")
def metric_gauge(spark, sf):
    return om.gauge_at(samples(spark, sf), SERIES, DAY, HOUR)


_BY_POD = _STEPS_SQL.replace("PARTITION BY event_type, shard", "PARTITION BY metric, pod").replace(
    f"FROM ({SAMPLES_SQL})",
    f"""FROM (SELECT *, CASE WHEN metric LIKE 'container_network%' THEN 'network'
              WHEN metric LIKE '%\\_total' ESCAPE '\\' OR metric = 'container_memory_cache' THEN 'counter'
              ELSE 'gauge' END AS family FROM ({SAMPLES_SQL}))
          WHERE (family = 'network' AND interface = 'eth0') OR (family <> 'network' AND namespace = 'shop')""",
)


_BY_SERIES = _BY_POD.replace("PARTITION BY metric, pod", "PARTITION BY metric, pod, series_id").replace(
    "FROM (SELECT *, CASE WHEN metric", "FROM (SELECT *, sample_id % 2 AS series_id, CASE WHEN metric"
)


def _range_sql(series: str, source: str, condition: str = "true") -> str:
    return f"""WITH {_window_sql(DAY, HOUR, f"{series}, family", source)},
    w AS (SELECT {series}, family, t, max(us) - min(us) AS span_us,
                 coalesce(sum(inc), 0) - coalesce(min_by(coalesce(inc, 0), (us, sample_id)), 0) AS increase,
                 arg_max(value, (us, sample_id)) AS latest, arg_max(us, (us, sample_id)) AS last_us,
                 arg_max(coalesce(prev_us, -1), (us, sample_id)) AS prev_us,
                 arg_max(coalesce(inc, 0), (us, sample_id)) AS last_inc
          FROM member GROUP BY ALL)
    SELECT {series}, t, round(CASE family WHEN 'gauge' THEN latest
             WHEN 'counter' THEN increase * 1000000 / span_us
             ELSE last_inc * 1000000 / (last_us - prev_us) END, 3) AS value
    FROM w WHERE {condition} AND (family = 'gauge' OR (family = 'counter' AND span_us > 0)
       OR (family = 'network' AND prev_us > (t - {DAY}) * 1000000 AND last_us > prev_us))"""


@query("metric_query_range", "E1 E2 E3 P6 P10", _range_sql("metric, pod", _BY_POD))
def metric_query_range(spark, sf):
    return om.query_range(samples(spark, sf), "shop", DAY, HOUR)


@query("metric_query_range_series", "E1 E2 E3", _range_sql("metric, pod, series_id", _BY_SERIES))
def metric_query_range_series(spark, sf):
    """Two series of each metric in a pod; taken as one, every switch would look like a reset."""
    two = samples(spark, sf).withColumn("series_id", F.col("sample_id") % 2)
    return om.query_range(two, "shop", DAY, HOUR)


@query("metric_query_range_bounds", "E1 E2 E3", _range_sql(
    "metric, pod", _BY_POD, "t BETWEEN epoch(TIMESTAMP '2024-01-10 06:00:00') AND epoch(TIMESTAMP '2024-01-12 00:00:00')"))
def metric_query_range_bounds(spark, sf):
    return om.query_range(
        samples(spark, sf), "shop", DAY, HOUR, start=datetime(2024, 1, 10, 6), end=datetime(2024, 1, 12)
    )


_EXPORT_SQL = f"""
    SELECT CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS timestamp, instance || '.' || pod AS cmdb_id,
           CASE WHEN metric LIKE 'container_network%' AND interface IS NOT NULL
                THEN metric || '.' || interface ELSE metric END AS kpi_name,
           round(value, 3) AS value
    FROM ({SAMPLES_SQL})
    WHERE metric IN ({_ALLOWED}) AND pod NOT LIKE 'loadgenerator-%' AND pod NOT LIKE 'redis-cart%'
      AND pod IN ({INVENTORY_SQL})"""


@query("metric_export", "E4 P4 P5 P7 P8 P10 J2 O1", _EXPORT_SQL)
def metric_export(spark, sf):
    return om.export_metrics(samples(spark, sf), inventory(spark, sf), sort=True)


@query("metric_export_grid", "E4", f"""
    WITH k AS (
      SELECT epoch_us(ts) AS us, sample_id, value, instance || '.' || pod AS cmdb_id,
             CASE WHEN metric LIKE 'container_network%' AND interface IS NOT NULL
                  THEN metric || '.' || interface ELSE metric END AS kpi_name
      FROM ({SAMPLES_SQL})
      WHERE metric IN ({_ALLOWED}) AND pod NOT LIKE 'loadgenerator-%' AND pod NOT LIKE 'redis-cart%'
        AND pod IN ({INVENTORY_SQL})),
    g AS (SELECT *, unnest(generate_series((us + 14999999) // 15000000 * 15,
                                           (us + 299999999) // 15000000 * 15, 15)) AS timestamp FROM k)
    SELECT timestamp, cmdb_id, kpi_name, round(arg_max(value, (us, sample_id)), 3) AS value
    FROM g GROUP BY timestamp, cmdb_id, kpi_name""")
def metric_export_grid(spark, sf):
    return om.export_metrics(samples(spark, sf), inventory(spark, sf), step_s=om.EXPORT_STEP)


@query("metric_write", "K1", _EXPORT_SQL)
def metric_write(spark, sf):
    folder = scratch_path(spark, "metrics")
    write_metrics(om.export_metrics(samples(spark, sf), inventory(spark, sf)), folder)
    return spark.read.parquet(folder).drop("kpi")


@query("metric_merge", "K1 P3", f"""
    SELECT timestamp, cmdb_id, kpi_name, max(value) AS value FROM ({_EXPORT_SQL}) GROUP BY timestamp, cmdb_id, kpi_name""")
def metric_merge(spark, sf):
    """Chunks closed at both ends, the middle one landed twice."""
    folder = scratch_path(spark, "merged")
    table_ = om.export_metrics(samples(spark, sf), inventory(spark, sf))
    third = table_.agg(F.min("timestamp").alias("t0"), ((F.max("timestamp") - F.min("timestamp")) / 3).cast("long").alias("step"))
    t0, step = third.first()
    cuts = [t0, t0 + step, t0 + 2 * step, 2**40]
    for n in (0, 1, 1, 2):
        merge_metrics(table_.filter(F.col("timestamp").between(cuts[n], cuts[n + 1])), folder)
    return spark.read.parquet(folder).drop("kpi", "day")


@query("metric_exclude_pods", "P4", f"""SELECT sample_id, pod FROM ({SAMPLES_SQL})
    WHERE NOT starts_with(pod, 'loadgenerator-') AND NOT starts_with(pod, 'redis-cart')""")
def metric_exclude_pods(spark, sf):
    return om.exclude_pods(samples(spark, sf)).select("sample_id", "pod")


@query("metric_known", "P5", f"""SELECT sample_id, metric FROM ({SAMPLES_SQL})
    WHERE metric IN ({_ALLOWED})""")
def metric_known(spark, sf):
    return om.known_metrics(samples(spark, sf)).select("sample_id", "metric")


@query("metric_family", "P6", f"""SELECT metric, CASE
       WHEN metric LIKE 'container_network%' THEN 'network'
       WHEN regexp_matches(metric, '_total$') OR metric IN
         ('container_last_seen', 'container_memory_cache', 'container_memory_max_usage_bytes') THEN 'counter'
       ELSE 'gauge' END AS family, count(*) AS n FROM ({SAMPLES_SQL}) GROUP BY ALL""")
def metric_family(spark, sf):
    family = fm.metric_family(F.col("metric")).alias("family")
    return samples(spark, sf).groupBy("metric", family).agg(F.count(F.lit(1)).alias("n"))


@query("metric_kpi_names", "P7 P8", f"""SELECT sample_id,
       metric || CASE WHEN metric LIKE 'container_network%' AND interface IS NOT NULL
                      THEN '.' || interface ELSE '' END AS kpi_name,
       concat(instance, '.', pod) AS cmdb_id FROM ({SAMPLES_SQL})""")
def metric_kpi_names(spark, sf):
    return samples(spark, sf).select(
        "sample_id",
        fm.kpi_name(F.col("metric"), F.col("interface")).alias("kpi_name"),
        fm.cmdb_id(F.col("instance"), F.col("pod")).alias("cmdb_id"),
    )


_MESH = """event_id, 'svc' || cast(user_id % 10 AS string) || '-' || cast(user_id AS string) AS pod,
    CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'svc' || cast((user_id + event_id % 2) % 10 AS string) END AS source,
    'svc' || cast(user_id % 7 AS string) AS destination,
    CASE event_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'http' WHEN 2 THEN 'grpc' END AS protocol,
    CASE WHEN event_id % 3 > 0 THEN '200' END AS code, CASE WHEN event_id % 4 = 2 THEN '0' END AS grpc_status,
    CASE WHEN user_id % 2 = 0 THEN 'UF' ELSE 'NR' END AS flags"""


@query("metric_mesh_ids", "P9", f"""WITH m AS (SELECT {_MESH.replace("AS string", "AS VARCHAR")} FROM events)
    SELECT event_id, pod || '.' || CASE WHEN split_part(pod, '-', 1) = source THEN 'source' ELSE 'destination' END
             || '.' || source || '.' || destination AS cmdb_id,
           'istio_requests_total' || CASE WHEN protocol IS NULL THEN '' WHEN protocol = 'tcp' THEN '.' || flags
             ELSE '.' || protocol || '.' || coalesce(code, '') || '.' || coalesce(grpc_status, '') END AS kpi_name
    FROM m WHERE source = 'unknown' OR (source <> 'svc9' AND destination <> 'svc9')""")
def metric_mesh_ids(spark, sf):
    c = F.col
    known = [f"svc{i}" for i in range(9)]
    mesh = table(spark, sf, "events").selectExpr(*exprs(_MESH))
    return mesh.filter(fm.mesh_known(c("source"), c("destination"), known)).select(
        "event_id",
        fm.mesh_id(c("pod"), c("source"), c("destination")).alias("cmdb_id"),
        fm.mesh_kpi(
            F.lit("istio_requests_total"), c("protocol"), c("code"), c("grpc_status"), c("flags")
        ).alias("kpi_name"),
    )


@query("metric_mesh_known", "P9", f"""WITH m AS (SELECT {_MESH.replace("AS string", "AS VARCHAR")} FROM events),
    known AS (SELECT DISTINCT 'svc' || s_suppkey % 9 AS service FROM supplier)
    SELECT event_id, source, destination FROM m WHERE source = 'unknown'
      OR (source IN (SELECT service FROM known) AND destination IN (SELECT service FROM known))""")
def metric_mesh_known(spark, sf):
    known = table(spark, sf, "supplier").selectExpr("concat('svc', s_suppkey % 9) AS service")
    mesh = table(spark, sf, "events").selectExpr(*exprs(_MESH))
    return om.mesh_of_known(mesh, known).select("event_id", "source", "destination")


@query("metric_inventory_join", "J2", f"""SELECT s.sample_id, s.pod FROM ({SAMPLES_SQL}) s
    WHERE EXISTS (SELECT 1 FROM ({INVENTORY_SQL}) i WHERE i.pod = s.pod)""")
def metric_inventory_join(spark, sf):
    kept = om.in_inventory(samples(spark, sf), inventory(spark, sf))
    return kept.select("sample_id", "pod")


@query("time_parse", "P1", """SELECT event_id, epoch_us(ts) // 1000000 AS from_epoch,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 END AS from_digits,
       epoch_us(ts) AS from_timestamp FROM events""")
def time_parse(spark, sf):
    events = table(spark, sf, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    digits = F.when(F.expr("event_id % 5 = 0"), "n/a").otherwise(F.col("sec").cast("string"))
    return events.select(
        "event_id",
        F.unix_seconds(to_ts(F.col("sec"), "epoch")).alias("from_epoch"),
        F.unix_seconds(to_ts(digits, "digits")).alias("from_digits"),
        F.unix_micros(to_ts(F.col("ts"), "timestamp")).alias("from_timestamp"),
    )


@query("time_in_zone", "P2", """SELECT event_id,
    strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM events""")
def time_in_zone(spark, sf):
    local = in_zone(F.col("ts").cast("timestamp")).alias("local_time")
    return table(spark, sf, "events").select("event_id", local)


@query("time_range", "P3", """
    SELECT event_id, 'left' AS closed FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
    UNION ALL
    SELECT event_id, 'both' FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def time_range(spark, sf):
    lo, hi = datetime(2024, 1, 5), datetime(2024, 1, 20)
    events = table(spark, sf, "events")
    part = lambda closed: om.time_range(events, "ts", lo, hi, closed).select(
        "event_id", F.lit(closed).alias("closed")
    )
    return part("left").unionByName(part("both"))


@query("metric_round3", "P10", """SELECT event_id, round(value / 7, 3) AS value FROM events""")
def metric_round3(spark, sf):
    return table(spark, sf, "events").select("event_id", fm.round3(F.col("value") / 7).alias("value"))
