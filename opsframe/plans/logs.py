"""Log queries: flattening, selection, volumes, compression."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from opsframe.functions import logs as fl
from opsframe.functions.lines import masked_key, timestamps
from opsframe.operators import compress, logs as ol
from opsframe.operators.metrics import time_range
from opsframe.plans.adapters import (
    DOCUMENT_LINES_SQL,
    INVENTORY_SQL,
    LINES_SQL,
    LOG_HITS_SQL,
    LOGS_SQL,
    exprs,
    document_lines,
    inventory,
    log_hits,
    log_lines,
    logs,
)
from opsframe.plans.registry import query, table
from opsframe.session import scratch_path
from opsframe.sources.sinks import read_logs_sliced, write_logs_sliced

NOW = datetime(2024, 1, 20, 12, 30)

_NORMAL_SQL = """CASE
    WHEN contains(message, 'severity') THEN
      CASE WHEN json_valid(message) THEN coalesce('severity:' || json_extract_string(message, '$.severity')
           || ',message:' || json_extract_string(message, '$.message'), message) ELSE message END
    WHEN contains(message, 'level') THEN
      CASE WHEN json_valid(message) AND json_type(message, '$.level') = 'VARCHAR'
           THEN 'level:' || json_extract_string(message, '$.level')
           || ',message:' || json_extract_string(message, '$.message') ELSE message END
    ELSE message END"""


@query("log_flatten", "P11 S3", f"""
    SELECT log_id, epoch_us(ts) / 1000000.0 AS timestamp, date, pod_name, container_name, namespace,
           node_name, message
    FROM ({LOG_HITS_SQL}) WHERE event_id % 13 <> 0 AND node_name IS NOT NULL""")
def log_flatten(spark, sf):
    return ol.flatten_log_hits(log_hits(spark, sf))


@query("log_rejects", "P11", f"""
    SELECT log_id, CASE WHEN node_name IS NULL THEN 'missing node_name' ELSE 'bad timestamp' END AS reason
    FROM ({LOG_HITS_SQL}) WHERE event_id % 13 = 0 OR node_name IS NULL""")
def log_rejects(spark, sf):
    return ol.rejected_log_hits(log_hits(spark, sf)).select("log_id", "reason")


@query("log_normalize", "P12", f"""
    SELECT log_id, {_NORMAL_SQL} AS message FROM ({LOGS_SQL})""")
def log_normalize(spark, sf):
    return logs(spark, sf).select("log_id", fl.normalize_message(F.col("message")).alias("message"))


@query("log_known_pods", "P13 J2", f"""
    SELECT log_id, epoch_us(ts) / 1000000.0 AS timestamp, date, pod_name AS cmdb_id, {_NORMAL_SQL} AS message
    FROM ({LOG_HITS_SQL}) WHERE event_id % 13 <> 0 AND node_name IS NOT NULL
      AND pod_name IN ({INVENTORY_SQL})""")
def log_known_pods(spark, sf):
    return ol.logs_of_known_pods(ol.flatten_log_hits(log_hits(spark, sf)), inventory(spark, sf))


_COMMANDS = """event_id, CASE event_id % 8
    WHEN 0 THEN 'kubectl logs svc' || cast(user_id AS string)
    WHEN 1 THEN 'kubectl get   events -A'
    WHEN 2 THEN 'kubectl get pods -w'
    WHEN 3 THEN 'kubectl edit svc svc' || cast(user_id AS string)
    WHEN 4 THEN 'docker logs -f c' || cast(user_id AS string)
    WHEN 5 THEN 'kubectl logs -f svc1 && kubectl port-forward svc1 80'
    WHEN 6 THEN 'sudo docker events'
    ELSE 'kubectl get pods' END AS command"""


def _commands(spark, sf):
    return table(spark, sf, "events").selectExpr(*exprs(_COMMANDS))


_COMMANDS_SQL = f"SELECT {_COMMANDS} FROM events".replace("AS string", "AS VARCHAR")


@query("log_command_filter", "P14", f"""
    SELECT event_id, command FROM ({_COMMANDS_SQL}) WHERE event_id % 8 IN (0, 1, 2, 4, 5, 6)""")
def log_command_filter(spark, sf):
    return _commands(spark, sf).filter(fl.is_log_command(F.col("command")))


@query("command_policy", "P15", f"""
    SELECT event_id, CASE
        WHEN contains(command, 'kubectl edit') OR contains(command, 'edit svc')
          THEN 'Error: Cannot use `kubectl edit`. Use `kubectl patch` instead.'
        WHEN contains(command, 'kubectl port-forward')
          THEN 'Error: Cannot use `kubectl port-forward` because it is an interactive command.'
        WHEN contains(command, 'docker logs -f') THEN 'Error: Cannot use `docker logs -f`. Use `docker logs` instead.'
        WHEN contains(command, 'kubectl logs -f') THEN 'Error: Cannot use `kubectl logs -f`. Use `kubectl logs` instead.'
        END AS answer FROM ({_COMMANDS_SQL})""")
def command_policy(spark, sf):
    return _commands(spark, sf).select("event_id", fl.command_policy(F.col("command")).alias("answer"))


@query("log_error_streams", "P16", f"""
    SELECT pod_name, coalesce(bool_or(contains(lower(message), 'error')), false) AS has_error,
           min(CASE WHEN contains(lower(message), 'error') THEN epoch_us(ts) END) AS first_error
    FROM ({LOGS_SQL}) GROUP BY pod_name""")
def log_error_streams(spark, sf):
    timed = logs(spark, sf).withColumn("timestamp", F.unix_micros("ts"))
    return ol.error_streams(timed)


_SPAN = """user_id, event_id, ts AS start,
    ts + make_dt_interval(cast(event_id % 5 AS int), cast(user_id % 24 AS int), 0, 0) AS end"""


@query("day_expansion", "P17", """
    WITH i AS (SELECT event_id, ts AS a, ts + to_days(CAST(event_id % 5 AS INTEGER)) + to_hours(CAST(user_id % 24 AS INTEGER)) AS b FROM events),
    d AS (SELECT *, unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS m FROM i)
    SELECT event_id, strftime(m, '%Y-%m-%d') AS day, epoch_us(greatest(a, m)) AS day_start,
           epoch_us(least(b, m + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND)) AS day_end FROM d""")
def day_expansion(spark, sf):
    spans = table(spark, sf, "events").selectExpr(*exprs(_SPAN))
    days = ol.expand_days(spans)
    return days.select(
        "event_id", "day",
        F.unix_micros("day_start").alias("day_start"), F.unix_micros("day_end").alias("day_end"),
    )


@query("day_selection", "P18", """
    SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'""")
def day_selection(spark, sf):
    folder = scratch_path(spark, "by-day")
    dated = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    dated.repartitionByRange("day", "ts").write.partitionBy("day").parquet(folder)
    stored = spark.read.schema("event_id LONG, day DATE").parquet(folder)
    return ol.select_days(stored, datetime(2024, 1, 8, 5), datetime(2024, 1, 12, 1)).select("event_id")


_INCIDENT = "event_type = 'error' AND value > 180"


@query("day_selection_dynamic", "P18 P17", f"""
    SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events i WHERE {_INCIDENT.replace("event_type", "i.event_type").replace("value", "i.value")}
      AND e.ts BETWEEN i.ts - INTERVAL 10 MINUTE AND i.ts + INTERVAL 10 MINUTE)""")
def day_selection_dynamic(spark, sf):
    """Logs around incidents, which are found by a query of their own."""
    folder = scratch_path(spark, "by-day")
    events = table(spark, sf, "events")
    events.withColumn("day", F.to_date("ts")).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(folder)
    stored = spark.read.schema("event_id LONG, ts TIMESTAMP_NTZ, day DATE").parquet(folder)
    around = F.expr("INTERVAL 10 MINUTE")
    at = F.col("ts").cast("timestamp")
    spans = events.filter(_INCIDENT).select((at - around).alias("start"), (at + around).alias("end"))
    return ol.logs_of_spans(stored, spans).select("event_id")


def _volume_sql(days: int, unit: str) -> str:
    return f"""
    SELECT strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M') AS date, count(*) AS log_count FROM events
    WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-20 12:30:00' - INTERVAL {days} DAY GROUP BY 1"""


def _volume(spark, sf, period):
    counted = ol.log_volume(table(spark, sf, "events"), NOW, period)
    return counted.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm"))


@query("log_volume_day", "A1", _volume_sql(1, "hour"))
def log_volume_day(spark, sf):
    return _volume(spark, sf, "one_day")


@query("log_volume_week", "A1", _volume_sql(7, "day"))
def log_volume_week(spark, sf):
    return _volume(spark, sf, "one_week")


@query("log_volume_two_weeks", "A1", _volume_sql(14, "day"))
def log_volume_two_weeks(spark, sf):
    return _volume(spark, sf, "two_weeks")


@query("log_in_time_order", "O1", f"""SELECT log_id, epoch_us(ts) AS us FROM ({LOGS_SQL})""")
def log_in_time_order(spark, sf):
    return logs(spark, sf).orderBy("ts", "log_id").select("log_id", F.unix_micros("ts").alias("us"))


@query("log_first_per_day", "O2", f"""
    SELECT log_id, day FROM (
      SELECT log_id, strftime(ts, '%Y-%m-%d') AS day,
             row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, log_id) AS rn FROM ({LOGS_SQL}))
    WHERE rn <= 100""")
def log_first_per_day(spark, sf):
    return ol.first_n_per_day(logs(spark, sf), n=100).select("log_id", "day")


@query("log_first_per_slice", "O2", f"""
    SELECT log_id, day FROM (
      SELECT log_id, strftime(ts, '%Y-%m-%d') AS day,
             row_number() OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY ts, log_id) AS rn
      FROM ({LOGS_SQL}))
    WHERE rn <= 1""")
def log_first_per_slice(spark, sf):
    return ol.first_n_per_slice(logs(spark, sf), n=1).select("log_id", "day")


@query("log_union_renumbered", "U1", f"""
    SELECT log_id, row_number() OVER (ORDER BY ts, log_id) - 1 AS "row" FROM ({LOGS_SQL})""")
def log_union_renumbered(spark, sf):
    folder = scratch_path(spark, "stacked")
    write_logs_sliced(logs(spark, sf).select("log_id", "ts"), folder)
    return ol.renumber_slices(read_logs_sliced(spark, folder)).select("log_id", "row")


@query("log_sliced_write", "K3 U1", f"""
    SELECT log_id, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y%m%dT%H%M%S') AS slice_start
    FROM ({LOGS_SQL})""")
def log_sliced_write(spark, sf):
    folder = scratch_path(spark, "slices")
    write_logs_sliced(logs(spark, sf).select("log_id", "ts"), folder)
    return read_logs_sliced(spark, folder).select("log_id", F.col("slice_start").cast("string"))


@query("log_union_days", "U1 U2", """
    SELECT event_id, 'early' AS part FROM events WHERE ts < TIMESTAMP '2024-01-10'
    UNION ALL SELECT event_id, 'late' FROM events WHERE ts >= TIMESTAMP '2024-01-08'""")
def log_union_days(spark, sf):
    events = table(spark, sf, "events")
    early = time_range(events, "ts", datetime(1970, 1, 1), datetime(2024, 1, 10))
    late = events.filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-08'"))
    tag = lambda df, name: df.select("event_id", F.lit(name).alias("part"))
    return tag(early, "early").unionByName(tag(late, "late"))


@query("day_intersection", "U3", """
    SELECT strftime(d, '%Y-%m-%d') AS day FROM (
      SELECT DISTINCT CAST(ts AS DATE) AS d FROM events
      INTERSECT SELECT DISTINCT CAST(o_orderdate + INTERVAL 9300 DAY AS DATE) FROM orders)""")
def day_intersection(spark, sf):
    existing = table(spark, sf, "events").select(F.to_date("ts").alias("d"))
    wanted = table(spark, sf, "orders").select(F.date_add(F.to_date("o_orderdate"), 9300).alias("d"))
    return existing.intersect(wanted).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


# --- raw lines -------------------------------------------------------------------------------

_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z"
_KEY_SQL = f"CASE WHEN regexp_matches(line, '{_ISO}') THEN regexp_replace(line, '{_ISO}', '@', 'g') END"


def _pass_sql(source: str) -> str:
    return f"""SELECT stream, seq, line FROM (
        SELECT *, {_KEY_SQL} AS k, lead({_KEY_SQL}) OVER (PARTITION BY stream ORDER BY seq) AS nk FROM ({source}))
      WHERE k IS NULL OR nk IS NULL OR k <> nk"""


def _blocks_sql(source: str, k: int) -> str:
    return f"""SELECT stream, CAST(block AS BIGINT) AS seq, string_agg(line, chr(10) ORDER BY seq) AS line
      FROM (SELECT *, (row_number() OVER (PARTITION BY stream ORDER BY seq) - 1) // {k} AS block FROM ({source}))
      GROUP BY stream, block"""


@query("line_split", "S8", f"{DOCUMENT_LINES_SQL}")
def line_split(spark, sf):
    return document_lines(spark, sf)


@query("line_numbering", "S8 E6", LINES_SQL)
def line_numbering(spark, sf):
    return log_lines(spark, sf)


@query("line_timestamps", "E5", f"""
    SELECT stream, seq, CAST(len(regexp_extract_all(line, '{_ISO}')) AS BIGINT) AS n,
           len(line) AS width FROM ({LINES_SQL})""")
def line_timestamps(spark, sf):
    return log_lines(spark, sf).select(
        "stream", "seq",
        F.size(timestamps(F.col("line"))).cast("long").alias("n"),
        F.length(F.coalesce(masked_key(F.col("line")), "line")).cast("long").alias("width"),
    )


@query("line_compress", "E5", _pass_sql(LINES_SQL))
def line_compress(spark, sf):
    return compress.compress_lines(log_lines(spark, sf))


@query("line_blocks", "E6", _blocks_sql(DOCUMENT_LINES_SQL, 3))
def line_blocks(spark, sf):
    return compress.block_lines(document_lines(spark, sf), 3)


@query("line_compress_multi", "E7", _pass_sql(_blocks_sql(_pass_sql(_blocks_sql(_pass_sql(LINES_SQL), 2)), 3)))
def line_compress_multi(spark, sf):
    return compress.compress_multi(log_lines(spark, sf), 3)
