"""Metric operators: selection, counter rates and gauges on a step grid, the KPI export.

Samples are ``(<series columns>, ts TIMESTAMP, sample_id, value DOUBLE)``. ``sample_id`` orders
samples of one series that share a timestamp.

Rates work on *cells*: slices of ``gcd(step, range)`` seconds, so every grid window is a whole
number of cells. A first exchange on (series, cell) folds each cell to one fragment (first sample,
last sample, reset-adjusted increase); fragments are then joined up per series. The heaviest series
is thereby spread over as many tasks as it has cells, and what is grouped by series alone is
bounded by time span / cell length, not by samples. Where one cell of one series is itself too much
for a task, ``parts`` folds it in that many pieces. Windows are put together inside stretches of a
series; grid points, of which a sample has ``range / step``, come into being last, row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from opsframe.functions import metrics as fm
from opsframe.functions.time import MICROS, bound, epoch_micros, epoch_seconds

DEFAULT_RANGE = 300
DEFAULT_STEP = 60
EXPORT_STEP = 15


def time_range(
    df: DataFrame, column: str, start, end, closed: str = "left"
) -> DataFrame:
    """Rows in ``[start, end)``; ``closed="both"`` also keeps the end point."""
    ts, kind = F.col(column), df.schema[column].dataType
    last = bound(end, kind)
    upper = {"left": ts < last, "both": ts <= last}[closed]
    return df.filter((ts >= bound(start, kind)) & upper)


def exclude_pods(
    df: DataFrame, pod: str = "pod", prefixes: tuple[str, ...] = fm.EXCLUDED_POD_PREFIXES
) -> DataFrame:
    return df.filter(~fm.is_excluded_pod(F.col(pod), prefixes))


def known_metrics(
    df: DataFrame, name: str = "metric", allow: Sequence[str] = fm.CONTAINER_METRICS
) -> DataFrame:
    return df.filter(F.col(name).isin(*allow))


def mesh_of_known(mesh: DataFrame, services: DataFrame) -> DataFrame:
    """Rows whose ends are known services, given as a table (column ``service``), or whose source is
    ``unknown``: the form of ``functions.metrics.mesh_known`` for lists that don't fit in a plan."""
    known = services.select("service").filter("service IS NOT NULL").distinct()
    end = lambda name: known.select(F.col("service").alias(f"_{name}"))
    placed = mesh.join(end("source"), F.col("source") == F.col("_source"), "left").join(
        end("destination"), F.col("destination") == F.col("_destination"), "left"
    )
    both = F.col("_source").isNotNull() & F.col("_destination").isNotNull()
    return placed.filter((F.col("source") == "unknown") | both).select(*mesh.columns)


def in_inventory(df: DataFrame, inventory: DataFrame, pod: str = "pod") -> DataFrame:
    """Rows whose pod is inventoried. No hint: the planner broadcasts only below its size limit."""
    return df.join(inventory.select(F.col("pod").alias(pod)), pod, "left_semi")


def _check(range_s: int, step_s: int) -> int:
    if range_s <= 0 or step_s <= 0:
        raise ValueError("range and step must be positive")
    return gcd(range_s, step_s)


def _cell(micros: Column, cell_us: int) -> Column:
    """Cell c covers ``((c - 1) * cell, c * cell]``."""
    return F.ceil(micros / F.lit(cell_us)).cast("long")


#: Windows' lengths in a stretch of a series. A stretch is what one group holds, with a window on each side.
WINDOWS_PER_STRETCH = 32


def _stretches(rows: DataFrame, before: int, after: int) -> DataFrame:
    """``rows`` by ``stretch``, a run of cells, beside those within ``before`` and ``after`` cells of it.

    A row is ``own`` in the stretch of its cell; its copies in the neighbours are only looked at. So
    windows that reach no further are found inside a stretch, however long or busy the series is.
    """
    length = max(before, after, 1) * WINDOWS_PER_STRETCH
    at = lambda shift: F.floor((F.col("cell") + shift) / length).cast("long")
    return rows.withColumn("stretch", F.explode(F.array_distinct(F.array(at(-after), at(0), at(before))))).withColumn(
        "own", F.col("stretch") == at(0)
    )


def _points_until_next(cell_s: int, range_s: int, step_s: int) -> Column:
    """Grid points (epoch seconds) whose window ends with this ``cell``: has it whole, and not the ``next``."""
    first = lambda cell: F.ceil(F.col(cell) * cell_s / step_s).cast("long")
    last = F.floor((F.col("cell") * cell_s - cell_s + range_s) / step_s).cast("long")
    last = F.least(last, first("next") - 1)  # NULL, on the last row, is skipped
    points = F.sequence(first("cell") * step_s, last * step_s, F.lit(step_s).cast("long"))
    return F.when(last >= first("cell"), points)


def _windows(fragments: DataFrame, series: Sequence[str], cell_s: int, range_s: int, step_s: int, parts: int, start, end) -> DataFrame:
    """``t`` with ``window``, the fragments in ``(t - range, t]`` in their order, for each grid point that has any.

    A fragment sees those that reach back to its oldest window, and takes the grid points up to the
    next one from there, so nothing is exchanged, sorted or held per grid point.
    """
    reach = range_s // cell_s
    inside = Window.partitionBy(*series, "stretch").orderBy("piece")
    seen = F.collect_list(F.struct(*(c for c in fragments.columns if c not in series))).over(
        inside.rangeBetween(1 - reach * parts, Window.currentRow)
    )
    placed = _stretches(fragments, reach, reach).withColumn("next", F.lead("cell").over(inside)).withColumn("_seen", seen)
    points = _asked_points(_points_until_next(cell_s, range_s, step_s), start, end)
    at = placed.filter("own").select(*series, F.explode(points).alias("t"), "_seen")
    opens = (F.col("t") - range_s) / cell_s
    return at.select(*series, "t", F.filter("_seen", lambda f: f["cell"] > opens).alias("window"))


def _fragments(samples: DataFrame, series: Sequence[str], cell_s: int, parts: int) -> DataFrame:
    """One row per (series, piece of a cell), with the step from the piece before added."""
    if parts < 1 or (cell_s * MICROS) % parts:
        raise ValueError("parts must divide the cell")
    placed = samples.select(
        *series, epoch_micros(F.col("ts")).alias("us"), "sample_id", "value"
    ).withColumn("piece", _cell(F.col("us"), cell_s * MICROS // parts))
    inside = Window.partitionBy(*series, "piece").orderBy("us", "sample_id")
    increase = lambda now, before: F.when(now >= before, now - before).otherwise(now)
    stepped = placed.withColumn("prev", F.lag(F.struct("us", "value")).over(inside)).withColumn(
        "inc", increase(F.col("value"), F.col("prev.value"))
    )
    point = F.struct("us", "sample_id", "value", "inc", F.col("prev.us").alias("prev_us"))
    folded = stepped.groupBy(*series, "piece").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("prev").isNotNull(), F.col("inc"))), F.lit(0.0)).alias("inner"),
        F.min_by(point, F.struct("us", "sample_id")).alias("head"),
        F.max_by(point, F.struct("us", "sample_id")).alias("tail"),
    )
    along = Window.partitionBy(*series).orderBy("piece")
    linked = folded.withColumn("before", F.lag("tail").over(along))
    bridge = increase(F.col("head.value"), F.col("before.value"))
    return linked.select(
        *series,
        "piece",
        F.ceil(F.col("piece") / parts).cast("long").alias("cell"),
        "inner",
        F.col("head.us").alias("first_us"),
        F.col("tail.us").alias("last_us"),
        F.col("tail.value").alias("last_value"),
        F.when(F.col("before").isNotNull(), bridge).alias("bridge"),
        F.when(F.col("n") > 1, F.col("tail.inc")).otherwise(
            F.when(F.col("before").isNotNull(), bridge)
        ).alias("last_inc"),
        F.when(F.col("n") > 1, F.col("tail.prev_us")).otherwise(F.col("before.us")).alias("prev_us"),
    )


def _reaching(samples: DataFrame, start, end, range_s: int) -> DataFrame:
    """The samples that grid points from ``start`` to ``end`` look at; the bound reaches the scan."""
    if start is None:
        return samples
    ts, kind = F.col("ts"), samples.schema["ts"].dataType
    opens = (bound(start, kind).cast(kind) - F.expr(f"INTERVAL {range_s} SECONDS")).cast(kind)
    return samples.filter((ts >= opens) & (ts <= bound(end, kind)))


def _asked_points(points: Column, start, end) -> Column:
    """Grid points from ``start`` to ``end``, both included."""
    if start is None:
        return points
    at = lambda value: epoch_seconds(bound(value, TimestampType()).cast("timestamp"))
    return F.filter(points, lambda t: (t >= at(start)) & (t <= at(end)))


def rate(
    samples: DataFrame,
    series: Sequence[str],
    range_s: int = DEFAULT_RANGE,
    step_s: int = DEFAULT_STEP,
    parts: int = 1,
    start=None,
    end=None,
) -> DataFrame:
    """Per-second counter rate at each multiple of ``step_s``.

    Reset-adjusted increase over the samples in ``(t - range, t]`` divided by the time between the
    first and the last of them; a window needs two samples at different times. No extrapolation.
    With ``start`` and ``end`` the answer has the grid points between them, both included.
    """
    cell_s = _check(range_s, step_s)
    near = _reaching(samples, start, end, range_s)
    windows = _windows(_fragments(near, series, cell_s, parts), series, cell_s, range_s, step_s, parts, start, end)
    return (
        windows.select(*series, "t", *_rate_parts())
        .filter(F.col("span_us") > 0)
        .select(*series, "t", _rate_value().alias("value"))
    )


def _rate_parts() -> list[Column]:
    # The bridge into the first cell of a window starts outside it, so it is taken off again.
    window, zero = F.col("window"), F.lit(0.0)
    total = lambda part: F.aggregate(window, zero, lambda sum_, f: sum_ + F.coalesce(f[part], zero))
    lead_in = F.coalesce(window[0]["bridge"], zero)
    span = F.element_at(window, -1)["last_us"] - window[0]["first_us"]
    return [(total("inner") + total("bridge") - lead_in).alias("increase"), span.alias("span_us")]


def _rate_value() -> Column:
    return F.col("increase") * MICROS / F.col("span_us")


def _latest_parts(*names: str) -> list[Column]:
    return [F.element_at("window", -1)[name].alias(name) for name in names]


def _irate_valid(range_s: int) -> Column:
    opens = (F.col("t") - range_s) * MICROS
    return (F.col("prev_us") > opens) & (F.col("last_us") > F.col("prev_us"))


def _irate_value() -> Column:
    return F.col("last_inc") * MICROS / (F.col("last_us") - F.col("prev_us"))


def irate(
    samples: DataFrame,
    series: Sequence[str],
    range_s: int = DEFAULT_RANGE,
    step_s: int = DEFAULT_STEP,
    parts: int = 1,
    start=None,
    end=None,
) -> DataFrame:
    """Per-second rate from the last two samples of each window."""
    cell_s = _check(range_s, step_s)
    near = _reaching(samples, start, end, range_s)
    windows = _windows(_fragments(near, series, cell_s, parts), series, cell_s, range_s, step_s, parts, start, end)
    return (
        windows.select(*series, "t", *_latest_parts("last_us", "prev_us", "last_inc"))
        .filter(_irate_valid(range_s))
        .select(*series, "t", _irate_value().alias("value"))
    )


def gauge_at(
    samples: DataFrame,
    series: Sequence[str],
    lookback_s: int = DEFAULT_RANGE,
    step_s: int = DEFAULT_STEP,
    start=None,
    end=None,
) -> DataFrame:
    """Latest sample in ``(t - lookback, t]`` at each multiple of ``step_s``."""
    cell_s = _check(lookback_s, step_s)
    series = list(series)
    placed = (
        _reaching(samples, start, end, lookback_s)
        .select(*series, epoch_micros(F.col("ts")).alias("us"), "sample_id", "value")
        .withColumn("cell", _cell(F.col("us"), cell_s * MICROS))
    )
    inside = Window.partitionBy(*series, "stretch").orderBy("us", "sample_id")
    followed = _stretches(placed, 0, lookback_s // cell_s).withColumn("next", F.lead("cell").over(inside))
    points = _asked_points(_points_until_next(cell_s, lookback_s, step_s), start, end)
    return followed.filter("own").select(*series, F.explode(points).alias("t"), "value")


def query_range(
    samples: DataFrame,
    namespace: str,
    range_s: int = DEFAULT_RANGE,
    step_s: int = DEFAULT_STEP,
    parts: int = 1,
    start=None,
    end=None,
) -> DataFrame:
    """Each metric by its own family: ``irate`` for network counters, ``rate`` for other counters,
    the latest value for gauges; all of them in one pass.

    ``samples`` adds ``metric, namespace, interface``, and ``series_id`` where a pod may have several
    series of a metric (the readers make it from all labels): there is one answer per series then,
    and sums over a pod are taken of these. ``start`` and ``end`` bound the grid points. As in the query forms it stands for, network
    counters are matched on their interface and the others on their namespace. Values have three
    decimals.
    """
    named = ["metric", "pod", *(c for c in ("series_id",) if c in samples.columns)]
    series = ["family", *named]
    cell_s = _check(range_s, step_s)
    family = fm.metric_family(F.col("metric"))
    wanted = F.when(family == "network", F.col("interface") == fm.RATED_INTERFACE).otherwise(
        F.col("namespace") == namespace
    )
    chosen = _reaching(samples, start, end, range_s).filter(wanted).withColumn("family", family)
    windows = _windows(_fragments(chosen, series, cell_s, parts), series, cell_s, range_s, step_s, parts, start, end)
    folded = windows.select(
        *series, "t", *_rate_parts(), *_latest_parts("last_value", "last_us", "prev_us", "last_inc")
    )
    value = (
        F.when(F.col("family") == "gauge", F.col("last_value"))
        .when(F.col("family") == "network", F.when(_irate_valid(range_s), _irate_value()))
        .when(F.col("span_us") > 0, _rate_value())
    )
    answers = folded.select(*named, "t", fm.round3(value).alias("value"))
    return answers.filter(F.col("value").isNotNull())


def export_metrics(
    samples: DataFrame,
    inventory: DataFrame,
    start=None,
    end=None,
    sort: bool = False,
    step_s: int | None = None,
    lookback_s: int = DEFAULT_RANGE,
) -> DataFrame:
    """KPI table of all allow-listed metrics of inventoried pods: raw values, three decimals.

    ``sort`` asks for a global order by time; writers sort per file instead. With ``step_s`` (as
    ``EXPORT_STEP``) the rows lie on a grid, each with the latest value of its series in the
    ``lookback_s`` seconds before; without it every sample is a row at its own time.
    """
    window = samples if start is None or step_s else time_range(samples, "ts", start, end)
    kept = in_inventory(exclude_pods(known_metrics(window)), inventory)
    at = epoch_seconds(F.col("ts"))
    if step_s:
        series = ["metric", "pod", "instance", "interface", *(c for c in ("series_id",) if c in samples.columns)]
        kept, at = gauge_at(kept, series, lookback_s, step_s, start, end), F.col("t")
    table = kept.select(
        at.alias("timestamp"),
        fm.cmdb_id(F.col("instance"), F.col("pod")).alias("cmdb_id"),
        fm.kpi_name(F.col("metric"), F.col("interface")).alias("kpi_name"),
        fm.round3(F.col("value")).alias("value"),
    )
    return table.orderBy("timestamp", "cmdb_id", "kpi_name", "value") if sort else table
