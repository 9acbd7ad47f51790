"""Window operators over series in long form: ``(readid, pos, x)``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.sources.scratch import scratch


def hampel(points: DataFrame, window: int = 3, n_sigmas: float = 3.0) -> DataFrame:
    """Outliers of each series replaced by their window's median: ``(readid, pos, x, filtered)``.

    The window of a position lies in the original series, from ``window//2`` before it on. The first
    ``window//2`` and last ``window//2 + 1`` samples and series of at most ``window`` samples stay.
    """
    half = window // 2
    order = Window.partitionBy("readid").orderBy("pos")
    frame = order.rowsBetween(-half, window - 1 - half)
    rows = points.withColumns({"_w": F.collect_list("x").over(frame), "_at": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("readid"))})
    rows = rows.withColumn("_m", X.array_median(F.col("_w")))
    rows = rows.withColumn("_mad", X.array_median(F.transform("_w", lambda v: F.abs(v - F.col("_m")))))
    inside = (F.col("_n") > window) & (F.col("_at") >= half) & (F.col("_at") < F.col("_n") - half - 1)
    out = inside & (F.abs(F.col("x") - F.col("_m")) > n_sigmas * X.MAD_SCALE * F.col("_mad"))
    return rows.withColumn("filtered", F.when(out, F.col("_m")).otherwise(F.col("x"))).drop("_w", "_at", "_n", "_m", "_mad")


def window_edges(points: DataFrame, w: int = 6, value: str = "x") -> DataFrame:
    """``score``: difference of the means of the windows before and from a sample on, over their spread."""
    order = Window.partitionBy("readid").orderBy("pos")
    left, right = order.rowsBetween(-w, -1), order.rowsBetween(0, w - 1)
    at, n = F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy("readid"))
    score = F.abs(F.avg(value).over(left) - F.avg(value).over(right)) / (F.stddev_pop(value).over(left) + 1e-8 + F.stddev_pop(value).over(right))
    rows = points.withColumns({"_at": at, "_n": n, "_s": score})
    return rows.withColumn("score", F.when((F.col("_at") >= w) & (F.col("_at") < F.col("_n") - w), F.col("_s")).otherwise(0.0)).drop("_at", "_n", "_s")


def cwt_edges(points: DataFrame, scale: int = 10, value: str = "x") -> DataFrame:
    """``score``: size of the response to a first derivative of a Gaussian of this scale, zero near the ends;
    ``spread``: the response's standard deviation from three samples before to two after."""
    import math

    reach = 4 * scale
    kernel = [-j / scale**2 * math.exp(-(j**2) / (2 * scale**2)) / math.sqrt(scale) for j in range(-reach, reach + 1)]
    order = Window.partitionBy("readid").orderBy("pos")
    rows = points.withColumn("_w", F.collect_list(value).over(order.rowsBetween(-reach, reach)))
    dot = F.aggregate(F.zip_with("_w", F.array(*map(F.lit, kernel)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = rows.withColumn("score", F.when(F.size("_w") == 2 * reach + 1, F.abs(dot)).otherwise(0.0)).drop("_w")
    return scored.withColumn("spread", F.stddev_pop("score").over(order.rowsBetween(-3, 2)))


def cwt_peaks(points: DataFrame, scale: int = 10, threshold: float = 0.8, distance: int = 3, value: str = "x") -> DataFrame:
    """Peaks of the wavelet response of at least ``threshold`` where the response is steady: its spread is below half of that."""
    scores = cwt_edges(points, scale, value)
    peaks = find_peaks(scores.select("readid", "pos", "score"), threshold, distance)
    return peaks.join(scores.where(F.col("spread") < threshold / 2).select("readid", "pos"), ["readid", "pos"], "left_semi")


def find_peaks(scores: DataFrame, height: float, distance: int = 3) -> DataFrame:
    """``(readid, pos, score)`` of strict local maxima of at least ``height``.

    Of maxima nearer than ``distance`` the higher stays, of equal ones the earlier. Plateaus are no peaks.
    Maxima form runs whose neighbours are nearer than ``distance``; nothing outside a run can suppress one in
    it, so only a run is held at once, and each peak looks at its few neighbours.
    """
    order = Window.partitionBy("readid").orderBy("pos")
    tops = scores.select("readid", "pos", "score", F.lag("score").over(order).alias("_l"), F.lead("score").over(order).alias("_r")).where("score > _l AND score > _r").where(F.col("score") >= height)
    runs = tops.select("readid", "pos", F.col("score").cast("double").alias("score"), F.coalesce(F.col("pos") - F.lag("pos").over(order) >= distance, F.lit(True)).alias("begins"))
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    kept = runs.sortWithinPartitions("readid", "pos").mapInArrow(partial(_suppress, distance=distance), f"readid {kinds['readid']}, pos {kinds['pos']}, score double")
    return kept.select("readid", "pos", F.col("score").cast(scores.schema["score"].dataType).alias("score"))


def _suppress(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """The peaks that stay of runs in order; a run that goes on in the next batch waits for it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held, batch])
        begins = table.column("begins").to_numpy(zero_copy_only=False)
        last = len(begins) - 1 - int(np.argmax(begins[::-1])) if begins.any() else 0
        if last:
            yield from _stay(table.slice(0, last), distance)
        held = table.slice(last).to_batches()
    if held:
        yield from _stay(pa.Table.from_batches(held), distance)


def _stay(table: pa.Table, distance: int) -> list[pa.RecordBatch]:
    begins, pos, score = (table.column(c).to_numpy(zero_copy_only=False) for c in ("begins", "pos", "score"))
    run = np.cumsum(begins)
    alive = np.ones(len(pos), bool)
    crowded = np.bincount(run)[run] > 1
    for k in np.lexsort((pos, -score))[crowded[np.lexsort((pos, -score))]].tolist():
        if not alive[k]:
            continue
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(pos) and run[j] == run[k] and abs(pos[j] - pos[k]) < distance:
                alive[j] = False
                j += step
    return table.select(["readid", "pos", "score"]).filter(pa.array(alive)).to_batches()


def extract_edges(points: DataFrame, spans: DataFrame, threshold: float = 0.8, scale: int = 10, distance: int = 3) -> DataFrame:
    """``(readid, pos, score)``: change points of the part of each signal that its read covers.

    ``points(readid, pos, x)`` are whole signals; they are Hampel-filtered before they are cut to
    ``spans(readid, start, end)``, the end not included, and positions stay those of the whole signal. Reads
    without a span, or with one outside the signal, have no edges.
    """
    inside = hampel(points, 6, 5.0).join(spans.select("readid", "start", "end"), "readid").where("pos >= start AND pos < end")
    return cwt_peaks(inside.select("readid", "pos", "filtered"), scale, threshold, distance, "filtered")


def diff(borders: DataFrame) -> DataFrame:
    """Distance of each border to the one before, without each read's first."""
    order = Window.partitionBy("tool", "readid").orderBy("border")
    return borders.withColumn("size", F.col("border") - F.lag("border").over(order)).where("size IS NOT NULL")


def segment_end(starts: DataFrame, last: str = "last") -> DataFrame:
    """``end``: the next start of the read, ``last`` for its last segment."""
    return starts.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("readid").orderBy("start")), F.col(last)))


def running_sum(rows: DataFrame, partition: list[str], order: list, value: str) -> DataFrame:
    return rows.withColumn("running", F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def numbered(rows: DataFrame, partition: str, order: str, name: str = "n") -> DataFrame:
    """Rows with their number from 0 within ``partition``, in ``order``, without sorting a whole partition in one task.

    Rows are dealt by range over both columns and stored; a task numbers the rows of its range, and what
    the ranges before it hold of the same key is added. Only counts of a range and key are joined.
    """
    ranged = rows.repartitionByRange(partition, order).sortWithinPartitions(partition, order).withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    path = scratch(rows.sparkSession, "ranges")
    ranged.write.parquet(path)
    stored = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    counts = stored.groupBy(partition, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(partition).alias("_key"), "_range", (before - F.col("_first")).alias("_shift"))
    joined = stored.join(starts, (stored["_range"] == starts["_range"]) & stored[partition].eqNullSafe(starts["_key"]))
    return joined.select(*[stored[c] for c in rows.columns], (F.col("_id") + F.col("_shift")).alias(name))


def rolling(observations: DataFrame, n: int = 100, range_rows: int = 5_000) -> DataFrame:
    """Mean and median of the last ``n`` values of each parameter: ``(param, seq_no, value, mean, median)``.

    Rows are numbered by ranges, and the frames are then computed by ranges of ``range_rows`` rows that bring
    the ``n - 1`` rows before them along, so a hot parameter is many tasks' work from the beginning.
    """
    size = max(range_rows, n)
    placed = numbered(observations.select("param", "seq_no", "value"), "param", "seq_no", "_n")
    part, at = F.floor(F.col("_n") / size), F.col("_n") % size
    dealt = placed.withColumn("_part", F.explode(F.when(at > size - n, F.array(part, part + 1)).otherwise(F.array(part))))
    frame = Window.partitionBy("param", "_part").orderBy("_n").rowsBetween(-(n - 1), 0)
    rows = dealt.withColumns({"mean": F.avg("value").over(frame), "median": X.array_median(F.collect_list("value").over(frame))})
    return rows.where(F.col("_part") == part).drop("_n", "_part")


def top_mass(rows: DataFrame, partition: list[str], p: float, prob: str = "p", tie: str = "candidate") -> DataFrame:
    """The likeliest rows of each partition until their mass reaches ``p``, the one that crosses it included."""
    before = Window.partitionBy(*partition).orderBy(F.desc(prob), tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_mass", F.coalesce(F.sum(prob).over(before), F.lit(0))).where(F.col("_mass") < p).drop("_mass")


def batch_no(reads: DataFrame, order: list, size: int = 24, partition: list[str] = ()) -> DataFrame:
    """Number consecutive reads into batches; an incomplete last batch is left out."""
    at = Window.partitionBy(*partition).orderBy(*order)
    rows = reads.withColumn("batch", F.floor((F.row_number().over(at) - 1) / size).cast("int"))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*partition, "batch"))).where(F.col("_n") == size).drop("_n")


def partition_max(metrics: DataFrame, value: str = "number") -> DataFrame:
    return metrics.withColumn("metric_max", F.max(value).over(Window.partitionBy("metric")))


def best_per_group(metrics: DataFrame, score: str = "metric_score") -> DataFrame:
    """``best``: whether the tool reaches the metric's highest score; ties all do."""
    return metrics.withColumn("best", F.rank().over(Window.partitionBy("metric").orderBy(F.desc(score))) == 1)
