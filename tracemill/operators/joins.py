"""Joins of reads, signals, levels and borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_signal(reads: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads with their signal, calibrated where the shift says so; and reads without one."""
    keys = ["raw_file", "signalid"]
    found = reads.join(signals, keys).withColumn("signal", F.when(F.col("shift") <= 400, F.col("pa").cast("array<double>")).otherwise(F.col("adc").cast("array<double>")))
    return found.drop("pa", "adc"), reads.join(signals, keys, "left_anti")


def attach_levels(kmer_rows: DataFrame, model: DataFrame, max_rows: int = 1 << 18) -> DataFrame:
    """k-mer rows with the model's levels. A model of k-mers of at most nine letters is small enough to broadcast."""
    small = model.limit(max_rows + 1).count() <= max_rows
    return kmer_rows.join(F.broadcast(model) if small else model, "kmer")


def map_read_index(events: DataFrame, summary: DataFrame) -> DataFrame:
    return events.join(summary.select("read_index", "read_name"), "read_index")


def lookup_base(segments: DataFrame, reads: DataFrame) -> DataFrame:
    """The base at ``kmer_idx`` of each segment's read."""
    return segments.join(reads.select("readid", "seq"), "readid").withColumn("base", F.substring("seq", F.col("kmer_idx") + 1, F.lit(1))).drop("seq")


def presence(basecalled: DataFrame, segmented: DataFrame) -> DataFrame:
    """Every basecalled read with the segmented sequence, and whether there is one."""
    found = segmented.select("readid", F.col("seq").alias("segmented_seq"), F.lit(True).alias("_there"))
    return basecalled.join(found, "readid", "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def common_reads(borders: DataFrame) -> DataFrame:
    """Borders of the reads that every tool has."""
    pairs = borders.select("tool", "readid").distinct()
    n_tools = pairs.select("tool").distinct().count()
    return borders.join(pairs.groupBy("readid").count().where(F.col("count") == n_tools).select("readid"), "readid", "left_semi")


def borders_within(anchors: DataFrame, borders: DataFrame, w: int) -> DataFrame:
    """Anchor rows with each border of the read at a distance of at most ``w``, as ``near_tool, near_border``.

    An equi-join on the read and a bin of 2w+1 positions; an anchor looks into three bins.
    """
    width = 2 * w + 1
    other = borders.select("readid", F.col("tool").alias("near_tool"), F.col("border").alias("near_border"), F.floor(F.col("border") / width).alias("_bin"))
    bins = anchors.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("border") / width) + d for d in (-1, 0, 1)])))
    return bins.join(other, ["readid", "_bin"]).where(F.abs(F.col("border") - F.col("near_border")) <= w).drop("_bin")


def nearest_within(truth: DataFrame, predictions: DataFrame, max_distance: int) -> DataFrame:
    """``(tool, readid, border, near_border, offset)``: the prediction that each truth point takes.

    A truth point takes its closest prediction (the first of equals), gives it up if the truth point
    just before has it at most as far or the one just after nearer, and then takes its next-closest.
    The fallback after the first rule is still held against the second; the last one is final.
    """
    order = Window.partitionBy("tool", "readid").orderBy("border")
    rows = truth.select("readid", "border").distinct()
    near = borders_within(rows, predictions, max_distance)
    closest = near.groupBy(F.col("near_tool").alias("tool"), "readid", "border").agg(
        F.array_sort(F.collect_list(F.struct(F.abs(F.col("border") - F.col("near_border")).alias("d"), F.col("near_border").alias("at")))).alias("c")
    )
    every = rows.join(predictions.select("tool", "readid").distinct(), "readid")
    full = every.join(closest, ["tool", "readid", "border"], "left").withColumns({"_prev": F.lag("border").over(order), "_next": F.lead("border").over(order)})
    reach = lambda other, at: (F.abs(other - at) <= max_distance) & other.isNotNull()
    before = lambda x: F.coalesce(reach(F.col("_prev"), x["at"]) & (F.abs(F.col("_prev") - x["at"]) <= x["d"]), F.lit(False))
    after = lambda x: F.coalesce(reach(F.col("_next"), x["at"]) & (F.abs(F.col("_next") - x["at"]) < x["d"]), F.lit(False))
    out = full.where("c IS NOT NULL").withColumn("_a", F.get("c", F.lit(0)))
    out = out.withColumn("_b", F.when(before(F.col("_a")), F.get("c", F.lit(1))).otherwise(F.col("_a")))
    used = F.when(before(F.col("_a")), 1).otherwise(0)
    out = out.withColumn("_c", F.when(F.col("_b").isNotNull() & after(F.col("_b")), F.get("c", used + 1)).otherwise(F.col("_b")))
    return out.where("_c IS NOT NULL").select("tool", "readid", "border", F.col("_c.at").alias("near_border"), (F.col("border") - F.col("_c.at")).alias("offset"))


def pair_pre_post(pre: DataFrame, post: DataFrame) -> DataFrame:
    return pre.select("readid", F.col("z").alias("pre_z")).join(post.select("readid", F.col("z").alias("post_z")), "readid")


def truth_coverage(truth: DataFrame, borders: DataFrame) -> DataFrame:
    """``(tool, segmented_reads, total_reads, segmented_ratio)`` of the truth's reads."""
    reads = truth.select("readid").distinct()
    total = reads.count()
    found = borders.select("tool", "readid").distinct().join(reads, "readid", "left_semi")
    return found.groupBy("tool").agg(F.count("*").alias("segmented_reads")).select("tool", "segmented_reads", F.lit(total).cast("long").alias("total_reads"), (F.col("segmented_reads") / F.lit(total)).alias("segmented_ratio"))


def score_windows(segments: DataFrame, signals: DataFrame, w: int = 6) -> DataFrame:
    """Segments with the samples before and after each border and inside the segment (arrays)."""
    s, a = F.col("signal"), F.col("start")
    rows = segments.join(signals.select("readid", "signal"), "readid")
    first = F.greatest(F.lit(0), a - w)
    return rows.withColumns({"before": F.slice(s, (first + 1).cast("int"), (a - first).cast("int")), "after": F.slice(s, (a + 1).cast("int"), F.lit(w)), "inside": F.slice(s, (a + 1).cast("int"), (F.col("end") - a).cast("int"))}).drop("signal")
