"""Evaluation jobs: compositions of the joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, joins, segment, windows


def moves_to_segments(reads: DataFrame) -> DataFrame:
    """``(readid, position, start, end)`` from ``mv`` (stride first, then a flag for each block), ``ts`` and ``ns``.

    Blocks run 3' to 5': base 0 ends at ``ns``.
    """
    flags = reads.select("readid", "ts", "ns", F.get("mv", F.lit(0)).cast("int").alias("stride"), F.posexplode(F.slice("mv", F.lit(2), F.size("mv"))).alias("i", "f")).where("f = 1")
    rows = flags.select("readid", "ns", (F.col("ts") + F.col("i") * F.col("stride")).alias("start"))
    down = Window.partitionBy("readid").orderBy(F.desc("start"))
    return rows.select("readid", (F.row_number().over(down) - 1).alias("position"), "start", F.coalesce(F.lag("start").over(down), F.col("ns")).alias("end"))


def random_controls(regions: DataFrame, seed: int = 42, piece: int = 10_000) -> DataFrame:
    """For each read as many positions of its regions as it has bases, without replacement, by a hash of position and seed.

    Regions are few bytes and many positions: they are dealt in pieces of ``piece`` positions before these are made,
    and the positions of a read are numbered by ranges of their hash, so no task holds all reads, or the whole of one.
    """
    bounds = regions.select("readid", "n_bases", F.explode("regions").alias("r")).where("r.end > r.start").select("readid", "n_bases", F.col("r.end").cast("long").alias("end"), F.explode(F.sequence(F.col("r.start").cast("long"), F.col("r.end").cast("long") - 1, F.lit(piece).cast("long"))).alias("at"))
    dealt = bounds.repartition(segment.tasks(regions.sparkSession), "readid", "at")
    rows = dealt.select("readid", "n_bases", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + piece, F.col("end")) - 1)).alias("border")).distinct()
    order = F.struct(F.md5(F.concat_ws("|", "readid", "border", F.lit(seed)).cast("binary")).alias("hash"), "border")
    return windows.numbered(rows.withColumn("_order", order), "readid", "_order", "_k").where("_k < n_bases").select("readid", "border")


def uniform_controls(regions: DataFrame) -> DataFrame:
    rows = regions.select("readid", "n_bases", F.explode("regions").alias("r"))
    return rows.select("readid", F.explode(X.linspace_borders(F.col("r.start"), F.col("r.end"), F.col("n_bases"))).alias("border"))


def compare_tools(borders: DataFrame, tools: list[str], w: int = 0) -> DataFrame:
    return aggs.subset_overlap(joins.common_reads(borders), tools, w)


def scored_borders(segments: DataFrame, signals: DataFrame, w: int = 6) -> DataFrame:
    """Every inner border with its three scores as columns."""
    order = Window.partitionBy("tool", "readid").orderBy("start")
    inner = segments.withColumns({"_f": F.row_number().over(order), "_n": F.lead("start").over(order)}).where("_f > 1").drop("_f", "_n")
    return aggs.border_scores(joins.score_windows(inner, signals, w))


def score_tools(segments: DataFrame, signals: DataFrame, w: int = 6) -> DataFrame:
    """``(tool, quality, score)`` of every inner border."""
    scored = scored_borders(segments, signals, w)
    return scored.unpivot(["tool", "readid", "start"], ["delta_median", "delta_mad", "homogeneity"], "quality", "score").where("score IS NOT NULL")


def evaluate_truth(truth: DataFrame, borders: DataFrame, max_distance: int) -> DataFrame:
    """Found borders by signed distance of each tool with the truth's totals."""
    nearest = joins.nearest_within(truth, borders, max_distance)
    total = truth.select("readid", "border").distinct().count()
    curve = aggs.found_edges_curve(nearest, max_distance).withColumn("total", F.lit(total).cast("long"))
    return curve.withColumn("found_ratio", F.col("found") / F.lit(total)).join(joins.truth_coverage(truth, borders), "tool")


def metric_report(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Scored metrics, whether each is its metric's best, and the tool's total over ``names``."""
    scored = windows.best_per_group(aggs.normalized_metric_score(metrics))
    return scored.join(aggs.aggregated_metric_score(scored, names), "tool")


def edit_distance(pairs: DataFrame, a: str = "seq", b: str = "segmented_seq", free_lead: bool = False) -> DataFrame:
    """Edit distance of whole sequences, with unit costs; with ``free_lead`` extra bases that ``b`` begins with cost nothing."""
    return pairs.withColumn("edits", X.edits(F.col(a), F.col(b), free_lead))


def evaluate_reads(basecalled: DataFrame, segmented: DataFrame) -> DataFrame:
    """``(metric, value)``: recovery counts and edits over the basecalled reads, length statistics of the recovered ones."""
    pairs = joins.presence(basecalled, segmented)
    counts = aggs.read_recovery_stats(pairs)
    counts = counts.select(*[F.col(c).cast("double").alias(c) for c in counts.columns]).unpivot([], counts.columns, "metric", "value")
    lengths = pairs.where("present").select(F.lit("segmented").alias("grp"), F.length("segmented_seq").alias("len"))
    return counts.unionByName(aggs.length_stats(lengths).select(F.concat("metric", F.lit("_length")).alias("metric"), "value"))
