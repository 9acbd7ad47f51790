"""Aggregations over borders, lengths, metrics and expected counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators.joins import borders_within

#: Metrics of which less is better: their scores are turned round.
LESS_IS_BETTER = ("Homogeneity", "missing", "truncated", "nt_changed", "min_length")


def border_set(segments: DataFrame) -> DataFrame:
    """Distinct starts and ends of each tool and read."""
    return segments.select("tool", "readid", F.explode(F.array("start", "end")).alias("border")).where("border IS NOT NULL").distinct()


def _bit(tools: list[str], column: str):
    place = F.array_position(F.array(*map(F.lit, tools)), F.col(column)).cast("int") - 1
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def subset_overlap(borders: DataFrame, tools: list[str], w: int = 0) -> DataFrame:
    """``(mask, n)``: for each set of tools (bit i: tools[i]) its borders that all of them have within ``w``.

    A border of any tool of the set counts once. Only sets with borders are returned.
    """
    bit = _bit(tools, "tool")
    own = borders.withColumn("bit", bit).groupBy("readid", "border").agg(F.bit_or("bit").alias("own"))
    if w:
        near = borders_within(own, borders, w).withColumn("bit", _bit(tools, "near_tool"))
        own = near.groupBy("readid", "border").agg(F.first("own").alias("own"), F.bit_or("bit").alias("near"))
    else:
        own = own.withColumn("near", F.col("own"))
    counted = own.groupBy("own", "near").agg(F.count("*").alias("n"))  # at most 4^tools rows
    sets = counted.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << len(tools)) - 1).cast("long"))))
    inside = sets.where((F.col("near").bitwiseAND(F.col("mask")) == F.col("mask")) & (F.col("own").bitwiseAND(F.col("mask")) != 0))
    return inside.groupBy("mask").agg(F.sum("n").alias("n"))


def segmented_ratio(reads_by_tool: DataFrame, base_tool: str) -> DataFrame:
    counts = reads_by_tool.groupBy("tool").agg(F.count_distinct("readid").alias("reads"))
    base = F.first(F.when(F.col("tool") == base_tool, F.col("reads")), ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy(F.col("tool") != base_tool).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("ratio", F.col("reads") / base)  # a row for each tool


def n50(lengths: DataFrame, group: str = "grp", length: str = "len") -> DataFrame:
    """The length at which the longest sequences hold half of all bases.

    Lengths are summed first, so the ranking has a row for each different length only.
    """
    by_length = lengths.groupBy(group, length).agg(F.sum(F.col(length).cast("long")).alias("bases"))
    down = Window.partitionBy(group).orderBy(F.desc(length))
    rows = by_length.withColumns({"running": F.sum("bases").over(down), "total": F.sum("bases").over(Window.partitionBy(group))})
    return rows.where("2 * running >= total").groupBy(group).agg(F.max(length).alias("n50"))


def length_stats(lengths: DataFrame, group: str = "grp", length: str = "len") -> DataFrame:
    """``(group, metric, value)``: N50, mean, median, max and min."""
    stats = lengths.groupBy(group).agg(
        (F.sum(F.col(length).cast("decimal(28,6)")) / F.count(length)).cast("double").alias("mean"), F.percentile(length, F.lit(0.5)).alias("median"),
        F.max(length).cast("double").alias("max"), F.min(length).cast("double").alias("min"),
    )
    wide = stats.join(n50(lengths, group, length).withColumn("n50", F.col("n50").cast("double")), group)
    return wide.unpivot([group], ["n50", "mean", "median", "max", "min"], "metric", "value")


def quality_stats(reads: DataFrame, group: str = "grp", quality: str = "qs") -> DataFrame:
    """``(group, metric, value)``: mean, median, max and min."""
    stats = reads.groupBy(group).agg(
        (F.sum(F.col(quality).cast("decimal(28,6)")) / F.count(quality)).cast("double").alias("mean"), F.percentile(quality, F.lit(0.5)).alias("median"),
        F.max(quality).cast("double").alias("max"), F.min(quality).cast("double").alias("min"),
    )
    return stats.unpivot([group], ["mean", "median", "max", "min"], "metric", "value")


def median_scores(scores: DataFrame, qualities: list[str]) -> DataFrame:
    """Median of each quality by tool; NaN is left out."""
    clean = scores.where(~F.isnan("score"))
    return clean.groupBy("tool").pivot("quality", qualities).agg(F.percentile("score", F.lit(0.5)))


def border_scores(windows: DataFrame) -> DataFrame:
    """``delta_median, delta_mad, homogeneity`` of inner borders, from ``before``, ``after`` and ``inside``.

    Homogeneity is the MAD of the segment without a tenth (one sample at least) at either end, null below ten samples.
    """
    n = F.size("inside")
    trim = F.greatest((n * 0.1).cast("int"), F.lit(1))
    inner = F.slice(F.col("inside"), trim + 1, n - 2 * trim)
    return windows.withColumns(
        {
            "delta_median": F.abs(X.array_median(F.col("after")) - X.array_median(F.col("before"))),
            "delta_mad": F.abs(X.array_mad(F.col("after")) - X.array_mad(F.col("before"))),
            "homogeneity": F.when(n >= 10, X.array_mad(inner)),
        }
    ).drop("before", "after", "inside")


def found_edges_curve(nearest: DataFrame, max_distance: int) -> DataFrame:
    """``(tool, distance, found)``: offsets s counted at distances d >= s for s >= 0 and d <= s for s <= 0."""
    counts = nearest.groupBy("tool", "offset").agg(F.count("*").alias("n"))  # few rows for each tool
    # a prediction after its truth point has a positive distance
    rows = counts.withColumn("s", -F.col("offset")).withColumn("distance", F.explode(F.when(F.col("offset") == 0, F.sequence(F.lit(-max_distance), F.lit(max_distance))).when(F.col("offset") < 0, F.sequence((-F.col("offset")).cast("int"), F.lit(max_distance))).otherwise(F.sequence(F.lit(-max_distance), (-F.col("offset")).cast("int")))))
    return rows.groupBy("tool", F.col("distance").cast("int").alias("distance")).agg(F.sum("n").alias("found"))


def absolute_curve(curve: DataFrame, coverage: DataFrame, total_borders: int) -> DataFrame:
    """``(tool, distance, found, ratio)`` by absolute distance; exact hits, in both signs, count once."""
    zero = F.max(F.when(F.col("distance") == 0, F.col("found"))).over(Window.partitionBy("tool"))
    rows = curve.withColumn("_z", F.coalesce(zero, F.lit(0)))
    both = rows.groupBy("tool", F.abs("distance").alias("distance")).agg(F.sum("found").alias("f"), F.first("_z").alias("z"))
    out = both.withColumn("found", F.when(F.col("distance") != 0, F.col("f") - F.col("z")).otherwise(F.col("f")))
    return out.join(coverage.select("tool"), "tool", "left_semi").select("tool", "distance", "found", (F.col("found") / F.lit(total_borders)).alias("ratio"))


def segment_size_histogram(sizes: DataFrame) -> DataFrame:
    """Counts of sizes in bins of ten from 0 to 200, everything larger in the last: ``(tool, bin, n)``."""
    return sizes.groupBy("tool", F.least(F.floor(X.clip(F.col("size"), 0, 200) / 10), F.lit(20)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def normalized_metric_score(metrics: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """``metric_score``: the value over the metric's highest, zero where that isn't positive or the value no number."""
    number = F.when(F.col("metric").isin(*excluded), None).otherwise(X.to_numeric(F.col("value"))) if excluded else X.to_numeric(F.col("value"))
    rows = metrics.withColumn("number", number).withColumn("_max", F.max("number").over(Window.partitionBy("metric")))
    score = F.when(F.col("number").isNull() | (F.col("_max") <= 0), 0.0).otherwise(F.col("number") / F.col("_max"))
    turned = F.col("metric").isin(*LESS_IS_BETTER)
    return rows.withColumn("metric_score", F.when(turned, 1 - score).otherwise(score)).drop("_max", "number")


def aggregated_metric_score(scored: DataFrame, names: list[str]) -> DataFrame:
    return scored.where(F.col("metric").isin(*names)).groupBy("tool").agg(F.sum("metric_score").alias("total_score"))


def pivot_mean(rows: DataFrame, datasets: list, value: str = "value") -> DataFrame:
    """Tools by datasets (means), with ``row_mean`` over the datasets that the tool has."""
    wide = rows.groupBy("tool").pivot("dataset", datasets).agg(F.avg(value))
    cells = F.filter(F.array(*[F.col(str(d)) for d in datasets]), lambda x: x.isNotNull())
    return wide.withColumn("row_mean", F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells))


def margins(rows: DataFrame, value: str = "value") -> DataFrame:
    """Means for each tool and dataset, each tool, each dataset and over all; null marks a margin."""
    return rows.cube("tool", "dataset").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def metric_rows_union(metrics: DataFrame, defaults: list[tuple[str, str, str]]) -> DataFrame:
    base = metrics.sparkSession.createDataFrame(defaults, "tool string, metric string, value string")
    return metrics.select("tool", "metric", "value").unionByName(base)


def assembly_stats(contigs: DataFrame, group: str = "grp") -> DataFrame:
    """Total length, N50 and mean coverage (zero for none) of an assembly."""
    stats = contigs.groupBy(group).agg(F.sum(F.col("len").cast("long")).alias("total_length"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"))
    return stats.join(n50(contigs, group), group)


def count_sv(vcf: DataFrame) -> DataFrame:
    return vcf.agg(F.count_if(F.coalesce(F.col("info").contains("SVTYPE"), F.lit(False))).alias("n_sv"))


def edge_base_ratio(edges: DataFrame, bases: int, thresholds: list[float]) -> DataFrame:
    """``(threshold, edges, ratio)``: peaks of at least the threshold for each base of all reads."""
    per = edges.select("score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    found = per.groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("edges"))
    return found.withColumn("ratio", F.try_divide("edges", F.lit(bases)))


def emission_update(stats: DataFrame, model: DataFrame, *by: str) -> DataFrame:
    """New levels from expected counts ``(kmer, w, wx, wxx)``; a k-mer without weight keeps its old ones."""
    keys = [*by, "kmer"]
    sums = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wxx")])
    mean = F.col("wx") / F.col("w")
    new = sums.where("w > 0").select(*keys, mean.alias("new_mean"), F.sqrt(F.greatest(F.col("wxx") / F.col("w") - mean * mean, F.lit(1e-12))).alias("new_stdv"))
    if by:
        return new.select(*keys, F.col("new_mean").alias("level_mean"), F.col("new_stdv").alias("level_stdv"))
    out = model.join(new, "kmer", "left")
    return out.select("kmer", F.coalesce("new_mean", "level_mean").alias("level_mean"), F.coalesce("new_stdv", "level_stdv").alias("level_stdv"))


def log_sum_exp(rows: DataFrame, keys: list[str], value: str, name: str = "log_sum") -> DataFrame:
    """Log of the summed exponentials by key, in two steps that don't overflow; all minus infinity stays so."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("_m"))
    scaled = rows.join(top, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), F.sum(F.when(F.col("_m") > float("-inf"), F.exp(F.col(value) - F.col("_m")))).alias("_s"))
    return scaled.select(*keys, F.when(F.col("_m") == float("-inf"), F.col("_m")).otherwise(F.col("_m") + F.log("_s")).alias(name))


def transition_update(counts: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Match and extend logs normalised to sum to one, from expected log counts ``(m1, e2)``; zero for none."""
    keys = list(keys)
    rows = counts.unpivot([*keys], ["m1", "e2"], "param", "v").where(F.col("v") > float("-inf"))
    summed = log_sum_exp(rows, [*keys, "param"], "v")
    total = log_sum_exp(summed.withColumnRenamed("log_sum", "v"), keys or ["_all"], "v", "_t") if keys else None
    if total is None:
        both = summed.withColumn("_all", F.lit(1))
        total = log_sum_exp(both.withColumnRenamed("log_sum", "v"), ["_all"], "v", "_t")
        return both.join(total, "_all").select("param", F.exp(F.col("log_sum") - F.col("_t")).alias("value"))
    return summed.join(total, keys).select(*keys, "param", F.exp(F.col("log_sum") - F.col("_t")).alias("value"))


def mean_delta_z(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg(F.col("post_z") - F.col("pre_z")).alias("zchange"))


def reduce_model(model: DataFrame, start: int = 2, stop: int = 7) -> DataFrame:
    """Longer k-mers averaged over their letters ``start`` to ``stop``."""
    return model.groupBy(F.substring("kmer", start + 1, stop - start).alias("kmer")).agg(F.avg("level_mean").alias("level_mean"), F.avg("level_stdv").alias("level_stdv"))


def base_posterior(rows: DataFrame) -> DataFrame:
    """Posterior of each base by sample, from ``(readid, t, base, p)``."""
    return rows.groupBy("readid", F.col("t").alias("sample")).pivot("base", list("ACGT")).agg(F.sum("p")).na.fill(0.0, list("ACGT"))


def segments_to_sequence(segments: DataFrame, is_rna: bool = False) -> DataFrame:
    """Bases of each read in order of (start, base), joined; reversed for RNA."""
    joined = segments.groupBy("readid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "base"))), lambda s: s["base"]), "").alias("seq"))
    return joined.withColumn("seq", F.reverse("seq")) if is_rna else joined


def regions_per_read(regions: DataFrame) -> DataFrame:
    """Split records of one signal together: bases summed, regions in order."""
    return regions.groupBy("signalid").agg(F.sum("n_bases").alias("n_bases"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("regions"))


def read_recovery_stats(pairs: DataFrame) -> DataFrame:
    """Counts over ``(seq, segmented_seq, present)``: total, present, missing, identical, truncated, edits."""
    both = F.col("present")
    return pairs.agg(
        F.count("*").alias("total"), F.count_if(both).alias("present"), F.count_if(~both).alias("missing"), F.count_if(both & (F.col("seq") == F.col("segmented_seq"))).alias("identical"),
        F.count_if(both & (F.length("segmented_seq") < F.length("seq"))).alias("truncated"), F.coalesce(F.sum(F.when(both, X.edits(F.col("seq"), F.col("segmented_seq")))), F.lit(0)).cast("long").alias("nt_changed"),
    )
