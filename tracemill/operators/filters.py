"""Row filters on reads and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import exprs as X


def min_qscore(reads: DataFrame, q: float | None) -> DataFrame:
    """Reads of at least this quality; none or zero keeps all."""
    return reads.where(F.col("qs") >= q) if q else reads


def skip_counters(reads: DataFrame, q: float | None) -> DataFrame:
    """How many reads the quality filter keeps and skips, by raw file."""
    good = F.col("qs") >= q if q else F.lit(True)
    return reads.groupBy("raw_file").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


def drop_low_complexity(reads: DataFrame, limit: float = 0.6) -> DataFrame:
    """Reads in which no base makes up ``limit`` or more; empty sequences go. A sequence is made once, however many times it is named."""
    return reads.where(X.let(F.col("seq"), lambda seq: F.greatest(*[X.nt_ratio(seq, b) for b in "ACGT"])) < limit)


def validate(reads: DataFrame, k: int, samples: str = "n_samples", alphabet: str = "ACGT") -> DataFrame:
    """Adds ``error``: why a read can't be segmented, or null."""
    n, t = F.length("seq") - k + 1, F.col(samples)
    reason = (
        F.when(t < 1, "empty signal").when(F.length("seq") < k, "sequence shorter than k-mer").when(t < 2 * n, "signal too short")
        .when(~F.col("seq").rlike(f"^[{alphabet}]+$"), "letter outside the model")
    )
    return reads.withColumn("error", reason)


def drop_sentinel(rows: DataFrame, *columns: str) -> DataFrame:
    """Text columns to int; rows with a sentinel or anything unparsable go."""
    out = rows.withColumns({c: F.col(c).try_cast("int") for c in columns})
    return out.dropna(subset=list(columns))


def dedupe_segments(segments: DataFrame) -> DataFrame:
    return segments.dropDuplicates()


def is_structural(vcf: DataFrame, info: str = "info") -> DataFrame:
    return vcf.withColumn("structural", F.coalesce(F.col(info).contains("SVTYPE"), F.lit(False)))


def keep_metrics(metrics: DataFrame, names: list[str], drop_tools: list[str] = ()) -> DataFrame:
    out = metrics.where(F.col("metric").isin(*names))
    return out.where(~F.col("tool").isin(*drop_tools)) if drop_tools else out


def reject_training_outliers(stats: DataFrame, tail_kmer: str, least: float = 0.5) -> DataFrame:
    """Emission statistics without the reads whose new mean of the tail k-mer is below ``least``."""
    bad = stats.where((F.col("kmer") == tail_kmer) & (F.col("wx") < least * F.col("w"))).select("readid").distinct()
    return stats.join(bad, "readid", "left_anti")


def pick_read(rows: DataFrame, readid) -> DataFrame:
    return rows.where(F.col("readid") == readid)


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in this order, which must leave no ties."""
    return rows.orderBy(*order).limit(n)


def z_consistent(rows: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Adds ``error`` where forward and backward scores are not finite or differ per cell."""
    finite = ~F.isnan("zf") & ~F.isnan("zb") & (F.abs("zf") != float("inf")) & (F.abs("zb") != float("inf"))
    return rows.withColumn("error", F.when(~finite, "score is not finite").when(F.abs(F.col("zf") - F.col("zb")) / F.col("cells") > tolerance, "forward and backward scores differ"))
