"""Writers. Spark's own sinks; files are named by folder, as Spark names them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.exprs import polish_text


def write_segments(segments: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet with zstd, or gzip CSV with six decimals; an empty polish is NA."""
    rows = segments.withColumn("polish", polish_text(F.col("polish")))
    if csv:
        rows.withColumn("posterior_probability", F.format_string("%.6f", "posterior_probability")).write.csv(path, header=True, compression="gzip")
    else:
        rows.write.parquet(path, compression="zstd")


def write_errors(segments: DataFrame, path: str, part: str = "") -> None:
    """Reads that failed, beside the segments; a part that is written again is replaced."""
    segments.where("error IS NOT NULL").write.mode("overwrite" if part else "error").parquet(f"{path.rstrip('/')}.errors/{part}")


def write_kmer_model(model: DataFrame, path: str) -> None:
    """At most 4^9 rows: one file."""
    model.select("kmer", "level_mean", "level_stdv").coalesce(1).write.csv(path, sep="\t", header=True)


def write_param_log(log: DataFrame, path: str) -> None:
    log.write.csv(path, header=True, mode="append")


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq")).write.text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.csv(path, sep=sep, header=True)


def write_metric_json(stats: DataFrame, path: str) -> None:
    stats.select(F.to_json(F.struct("*"))).write.text(path)


def append_edges(edges: DataFrame, path: str, batch: str = "0") -> None:
    """``(readid, border)`` of one batch, added to what ``path`` has; a batch that is written again replaces itself.

    A signal that comes again in another batch gets its new edges behind the earlier ones: see ``read_edges``.
    """
    edges.select(F.col("readid").cast("string").alias("readid"), F.col("border").cast("long").alias("border")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def sam_lines(reads: DataFrame) -> DataFrame:
    """SAM text of reads, one line each; null tags are left out."""
    tag = lambda name, kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), F.col(c).cast("string")))
    fixed = [F.col("readid"), F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), F.lit("*")]
    tags = [tag("qs", "f", "qs"), tag("ns", "i", "ns"), tag("ts", "i", "ts"), tag("sp", "i", "sp"), tag("fn", "Z", "raw_file"), tag("sm", "f", "shift"), tag("sd", "f", "scale"), tag("pi", "Z", "signalid")]
    return reads.select(F.concat_ws("\t", *fixed, *tags).alias("value"))
