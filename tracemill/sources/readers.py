"""Readers of alignment text, signals, tool outputs and reports. Every schema is given, none inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators.filters import drop_sentinel


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of SAM text, in the ``reads`` schema; missing tags are null.

    ``signalid`` is the tag ``pi`` where there is one, the read's id else; ``sp`` is 0 by default; the
    raw file is the tag ``fn``, else ``f5``.
    """
    c = F.split("value", "\t")
    tags = F.map_from_entries(F.array_distinct(F.transform(F.slice(c, F.lit(12), F.greatest(F.size(c) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(6), F.length(x)).alias("v")))))
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(c.alias("c"), tags.alias("t"))
    tag = lambda k: F.try_element_at("t", F.lit(k))
    num = lambda k, kind: tag(k).try_cast(kind)
    name = F.get("c", F.lit(0))
    mv = F.transform(F.split(F.regexp_replace(tag("mv"), "^c,", ""), ","), lambda x: x.try_cast("tinyint"))
    return rows.select(
        name.alias("readid"), F.coalesce(tag("pi"), name).alias("signalid"), F.get("c", F.lit(9)).alias("seq"), num("qs", "double").alias("qs"), num("ns", "int").alias("ns"), num("ts", "int").alias("ts"),
        F.coalesce(num("sp", "int"), F.lit(0)).alias("sp"), F.coalesce(tag("fn"), tag("f5")).alias("raw_file"), num("sm", "double").alias("shift"), num("sd", "double").alias("scale"), F.when(tag("mv").isNotNull(), mv).alias("mv"),
    )


def load_signals(spark: SparkSession, path: str, reads: DataFrame) -> DataFrame:
    """The signals of some reads, by raw file and signal id; only the columns of the schema are read."""
    keys = ["raw_file", "signalid"]
    return spark.read.schema(schemas.SIGNALS).parquet(path).join(reads.select(*keys).distinct(), keys, "left_semi")


def read_kmer_model(spark: SparkSession, path: str) -> DataFrame:
    """Levels by k-mer; k-mers of different lengths are an error."""
    model = spark.read.csv(path, sep="\t", header=True, schema=schemas.KMER_MODEL)
    sizes = model.agg(F.min(F.length("kmer")), F.max(F.length("kmer"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"k-mers of {sizes[0]} to {sizes[1]} letters in {path}")
    return model


def read_segments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Segments with a header; malformed lines are dropped."""
    return spark.read.csv(path, header=True, schema=schemas.SEGMENTS, mode="DROPMALFORMED")


def read_moves_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.MOVES, mode="DROPMALFORMED")


def read_eventalign(spark: SparkSession, path: str, summary: str) -> DataFrame:
    """Events with their reads' names; the summary's first two columns map the index."""
    names = spark.read.csv(summary, sep="\t", header=True, schema="read_index int, read_name string", enforceSchema=True)
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.EVENTALIGN).join(names, "read_index")


def read_resquiggle_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a segment; ``.`` stands for none."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=schemas.RESQUIGGLE)
    return drop_sentinel(raw, "kmer_idx", "start_raw_idx", "end_raw_idx")


def read_dtw_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a start; the end is the start plus the length."""
    raw = drop_sentinel(spark.read.csv(path, sep="\t", header=True, schema=schemas.DTW), "dtw_start", "dtw_length")
    return raw.withColumn("dtw_end", F.col("dtw_start") + F.col("dtw_length"))


def event_table_borders(events: DataFrame, is_rna: bool = False) -> DataFrame:
    """``(readid, border)`` from ``(readid, start, length, raw_start, raw_length, status)``; failed reads are left out.

    RNA borders are mirrored within the raw signal.
    """
    rows = events.where("status = 'success'").select("readid", "raw_length", F.explode(F.array(F.col("raw_start") + F.col("start"), F.col("raw_start") + F.col("start") + F.col("length"))).alias("b"))
    return rows.select("readid", (F.col("raw_length") - F.col("b") - 1 if is_rna else F.col("b")).alias("border")).distinct()


def read_changepoints(spark: SparkSession, path: str) -> DataFrame:
    """``(readid, border)`` of all batches."""
    return spark.read.schema("readid string, border long, batch string").parquet(path).select("readid", "border")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(readid, edges)``: the edges of each signal, those of a later batch behind those of an earlier one."""
    rows = spark.read.schema("readid string, border long, batch string").parquet(path)
    return rows.groupBy("readid").agg(F.transform(F.sort_array(F.collect_list(F.struct("batch", "border"))), lambda e: e["border"]).alias("edges"))


_LAYOUTS = {
    "segments": {"readid", "start", "end", "basepos", "base"}, "resquiggle": {"read_id", "kmer_idx", "start_raw_idx", "end_raw_idx"},
    "eventalign": {"read_index", "start_idx", "end_idx", "reference_kmer"}, "dtw": {"aln_read_id", "dtw_start", "dtw_length", "seq_kmer"},
}


def detect_format(columns: list[str]) -> str:
    """Which of the four layouts a header has, whatever its case; dots count as underscores."""
    have = {c.lower().replace(".", "_") for c in columns}
    for name, need in _LAYOUTS.items():
        if need <= have:
            return name
    raise ValueError(f"unknown columns: {', '.join(columns)}")


def normalize_segments(rows: DataFrame, layout: str | None = None, reads: DataFrame | None = None) -> DataFrame:
    """``(readid, start, base)`` from any of the four layouts; resquiggle rows take the base from the reads."""
    from tracemill.functions.exprs import base_from_motif

    layout = layout or detect_format(rows.columns)
    if layout == "segments":
        return rows.select("readid", "start", "base")
    if layout == "eventalign":
        return rows.select(F.col("read_name").alias("readid"), F.col("start_idx").alias("start"), base_from_motif(F.col("reference_kmer")).alias("base"))
    if layout == "dtw":
        good = drop_sentinel(rows, "dtw_start")
        return good.select(F.col("aln_read_id").alias("readid"), F.col("dtw_start").alias("start"), base_from_motif(F.col("seq_kmer")).alias("base"))
    good = drop_sentinel(rows, "kmer_idx", "start_raw_idx").join(reads.select(F.col("readid").alias("read_id"), "seq"), "read_id")
    return good.select(F.col("read_id").alias("readid"), F.col("start_raw_idx").alias("start"), F.substring("seq", F.col("kmer_idx") + 1, F.lit(1)).alias("base"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(id, seq)``; a sequence may run over several lines."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "").select(F.split("value", "\r?\n").alias("l"))
    return rows.select(F.trim(F.get("l", F.lit(0))).alias("id"), F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), F.trim), "").alias("seq"))


def _or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A commented table; no rows where there is no such file."""
    try:
        return spark.read.csv(path, sep="\t", comment="#", schema=schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_assembly_info(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, length, coverage)``; lines that begin with # are comments. A missing file has no contigs."""
    return _or_none(spark, path, "contig string, length long, coverage double")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants; a missing file has none."""
    return _or_none(spark, path, "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string")


def read_metric_json(spark: SparkSession, path: str, tool: str, whole: bool = True) -> DataFrame:
    """``(tool, metric, value)`` of a flat JSON object for each file, or each line; ``lengths`` is dropped, ``n50`` renamed."""
    rows = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", "map<string,string>")).alias("metric", "value"))
    return rows.where("metric <> 'lengths'").select(F.lit(tool).alias("tool"), F.when(F.col("metric") == "n50", "n50_length").otherwise(F.col("metric")).alias("metric"), "value")


def read_kv_report(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """``(tool, metric, value)`` of ``key: value`` lines."""
    pattern = r"^\s*([^:]+?)\s*:\s*(.*?)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.lit(tool).alias("tool"), F.regexp_extract("value", pattern, 1).alias("metric"), F.regexp_extract("value", pattern, 2).alias("value"))


def read_fixed_report(spark: SparkSession, path: str, tool: str, prefixes: dict[str, str]) -> DataFrame:
    """``(tool, metric, value)`` of lines that begin with a metric's prefix; the value is what follows it."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"^\s+", "").alias("line"))
    found = [F.when(F.col("line").startswith(p), F.struct(F.lit(m).alias("metric"), F.trim(F.substring("line", F.lit(len(p) + 1), F.length("line"))).alias("value"))) for m, p in prefixes.items()]
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("r")).select(F.lit(tool).alias("tool"), "r.metric", "r.value")


def with_dataset(rows: DataFrame, depth: int = 2) -> DataFrame:
    """Adds ``pore`` and ``dataset`` from the last folders of each row's file: .../pore/dataset/file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.withColumns({"pore": F.element_at(parts, -depth - 1), "dataset": F.element_at(parts, -depth)})


def read_param_log(spark: SparkSession, path: str, params: list[str]) -> DataFrame:
    columns = ", ".join(f"`{p}` double" for p in params)
    return spark.read.csv(path, header=True, schema=f"epoch int, batch int, read int, {columns}, zchange double")


