"""Queries that write the domain tables in each file format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import aggs, evaluate, filters, segment
from tracemill.plans.base import query
from tracemill.plans.views import with_views as V
from tracemill.sources import readers, sinks
from tracemill.sources.scratch import scratch
from tracemill.streaming import jobs

_R = V("reads")


@query("s1_read_sam", _R + "SELECT CAST(readid AS VARCHAR) AS readid, concat('s', readid) AS signalid, md5(CASE WHEN seq = '' THEN '*' ELSE seq END) AS seq_md5, qs, CAST(n_samples AS INTEGER) AS ns, 0 AS sp, raw_file FROM reads")
def _(v):
    path = scratch(v.spark, "sam")
    # an alignment record without a sequence has a star
    r = v.reads().select(F.col("readid").cast("string").alias("readid"), F.concat(F.lit("s"), "readid").alias("signalid"), F.when(F.col("seq") == "", "*").otherwise(F.col("seq")).alias("seq"), "qs", F.col("n_samples").cast("int").alias("ns"), F.lit(None).cast("int").alias("ts"), F.lit(None).cast("int").alias("sp"), "raw_file", F.lit(None).cast("double").alias("shift"), F.lit(None).cast("double").alias("scale"))
    sinks.sam_lines(r).write.text(path)
    return readers.read_sam(v.spark, path).select("readid", "signalid", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), "qs", "ns", "sp", "raw_file")


@query("s2_load_signals", V("signals") + "SELECT CAST(readid AS VARCHAR) AS signalid, len(signal) AS samples FROM signals WHERE label < 5")
def _(v):
    path = scratch(v.spark, "signals")
    s = v.signals().select(F.lit("f").alias("raw_file"), F.col("readid").cast("string").alias("signalid"), F.lit(None).cast("array<smallint>").alias("adc"), F.col("signal").cast("array<float>").alias("pa"), "label")
    s.drop("label").write.parquet(path)
    return readers.load_signals(v.spark, path, s.where("label < 5")).select("signalid", F.size("pa").cast("long").alias("samples"))


@query("s3_kmer_model", V("model") + "SELECT kmer, level_mean, level_stdv FROM model")
def _(v):
    path = scratch(v.spark, "model")
    sinks.write_kmer_model(v.model(), path)
    return readers.read_kmer_model(v.spark, path)


@query("s4_segments_csv", V("tool_segments") + 'SELECT concat(tool, readid) AS readid, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", \'NA\' AS polish, CAST(0.5 AS DOUBLE) AS posterior_probability FROM tool_segments')
def _(v):
    path = scratch(v.spark, "segments")
    s = v.tool_segments().select(F.concat("tool", "readid").alias("readid"), F.lit("s").alias("signalid"), "start", "end", F.lit(0).alias("basepos"), F.lit("A").alias("base"), F.lit("AAAAA").alias("motif"), F.lit("M").alias("state"), F.lit(0.5).alias("posterior_probability"), F.lit("").alias("polish"))
    sinks.write_segments(s, path, csv=True)
    return readers.read_segments_csv(v.spark, path).select("readid", "start", "end", "polish", "posterior_probability")


@query("s7_resquiggle", "SELECT CAST(user_id AS VARCHAR) AS read_id, CAST(event_id AS INTEGER) AS kmer_idx, CAST(floor(value) AS INTEGER) AS start_raw_idx, CAST(floor(value) + 5 AS INTEGER) AS end_raw_idx FROM events WHERE event_type <> 'view'")
def _(v):
    path = scratch(v.spark, "resquiggle")
    none = F.col("event_type") == "view"
    start = F.floor("value")
    rows = v.table("events").select(F.col("user_id").alias("read_id"), F.col("event_id").alias("kmer_idx"), F.when(none, ".").otherwise(start.cast("string")).alias("start_raw_idx"), F.when(none, ".").otherwise((start + 5).cast("string")).alias("end_raw_idx"))
    sinks.write_table(rows, path, "\t")
    return readers.read_resquiggle_tsv(v.spark, path)


@query("s8_dtw", "SELECT CAST(user_id AS VARCHAR) AS aln_read_id, CAST(floor(value) AS INTEGER) AS dtw_start, CAST(floor(value) + 3 AS INTEGER) AS dtw_end FROM events WHERE event_type <> 'click'")
def _(v):
    path = scratch(v.spark, "dtw")
    e = v.table("events")
    start = F.when(F.col("event_type") == "click", "*").otherwise(F.floor("value").cast("string"))
    cols = [F.lit("c").alias("seq_name"), F.lit(1).alias("seq_pos"), F.lit("+").alias("seq_strand"), F.col("event_id").alias("aln_id"), F.lit("AAAAA").alias("seq_kmer"), F.col("user_id").alias("aln_read_id"), start.alias("dtw_start"), F.lit(3).alias("dtw_length"), F.col("value").alias("dtw_current"), F.lit(1.0).alias("dtw_current_sd")]
    sinks.write_table(e.select(*cols), path, "\t")
    return readers.read_dtw_tsv(v.spark, path).select("aln_read_id", "dtw_start", "dtw_end")


@query("s6_eventalign", "SELECT concat('u', user_id) AS read_name, CAST(event_id AS INTEGER) AS start_idx, substring(event_type, 1, 5) AS reference_kmer FROM events")
def _(v):
    path, names = scratch(v.spark, "eventalign"), scratch(v.spark, "summary")
    e = v.table("events")
    zero = [F.lit(0.0).alias(c) for c in ("event_level_mean", "event_stdv", "event_length")]
    tail = [F.lit(0.0).alias(c) for c in ("model_mean", "model_stdv", "standardized_level")]
    kmer = F.substring("event_type", 1, 5)
    sinks.write_table(e.select(F.lit("c").alias("contig"), F.lit(1).alias("position"), kmer.alias("reference_kmer"), F.col("user_id").alias("read_index"), F.lit("t").alias("strand"), F.col("event_id").alias("event_index"), *zero, kmer.alias("model_kmer"), *tail, F.col("event_id").alias("start_idx"), (F.col("event_id") + 1).alias("end_idx")), path, "\t")
    sinks.write_table(e.select(F.col("user_id").alias("read_index"), F.concat(F.lit("u"), "user_id").alias("read_name")).distinct(), names, "\t")
    return readers.read_eventalign(v.spark, path, names).select("read_name", "start_idx", "reference_kmer")


@query("s9_event_table", "SELECT DISTINCT user_id AS readid, 1000000 - b - 1 AS border FROM (SELECT user_id, event_id + 7 AS b FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, event_id + 7 + CAST(floor(value) AS BIGINT) FROM events WHERE event_type <> 'error')")
def _(v):
    rows = v.table("events").select(F.col("user_id").alias("readid"), F.col("event_id").alias("start"), F.floor("value").alias("length"), F.lit(7).alias("raw_start"), F.lit(1_000_000).alias("raw_length"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return readers.event_table_borders(rows, is_rna=True)


@query("s10_changepoints", V("borders") + "SELECT DISTINCT CAST(readid AS VARCHAR) AS readid, border FROM borders")
def _(v):
    path = scratch(v.spark, "changepoints")
    sinks.append_edges(v.borders().select(F.col("readid").cast("string").alias("readid"), "border").distinct(), path)
    return readers.read_changepoints(v.spark, path)


@query("k8_append_edges", V("borders") + "SELECT CAST(readid AS VARCHAR) AS readid, list(border ORDER BY tool, border) AS edges FROM borders GROUP BY readid")
def _(v):
    """Edges appended batch by batch, signals coming again, and one batch written twice."""
    path = scratch(v.spark, "edges")
    batches = sorted(r.tool for r in v.borders().select("tool").distinct().limit(1000).collect())  # event types
    for tool in [*batches, *batches[:1]]:
        sinks.append_edges(v.borders().where(F.col("tool") == tool), path, tool)
    return readers.read_edges(v.spark, path) if batches else v.spark.createDataFrame([], "readid string, edges array<long>")


@query("s12_fasta", _R + "SELECT CAST(readid AS VARCHAR) AS id, md5(seq) AS seq_md5 FROM reads")
def _(v):
    path = scratch(v.spark, "fasta")
    # sequences of two lines
    half = F.floor(F.length("seq") / 2).cast("int")
    two = F.concat(F.substring("seq", F.lit(1), half), F.lit("\n"), F.substring("seq", half + 1, F.length("seq")))
    sinks.write_fasta(v.reads().select(F.col("readid").cast("string").alias("id"), two.alias("seq")), path)
    return readers.read_fasta(v.spark, path).select("id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("s13_assembly_info", "SELECT concat('contig', p_partkey) AS contig, CAST(p_size AS BIGINT) AS length, p_retailprice AS coverage FROM part")
def _(v):
    path = scratch(v.spark, "assembly")
    v.table("part").select(F.concat(F.lit("contig"), "p_partkey"), "p_size", "p_retailprice").write.csv(path, sep="\t")
    return readers.read_assembly_info(v.spark, path)


@query("s15_metric_json", V("metrics") + "SELECT 't' AS tool, metric, count(*) AS n FROM metrics WHERE metric <> 'label' GROUP BY metric")
def _(v):
    path = scratch(v.spark, "json")
    wide = v.metrics().where("metric <> 'label'").groupBy("tool").pivot("metric").agg(F.first("value")).drop("tool")
    sinks.write_metric_json(wide.repartition(8, *wide.columns[:1]), path)
    return readers.read_metric_json(v.spark, path, "t", whole=False).groupBy("tool", "metric").agg(F.count("*").alias("n"))


@query("s16_kv_report", V("metrics") + "SELECT 'report' AS tool, metric, value FROM metrics")
def _(v):
    path = scratch(v.spark, "report")
    v.metrics().select(F.concat_ws(": ", "metric", "value")).write.text(path)
    return readers.read_kv_report(v.spark, path, "report")


@query("s16_fixed_report", V("metrics") + "SELECT 'report' AS tool, metric, value FROM metrics WHERE metric IN ('present', 'missing')")
def _(v):
    path = scratch(v.spark, "report")
    v.metrics().select(F.concat(F.lit("\tNumber of reads "), "metric", F.lit(" in total is "), "value")).write.text(path)
    return readers.read_fixed_report(v.spark, path, "report", {m: f"Number of reads {m} in total is " for m in ("present", "missing")})


@query("f9_head", _R + "SELECT readid, raw_file, qs FROM reads ORDER BY readid LIMIT 500")
def _(v):
    return filters.head(v.reads(), 500, "readid").select("readid", "raw_file", "qs")


@query("f9_pick_read", _R + "SELECT readid, raw_file, md5(seq) AS seq_md5 FROM reads WHERE readid = (SELECT max(doc_id) FROM documents)")
def _(v):
    last = v.table("documents").agg(F.max("doc_id")).first()[0]
    return filters.pick_read(v.reads(), last).select("readid", "raw_file", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("g5_quality_stats", _R + """, s AS (SELECT raw_file AS grp, CAST(sum(CAST(qs AS DECIMAL(28,6))) AS DOUBLE) / count(qs) AS mean, median(qs) AS median, max(qs) AS max, min(qs) AS min FROM reads GROUP BY raw_file)
SELECT grp, metric, round(value, 6) AS value FROM (UNPIVOT s ON mean, median, max, min INTO NAME metric VALUE value)""")
def _(v):
    return aggs.quality_stats(v.reads(), "raw_file").select(F.col("raw_file").alias("grp"), "metric", F.round("value", 6).alias("value"))


@query("k2_write_errors", V("event_reads") + "SELECT readid, CASE WHEN length(seq) < 5 THEN 'sequence shorter than k-mer' ELSE 'signal too short' END AS error FROM event_reads WHERE length(seq) < 5 OR len(x) < 2 * (length(seq) - 4)")
def _(v):
    """Failed reads go to a file beside the segments."""
    path, kind = scratch(v.spark, "segments"), v.event_reads().schema["readid"].dataType.simpleString()
    sinks.write_errors(segment.segment_reads(segment.prepare_reads(v.event_reads(), v.model())), path)
    return v.spark.read.schema(f"readid {kind}, error string").parquet(f"{path}.errors")


@query("e7_edits_after_lead")
def _(v):
    """Whole sequences, extra bases before the segmented one for nothing; held against a loop in the tests."""
    return evaluate.edit_distance(v.pairs().where("present"), free_lead=True).select("readid", "edits")


@query("s17_load_datasets", "SELECT l_returnflag AS pore, l_linestatus AS dataset, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(v):
    path = scratch(v.spark, "datasets")
    flags = v.table("lineitem").select(F.concat(F.lit("pore="), "l_returnflag").alias("p"), F.col("l_linestatus").alias("d"), "l_returnflag", "l_linestatus", "l_orderkey")
    flags.select("l_returnflag", "l_linestatus", "l_orderkey").write.partitionBy("l_returnflag", "l_linestatus").parquet(path)
    raw = v.spark.read.option("recursiveFileLookup", "true").schema("l_orderkey long").parquet(path)
    named = readers.with_dataset(raw)
    return named.groupBy(F.substring_index("pore", "=", -1).alias("pore"), F.substring_index("dataset", "=", -1).alias("dataset")).agg(F.count("*").alias("n"))


@query("s18_param_log", V("param_obs") + "SELECT 1 AS epoch, CAST(seq_no AS INTEGER) AS batch, value AS m1 FROM param_obs")
def _(v):
    path = scratch(v.spark, "log")
    log = v.param_obs().select(F.lit(1).alias("epoch"), F.col("seq_no").alias("batch"), F.lit(0).alias("read"), F.col("value").alias("m1"), F.lit(0.0).alias("zchange"))
    sinks.write_param_log(log, path)
    return readers.read_param_log(v.spark, path, ["m1"]).select("epoch", "batch", "m1")


@query("p17_normalize_segments", "SELECT concat('u', user_id) AS readid, CAST(event_id AS INTEGER) AS start, CASE WHEN length(event_type) >= 5 THEN replace(substring(event_type, 3, 1), 'U', 'T') ELSE substring(event_type, CAST(length(event_type) // 2 + 1 AS INTEGER), 1) END AS base FROM events")
def _(v):
    rows = v.table("events").select(F.concat(F.lit("u"), "user_id").alias("read_name"), F.col("user_id").alias("read_index"), F.col("event_id").cast("int").alias("start_idx"), F.col("event_id").alias("end_idx"), F.substring("event_type", 1, 5).alias("reference_kmer"))
    return readers.normalize_segments(rows)


_ANY = "SELECT *, CASE WHEN event_id % 9 <> 0 THEN event_id END AS place FROM events"


@query("s11_detect_format", V("reads") + f""", e AS ({_ANY})
SELECT 'segments' AS layout, concat('u', user_id) AS readid, event_id AS start, substring(event_type, 1, 1) AS base FROM e UNION ALL
SELECT 'eventalign', concat('u', user_id), event_id, substring(replace(event_type, 'U', 'T'), 3, 1) FROM e WHERE length(event_type) >= 5 UNION ALL
SELECT 'dtw', concat('u', user_id), place, substring(replace(event_type, 'U', 'T'), 3, 1) FROM e WHERE length(event_type) >= 5 AND place IS NOT NULL UNION ALL
SELECT 'resquiggle', CAST(readid AS VARCHAR), place, substring(seq, CAST(event_id % 40 + 1 AS INTEGER), 1) FROM e JOIN reads ON readid = user_id WHERE place IS NOT NULL""")
def _(v):
    """Segments of all four layouts, each told by its header, in one form."""
    e = v.table("events").withColumns({"id": F.concat(F.lit("u"), "user_id"), "place": F.when(F.col("event_id") % 9 == 0, "*").otherwise(F.col("event_id").cast("string")), "motif": F.substring("event_type", 1, 5)})
    long = e.where(F.length("event_type") >= 5)
    reads = v.reads().select(F.col("readid").cast("string").alias("readid"), "seq")
    layouts = [
        e.select(F.col("id").alias("readid"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), F.lit(0).alias("basepos"), F.substring("event_type", 1, 1).alias("base")),
        long.select(F.col("user_id").alias("read_index"), F.col("id").alias("read_name"), F.col("event_id").alias("start_idx"), F.col("event_id").alias("end_idx"), F.col("motif").alias("reference_kmer")),
        long.select(F.col("id").alias("aln_read_id"), F.col("place").alias("dtw_start"), F.lit(1).alias("dtw_length"), F.col("motif").alias("seq_kmer")),
        e.select(F.col("user_id").cast("string").alias("read_id"), (F.col("event_id") % 40).cast("int").alias("kmer_idx"), F.col("place").alias("start_raw_idx"), F.col("place").alias("end_raw_idx")),
    ]
    out = None
    for rows in layouts:
        layout = readers.detect_format(rows.columns)
        own = readers.normalize_segments(rows, layout, reads).select(F.lit(layout).alias("layout"), F.col("readid").cast("string").alias("readid"), F.col("start").cast("long").alias("start"), "base")
        out = own if out is None else out.unionByName(own)
    return out


@query("e7_edit_distance", "SELECT doc_id, levenshtein(coalesce(lang, ''), coalesce(source, '')) AS edits FROM documents")
def _(v):
    rows = v.table("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("a"), F.coalesce("source", F.lit("")).alias("b"))
    return evaluate.edit_distance(rows, "a", "b").select("doc_id", F.col("edits").cast("long").alias("edits"))


@query("t2_stream_rolling_param", V("param_obs") + "SELECT param, seq_no, value, round(avg(value) OVER (PARTITION BY param ORDER BY seq_no ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean FROM param_obs")
def _(v):
    """The streaming job over all events, read back when it has caught up; equal to the batch window, though rows come out of order."""
    source, out, point = (scratch(v.spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    v.param_obs().repartition(6, "value").write.parquet(source)
    stream = v.spark.readStream.schema("param string, seq_no long, value double").option("maxFilesPerTrigger", 2).parquet(source)
    jobs.stream_rolling_param(stream, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema("param string, seq_no long, value double, mean double").parquet(out).withColumn("mean", F.round("mean", 9))


@query("t3_stream_counters", _R + "SELECT CASE WHEN qs < 10 THEN 'skipped' WHEN length(seq) < 5 THEN 'error' ELSE 'ok' END AS status, count(*) AS count FROM reads GROUP BY 1")
def _(v):
    import uuid

    source, point = scratch(v.spark, "stream-in"), scratch(v.spark, "stream-state")
    v.reads().select("readid", "qs", F.when(F.length("seq") < 5, "short").alias("error")).write.parquet(source)
    stream = v.spark.readStream.schema("readid long, qs double, error string").parquet(source)
    name = f"counters_{uuid.uuid4().hex}"
    jobs.stream_counters(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", point).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return v.spark.table(name)


@query("t1_stream_segment", V("event_reads") + "SELECT readid, length(seq) - 4 AS segments, CAST(len(x) AS BIGINT) AS samples, CAST(len(x) AS INTEGER) AS last_end FROM event_reads WHERE length(seq) >= 5 AND len(x) >= 2 * (length(seq) - 4)")
def _(v):
    """Every read of the stream, as its segments were written: how many, the samples in them, and where the last ends."""
    source, out, point, model = (scratch(v.spark, n) for n in ("stream-in", "stream-out", "stream-state", "stream-model"))
    v.event_reads().write.parquet(source)
    v.model().write.parquet(model)
    stream = v.spark.readStream.schema("readid long, seq string, x array<double>").parquet(source)
    jobs.stream_segment(stream, v.spark.read.schema("kmer string, level_mean double, level_stdv double").parquet(model), out, point).awaitTermination()
    return v.spark.read.parquet(out).groupBy("readid").agg(F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).cast("long").alias("samples"), F.max("end").alias("last_end"))
