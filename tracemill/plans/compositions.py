"""Queries on compositions: signals with reads, score changes, evaluation against a truth, extracted edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import aggs, evaluate, filters, joins, windows
from tracemill.plans.base import query
from tracemill.plans.borders import _CURVE
from tracemill.plans.series import _EDGES, _edges
from tracemill.plans.views import with_views as V
from tracemill.sources import readers, sinks
from tracemill.sources.scratch import scratch


@query("j1_attach_signal", V("signals") + """, r AS (SELECT readid, label, label % 3 = 0 AS raw, label < 7 AS there FROM signals)
SELECT raw, there, count(*) AS reads, CAST(sum(CASE WHEN there THEN 64 ELSE 0 END) AS BIGINT) AS samples FROM r GROUP BY raw, there""")
def _(v):
    s = v.signals()
    reads = s.select(F.lit("f").alias("raw_file"), F.col("readid").cast("string").alias("signalid"), F.when(F.col("label") % 3 == 0, 500.0).otherwise(90.0).alias("shift"))
    signals = s.where("label < 7").select(F.lit("f").alias("raw_file"), F.col("readid").cast("string").alias("signalid"), F.transform("signal", lambda x: (x * 1000).cast("smallint")).alias("adc"), F.col("signal").cast("array<float>").alias("pa"))
    found, missing = joins.attach_signal(reads, signals)
    both = found.select("shift", F.lit(True).alias("there"), F.size("signal").alias("n")).unionByName(missing.select("shift", F.lit(False).alias("there"), F.lit(0).alias("n")))
    return both.groupBy((F.col("shift") > 400).alias("raw"), "there").agg(F.count("*").alias("reads"), F.sum("n").cast("long").alias("samples"))


_PRE = "pre AS (SELECT user_id AS readid, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS z FROM events WHERE event_type = 'view' GROUP BY user_id), post AS (SELECT user_id AS readid, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS z FROM events WHERE event_type = 'click' GROUP BY user_id)"


def _scores(v, kind):
    return v.table("events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("readid")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("z"))


@query("j10_pair_pre_post", f"WITH {_PRE} SELECT readid, pre.z AS pre_z, post.z AS post_z FROM pre JOIN post USING (readid)")
def _(v):
    return joins.pair_pre_post(_scores(v, "view"), _scores(v, "click"))


@query("g22_mean_delta_z", f"WITH {_PRE} SELECT CAST(readid % 24 AS BIGINT) AS batch, round(avg(post.z - pre.z), 6) AS zchange FROM pre JOIN post USING (readid) GROUP BY 1")
def _(v):
    pairs = joins.pair_pre_post(_scores(v, "view"), _scores(v, "click")).withColumn("batch", F.col("readid") % 24)
    return aggs.mean_delta_z(pairs, "batch").withColumn("zchange", F.round("zchange", 6))


@query("e4_evaluate_truth", _CURVE + """, n AS (SELECT count(*) AS total, count(DISTINCT readid) AS total_reads FROM truth), cov AS (SELECT p.tool, count(DISTINCT p.readid) AS segmented_reads FROM pred p SEMI JOIN truth t ON t.readid = p.readid GROUP BY p.tool)
SELECT tool, distance, found, total, round(found / CAST(total AS DOUBLE), 9) AS found_ratio, segmented_reads, total_reads, round(segmented_reads / CAST(total_reads AS DOUBLE), 9) AS segmented_ratio FROM curve JOIN cov USING (tool), n""")
def _(v):
    b = v.borders()
    out = evaluate.evaluate_truth(b.where("tool = 'view'"), b.where("tool <> 'view'"), 20)
    return out.withColumns({"found_ratio": F.round("found_ratio", 9), "segmented_ratio": F.round("segmented_ratio", 9)})


@query("window_edge_peaks", _EDGES + """, s AS (SELECT readid, pos, score, lag(score) OVER w AS l, lead(score) OVER w AS r FROM edges WINDOW w AS (PARTITION BY readid ORDER BY pos))
SELECT readid, pos, round(score, 6) AS score FROM s WHERE score > l AND score > r AND score >= 1.5""")
def _(v):
    return windows.find_peaks(_edges(v), 1.5, 2).withColumn("score", F.round("score", 6))


@query("f8_reject_training_outliers", V("event_kmers") + """, s AS (SELECT readid, kmer, count(*) AS w, sum(n % 7) AS wx FROM event_kmers GROUP BY readid, kmer), bad AS (SELECT DISTINCT readid FROM s WHERE kmer = 'AAAAA' AND wx < 2 * w)
SELECT s.readid, s.kmer, CAST(s.w AS DOUBLE) AS w, CAST(s.wx AS DOUBLE) AS wx FROM s ANTI JOIN bad ON s.readid = bad.readid""")
def _(v):
    stats = v.event_kmers().groupBy("readid", "kmer").agg(F.count("*").cast("double").alias("w"), F.sum(F.col("n") % 7).cast("double").alias("wx"))
    return filters.reject_training_outliers(stats, "AAAAA", 2.0)


@query("s5_moves_tsv", V("event_kmers") + "SELECT CAST(readid AS VARCHAR) AS readid, CAST(n AS INTEGER) AS position, kmer AS motif, CAST(n * 3 AS INTEGER) AS start, CAST(n * 3 + 3 AS INTEGER) AS \"end\" FROM event_kmers")
def _(v):
    path = scratch(v.spark, "moves")
    rows = v.event_kmers().select("readid", F.lit("s").alias("signalid"), F.col("n").alias("position"), F.substring("kmer", 3, 1).alias("base"), F.col("kmer").alias("motif"), (F.col("n") * 3).alias("start"), (F.col("n") * 3 + 3).alias("end"))
    sinks.write_table(rows, path, "\t")
    return readers.read_moves_tsv(v.spark, path).select("readid", "position", "motif", "start", "end")


@query("s14_vcf", "SELECT concat('c', p_partkey) AS chrom, CAST(p_size AS BIGINT) AS pos, contains(p_type, 'STEEL') AS structural FROM part")
def _(v):
    path = scratch(v.spark, "vcf")
    p = v.table("part")
    info = F.when(F.col("p_type").contains("STEEL"), "SVTYPE=DEL;END=9").otherwise("DP=10")
    p.select(F.concat_ws("\t", F.concat(F.lit("c"), "p_partkey"), "p_size", F.lit("."), F.lit("A"), F.lit("T"), F.lit("."), F.lit("PASS"), info)).write.text(path)
    return filters.is_structural(readers.read_vcf(v.spark, path)).select("chrom", "pos", "structural")
