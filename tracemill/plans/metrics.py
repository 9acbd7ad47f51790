"""Queries on lengths and metric reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, evaluate, filters, windows
from tracemill.plans.base import query
from tracemill.plans.views import with_views as V

_N50 = "SELECT grp, max(len) AS n50 FROM (SELECT grp, len, sum(len) OVER (PARTITION BY grp ORDER BY len DESC) AS running, sum(len) OVER (PARTITION BY grp) AS total FROM {0}) WHERE 2 * running >= total GROUP BY grp"


@query("g4_n50", V("lengths") + _N50.format("lengths"))
def _(v):
    return aggs.n50(v.lengths())


@query("g5_length_stats", V("lengths") + f""", n AS ({_N50.format('lengths')}), s AS (SELECT grp, avg(len) AS mean, median(len) AS median, CAST(max(len) AS DOUBLE) AS max, CAST(min(len) AS DOUBLE) AS min, CAST(any_value(n50) AS DOUBLE) AS n50 FROM lengths JOIN n USING (grp) GROUP BY grp)
SELECT grp, metric, round(value, 6) AS value FROM (UNPIVOT s ON n50, mean, median, max, min INTO NAME metric VALUE value)""")
def _(v):
    return aggs.length_stats(v.lengths()).withColumn("value", F.round("value", 6))


@query("g17_assembly_stats", V("contigs") + f", n AS ({_N50.format('contigs')}) SELECT grp, CAST(sum(len) AS BIGINT) AS total_length, round(avg(coverage), 6) AS mean_coverage, any_value(n50) AS n50 FROM contigs JOIN n USING (grp) GROUP BY grp")
def _(v):
    return aggs.assembly_stats(v.contigs()).withColumn("mean_coverage", F.round("mean_coverage", 6))


@query("w5_running_sum", V("contigs") + ", t AS (SELECT grp, len, count(*) AS n FROM contigs GROUP BY grp, len) SELECT grp, len, n, CAST(sum(n) OVER (PARTITION BY grp ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM t")
def _(v):
    rows = v.contigs().groupBy("grp", "len").agg(F.count("*").alias("n"))
    return windows.running_sum(rows, ["grp"], [F.desc("len")], "n")


_SCORED = V("metrics") + """, num AS (SELECT *, TRY_CAST(value AS DOUBLE) AS number FROM metrics), mx AS (SELECT *, max(number) OVER (PARTITION BY metric) AS m FROM num),
sc AS (SELECT tool, metric, value, CASE WHEN number IS NULL OR m <= 0 THEN 0.0 ELSE number / m END AS s FROM mx),
scored AS (SELECT tool, metric, value, CASE WHEN metric IN ('Homogeneity', 'missing', 'truncated', 'nt_changed', 'min_length') THEN 1 - s ELSE s END AS metric_score FROM sc)"""


@query("g12_normalized_metric_score", _SCORED + " SELECT tool, metric, value, round(metric_score, 9) AS metric_score FROM scored")
def _(v):
    return aggs.normalized_metric_score(v.metrics()).withColumn("metric_score", F.round("metric_score", 9))


_NAMES = ["total_quantity", "total_price", "present", "missing", "truncated"]


@query("g13_aggregated_metric_score", _SCORED + f" SELECT tool, round(sum(metric_score), 6) AS total_score FROM scored WHERE metric IN {tuple(_NAMES)} GROUP BY tool")
def _(v):
    return aggs.aggregated_metric_score(aggs.normalized_metric_score(v.metrics()), _NAMES).withColumn("total_score", F.round("total_score", 6))


@query("w8_partition_max", V("metrics") + "SELECT tool, metric, TRY_CAST(value AS DOUBLE) AS number, max(TRY_CAST(value AS DOUBLE)) OVER (PARTITION BY metric) AS metric_max FROM metrics")
def _(v):
    return windows.partition_max(v.metrics().select("tool", "metric", X.to_numeric(F.col("value")).alias("number")))


@query("w9_best_per_group", _SCORED + " SELECT tool, metric, rank() OVER (PARTITION BY metric ORDER BY round(metric_score, 9) DESC) = 1 AS best FROM scored")
def _(v):
    scored = aggs.normalized_metric_score(v.metrics()).withColumn("metric_score", F.round("metric_score", 9))
    return windows.best_per_group(scored).select("tool", "metric", "best")


@query("e6_metric_report", _SCORED + f""", t AS (SELECT tool, sum(metric_score) AS total_score FROM scored WHERE metric IN {tuple(_NAMES)} GROUP BY tool)
SELECT tool, metric, value, round(metric_score, 6) AS metric_score, rank() OVER (PARTITION BY metric ORDER BY metric_score DESC) = 1 AS best, round(total_score, 6) AS total_score FROM scored JOIN t USING (tool)""")
def _(v):
    return evaluate.metric_report(v.metrics(), _NAMES).select("tool", "metric", "value", F.round("metric_score", 6).alias("metric_score"), "best", F.round("total_score", 6).alias("total_score"))


@query("f7_keep_metrics", V("metrics") + "SELECT tool, metric, value FROM metrics WHERE metric IN ('present', 'missing') AND tool NOT IN ('AF')")
def _(v):
    return filters.keep_metrics(v.metrics(), ["present", "missing"], ["AF"])


@query("p19_rename_labels", V("metrics") + "SELECT tool, metric, CASE metric WHEN 'n_lines' THEN 'Lines' ELSE lower(replace(metric, '_', ' ')) END AS label FROM metrics")
def _(v):
    return v.metrics().select("tool", "metric", X.rename_labels(F.col("metric"), {"n_lines": "Lines"}).alias("label"))


@query("p20_to_numeric", V("metrics") + "SELECT tool, metric, TRY_CAST(value AS DOUBLE) AS number FROM metrics")
def _(v):
    return v.metrics().select("tool", "metric", X.to_numeric(F.col("value")).alias("number"))


@query("p21_combined_cell", _SCORED + " SELECT tool, metric, concat(printf('%.2f', metric_score), '_{', CASE WHEN regexp_full_match(value, '\\d+\\.\\d+') THEN printf('%.1f', CAST(value AS DOUBLE)) ELSE value END, '}') AS cell FROM scored")
def _(v):
    scored = aggs.normalized_metric_score(v.metrics())
    return scored.select("tool", "metric", X.combined_cell(F.col("metric_score"), F.col("value")).alias("cell"))


@query("g16_metric_rows_union", V("metrics") + "SELECT tool, metric, value FROM metrics UNION ALL SELECT 'base', 'missing', '0' UNION ALL SELECT 'base', 'truncated', '0'")
def _(v):
    return aggs.metric_rows_union(v.metrics(), [("base", "missing", "0"), ("base", "truncated", "0")])


@query("g14_pivot_mean", V("tool_dataset") + 'SELECT tool, ' + ", ".join(f'round(avg(value) FILTER (WHERE dataset = {d}), 6) AS "{d}"' for d in range(5)) + ' FROM tool_dataset GROUP BY tool')
def _(v):
    return aggs.pivot_mean(v.tool_dataset(), list(range(5))).select("tool", *[F.round(F.col(str(d)), 6).alias(str(d)) for d in range(5)])


@query("o3_order_by_mean", V("tool_dataset") + ", m AS (SELECT tool, dataset, avg(value) AS a FROM tool_dataset GROUP BY tool, dataset) SELECT tool, round(avg(a), 4) AS row_mean, CAST(row_number() OVER (ORDER BY tool <> 3, round(avg(a), 4) DESC, tool) AS INTEGER) AS place FROM m GROUP BY tool")
def _(v):
    # tools are few; the ranking is over one row for each
    rows = aggs.pivot_mean(v.tool_dataset(), list(range(5))).select("tool", F.round("row_mean", 4).alias("row_mean"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("tool") != 3, F.desc("row_mean"), "tool")))


@query("g15_margins", V("tool_dataset") + "SELECT tool, dataset, round(avg(value), 4) AS mean, count(*) AS n FROM tool_dataset GROUP BY CUBE (tool, dataset)")
def _(v):
    return aggs.margins(v.tool_dataset()).withColumn("mean", F.round("mean", 4))


@query("o1_sort_metrics", V("metrics") + "SELECT metric, tool, value FROM metrics ORDER BY metric, tool")
def _(v):
    return v.metrics().select("metric", "tool", "value").orderBy("metric", "tool")


@query("o2_custom_order", V("metrics") + "SELECT tool, metric, CAST(CASE metric WHEN 'present' THEN 1 WHEN 'missing' THEN 2 END AS INTEGER) AS place FROM metrics")
def _(v):
    order = F.array(F.lit("present"), F.lit("missing"))
    return v.metrics().select("tool", "metric", F.nullif(F.array_position(order, F.col("metric")).cast("int"), F.lit(0)).alias("place")).orderBy(F.col("place").asc_nulls_last())


@query("o4_argmax_last_tie", "SELECT l_returnflag AS grp, max(l_orderkey * 10 + l_linenumber) FILTER (WHERE l_quantity = m) AS last_key FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY l_returnflag")
def _(v):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return v.table("lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.max_by(key, F.struct(F.col("l_quantity"), key)).alias("last_key"))


@query("f6_is_structural", "SELECT doc_id, contains(coalesce(text, ''), 'stion') AS structural FROM documents")
def _(v):
    return filters.is_structural(v.table("documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("stion"), F.lit("SVTYPE")).alias("info"))).select("doc_id", "structural")


@query("g18_count_sv", "SELECT count(*) FILTER (WHERE contains(coalesce(text, ''), 'stion')) AS n_sv FROM documents")
def _(v):
    return aggs.count_sv(v.table("documents").select(F.replace(F.coalesce("text", F.lit("")), F.lit("stion"), F.lit("SVTYPE")).alias("info")))


@query("u4_right_wins_merge", "SELECT l_suppkey AS suppkey, CAST(max(l_orderkey * 10 + l_linenumber) AS BIGINT) AS newest FROM lineitem GROUP BY l_suppkey")
def _(v):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return v.table("lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.max_by(key, key).alias("newest"))
