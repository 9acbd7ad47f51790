"""Queries on segment borders of several tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import aggs, evaluate, filters, joins, windows
from tracemill.plans.base import query
from tracemill.plans.views import with_views as V

TOOLS = ["click", "error", "purchase", "signup", "view"]
_B = V("borders")
_COMMON = _B + ", common AS (SELECT readid FROM borders GROUP BY readid HAVING count(DISTINCT tool) = (SELECT count(DISTINCT tool) FROM borders)), cb AS (SELECT b.* FROM borders b SEMI JOIN common c ON b.readid = c.readid)"
_BIT = "CAST(1 AS BIGINT) << (CAST(list_position(['" + "', '".join(TOOLS) + "'], {0}) AS INTEGER) - 1)"


@query("g1_border_set", V("tool_segments") + 'SELECT DISTINCT tool, readid, border FROM (SELECT tool, readid, start AS border FROM tool_segments UNION ALL SELECT tool, readid, "end" FROM tool_segments)')
def _(v):
    return aggs.border_set(v.tool_segments())


@query("u1_union_tools", _B + "SELECT tool, count(*) AS n, CAST(min(border) AS BIGINT) AS first, CAST(max(border) AS BIGINT) AS last FROM borders GROUP BY tool")
def _(v):
    b = v.borders()
    parts = [b.where(F.col("tool") == t) for t in TOOLS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("tool").agg(F.count("*").alias("n"), F.min("border").alias("first"), F.max("border").alias("last"))


@query("u5_distinct_union", V("tool_segments") + 'SELECT readid, start AS border FROM tool_segments UNION SELECT readid, "end" FROM tool_segments')
def _(v):
    s = v.tool_segments()
    return s.select("readid", F.col("start").alias("border")).union(s.select("readid", "end")).distinct()


@query("j6_common_reads", _COMMON + "SELECT tool, count(*) AS borders, count(DISTINCT readid) AS reads FROM cb GROUP BY tool")
def _(v):
    return joins.common_reads(v.borders()).groupBy("tool").agg(F.count("*").alias("borders"), F.count_distinct("readid").alias("reads"))


for _w in (0, 2):

    @query(f"g2_subset_overlap_{_w}", _COMMON + f""", bits AS (SELECT readid, border, {_BIT.format('tool')} AS bit FROM cb), own AS (SELECT readid, border, bit_or(bit) AS own FROM bits GROUP BY readid, border),
near AS (SELECT o.readid, o.border, any_value(o.own) AS own, bit_or(b.bit) AS near FROM own o JOIN bits b ON b.readid = o.readid AND b.border BETWEEN o.border - {_w} AND o.border + {_w} GROUP BY o.readid, o.border)
SELECT mask, count(*) AS n FROM near, (SELECT CAST(unnest(range(1, 32)) AS BIGINT) AS mask) WHERE near & mask = mask AND own & mask <> 0 GROUP BY mask""")
    def _(v, w=_w):
        return evaluate.compare_tools(v.borders(), TOOLS, w)


@query("g3_segmented_ratio", _B + "SELECT tool, count(DISTINCT readid) AS reads, round(count(DISTINCT readid) / CAST((SELECT count(DISTINCT readid) FROM borders WHERE tool = 'view') AS DOUBLE), 9) AS ratio FROM borders GROUP BY tool")
def _(v):
    return aggs.segmented_ratio(v.borders(), "view").select("tool", "reads", F.round("ratio", 9).alias("ratio"))


@query("j7_borders_within", _B + "SELECT a.readid, a.border, b.tool AS near_tool, b.border AS near_border FROM (SELECT DISTINCT readid, border FROM borders WHERE tool = 'view') a JOIN borders b ON a.readid = b.readid AND b.border BETWEEN a.border - 3 AND a.border + 3 AND b.tool <> 'view'")
def _(v):
    b = v.borders()
    return joins.borders_within(b.where("tool = 'view'").select("readid", "border"), b.where("tool <> 'view'"), 3)


_NEAREST = _B + """, truth AS (SELECT DISTINCT readid, border FROM borders WHERE tool = 'view'), pred AS (SELECT * FROM borders WHERE tool <> 'view'),
tp AS (SELECT t.readid, t.border, p.tool FROM truth t JOIN (SELECT DISTINCT tool, readid FROM pred) p ON p.readid = t.readid),
nb AS (SELECT *, lag(border) OVER w AS prv, lead(border) OVER w AS nxt FROM tp WINDOW w AS (PARTITION BY tool, readid ORDER BY border)),
cand AS (SELECT n.tool, n.readid, n.border, any_value(n.prv) AS prv, any_value(n.nxt) AS nxt, list(p.border ORDER BY abs(n.border - p.border), p.border) AS c FROM nb n JOIN pred p ON p.tool = n.tool AND p.readid = n.readid AND abs(n.border - p.border) <= 20 GROUP BY n.tool, n.readid, n.border),
s1 AS (SELECT *, CASE WHEN prv IS NOT NULL AND abs(prv - c[1]) <= 20 AND abs(prv - c[1]) <= abs(border - c[1]) THEN 2 ELSE 1 END AS k FROM cand),
s2 AS (SELECT *, CASE WHEN c[k] IS NOT NULL AND nxt IS NOT NULL AND abs(nxt - c[k]) <= 20 AND abs(nxt - c[k]) < abs(border - c[k]) THEN k + 1 ELSE k END AS f FROM s1),
nearest AS (SELECT tool, readid, border, c[f] AS near_border, border - c[f] AS "offset" FROM s2 WHERE c[f] IS NOT NULL)"""


def _nearest(v):
    b = v.borders()
    return joins.nearest_within(b.where("tool = 'view'"), b.where("tool <> 'view'"), 20)


@query("j8_nearest_within", _NEAREST + ' SELECT tool, readid, border, near_border, "offset" FROM nearest')
def _(v):
    return _nearest(v)


_CURVE = _NEAREST + """, off AS (SELECT tool, -"offset" AS s FROM nearest), curve AS (SELECT tool, CAST(d AS INTEGER) AS distance, count(*) AS found FROM off, (SELECT unnest(range(-20, 21)) AS d) WHERE s = 0 OR (s > 0 AND d >= s) OR (s < 0 AND d <= s) GROUP BY tool, d)"""


@query("g9_found_edges_curve", _CURVE + " SELECT tool, distance, found FROM curve")
def _(v):
    return aggs.found_edges_curve(_nearest(v), 20)


@query("g10_absolute_curve", _CURVE + """, z AS (SELECT tool, max(found) FILTER (WHERE distance = 0) AS z FROM curve GROUP BY tool), n AS (SELECT count(*) AS total FROM truth)
SELECT tool, abs(distance) AS distance, CAST(sum(found) - CASE WHEN abs(distance) <> 0 THEN any_value(coalesce(z, 0)) ELSE 0 END AS BIGINT) AS found,
round((sum(found) - CASE WHEN abs(distance) <> 0 THEN any_value(coalesce(z, 0)) ELSE 0 END) / CAST(any_value(total) AS DOUBLE), 9) AS ratio FROM curve JOIN z USING (tool), n GROUP BY tool, abs(distance)""")
def _(v):
    b = v.borders()
    truth = b.where("tool = 'view'").select("readid", "border").distinct()
    curve = aggs.absolute_curve(aggs.found_edges_curve(_nearest(v), 20), joins.truth_coverage(truth, b.where("tool <> 'view'")), truth.count())
    return curve.select("tool", "distance", "found", F.round("ratio", 9).alias("ratio"))


@query("j11_truth_coverage", _B + ", t AS (SELECT DISTINCT readid FROM borders WHERE tool = 'view'), n AS (SELECT count(*) AS total FROM t) SELECT tool, count(DISTINCT b.readid) AS segmented_reads, any_value(total) AS total_reads, round(count(DISTINCT b.readid) / CAST(any_value(total) AS DOUBLE), 9) AS segmented_ratio FROM borders b SEMI JOIN t ON b.readid = t.readid, n WHERE tool <> 'view' GROUP BY tool")
def _(v):
    b = v.borders()
    return joins.truth_coverage(b.where("tool = 'view'"), b.where("tool <> 'view'")).withColumn("segmented_ratio", F.round("segmented_ratio", 9))


@query("w4_diff", _B + "SELECT * FROM (SELECT tool, readid, border, border - lag(border) OVER (PARTITION BY tool, readid ORDER BY border) AS size FROM borders) WHERE size IS NOT NULL")
def _(v):
    return windows.diff(v.borders())


@query("g11_segment_size_histogram", _B + "SELECT tool, CAST(least(floor(greatest(least(size, 200), 0) / 10), 20) AS INTEGER) AS bin, count(*) AS n FROM (SELECT tool, border - lag(border) OVER (PARTITION BY tool, readid ORDER BY border) AS size FROM borders) WHERE size IS NOT NULL GROUP BY 1, 2")
def _(v):
    return aggs.segment_size_histogram(windows.diff(v.borders()))


@query("w6_segment_end", V("triples") + ', s AS (SELECT readid, CAST(n * 3 AS BIGINT) AS start, max(n * 3 + 3) OVER (PARTITION BY readid) AS last FROM triples) SELECT readid, start, CAST(coalesce(lead(start) OVER (PARTITION BY readid ORDER BY start), last) AS BIGINT) AS "end" FROM s')
def _(v):
    from pyspark.sql import Window

    starts = v.points().where("pos % 3 = 0").select("readid", F.col("pos").alias("start")).withColumn("last", F.max(F.col("start") + 3).over(Window.partitionBy("readid")))
    return windows.segment_end(starts).select("readid", "start", "end")


@query("f5_dedupe_segments", V("tool_segments") + 'SELECT DISTINCT readid, start, "end" FROM tool_segments')
def _(v):
    return filters.dedupe_segments(v.tool_segments().select("readid", "start", "end"))


@query("f4_drop_sentinel", "SELECT event_id, CAST(value AS INTEGER) AS start FROM events WHERE event_type <> 'error' AND event_id IS NOT NULL".replace("CAST(value AS INTEGER)", "CAST(floor(value) AS INTEGER)"))
def _(v):
    raw = v.table("events").select("event_id", F.when(F.col("event_type") == "error", ".").otherwise(F.floor("value").cast("string")).alias("start"))
    return filters.drop_sentinel(raw, "start")


_REGIONS = V("points") + ", r AS (SELECT readid, CAST(count(*) // 4 AS INTEGER) AS n_bases, CAST(min(pos) AS BIGINT) AS s, CAST(max(pos) + 1 AS BIGINT) AS e FROM points GROUP BY readid)"


def _regions(v):
    per = v.points().groupBy("readid").agg(F.floor(F.count("*") / 4).cast("int").alias("n_bases"), F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    return per.select("readid", "n_bases", F.array(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("regions"))


@query("e1_random_controls", _REGIONS + ", p AS (SELECT readid, n_bases, unnest(range(s, e)) AS border FROM r) SELECT readid, border FROM (SELECT *, row_number() OVER (PARTITION BY readid ORDER BY md5(concat_ws('|', readid, border, 42)), border) AS k FROM p) WHERE k <= n_bases")
def _(v):
    return evaluate.random_controls(_regions(v))


@query("p23_uniform_controls", _REGIONS + ", p AS (SELECT readid, n_bases, s, e, unnest(range(0, n_bases)) AS i FROM r) SELECT readid, CAST(floor(s + i * CASE WHEN n_bases > 1 THEN CAST(e - 1 - s AS DOUBLE) / (n_bases - 1) ELSE 0 END) AS BIGINT) AS border FROM p")
def _(v):
    return evaluate.uniform_controls(_regions(v))


@query("g27_regions_per_read", V("tool_segments") + 'SELECT readid AS signalid, CAST(sum("end" - start) AS BIGINT) AS n_bases, len(list(start)) AS n_regions FROM tool_segments GROUP BY readid')
def _(v):
    regions = v.tool_segments().select(F.col("readid").alias("signalid"), (F.col("end") - F.col("start")).alias("n_bases"), "start", "end")
    return aggs.regions_per_read(regions).select("signalid", "n_bases", F.size("regions").cast("long").alias("n_regions"))


_SIG = V("signals") + """, seg AS (SELECT readid, 'even' AS tool, CAST(i * 16 AS BIGINT) AS start, CAST(i * 16 + 16 AS BIGINT) AS "end" FROM signals, (SELECT unnest(range(0, 4)) AS i)),
win AS (SELECT tool, s.readid, start, signal[greatest(0, start - 6) + 1:start] AS b, signal[start + 1:start + 6] AS a, signal[start + 1:"end"] AS n FROM seg s JOIN signals USING (readid) WHERE start > 0),
med AS (SELECT *, list_aggregate(b, 'median') AS mb, list_aggregate(a, 'median') AS ma, n[2:15] AS t FROM win), tm AS (SELECT *, list_aggregate(t, 'median') AS mt FROM med),
sc AS (SELECT tool, readid, start, abs(ma - mb) AS delta_median, abs(list_aggregate([abs(x - ma) FOR x IN a], 'median') - list_aggregate([abs(x - mb) FOR x IN b], 'median')) AS delta_mad, list_aggregate([abs(x - mt) FOR x IN t], 'median') AS homogeneity FROM tm)"""


def _even_segments(v):
    return v.signals().select("readid", F.lit("even").alias("tool"), F.explode(F.array(*[F.lit(16 * i).cast("long") for i in range(4)])).alias("start")).withColumn("end", F.col("start") + 16)


@query("g8_border_scores", _SIG + " SELECT tool, readid, start, round(delta_median, 6) AS delta_median, round(delta_mad, 6) AS delta_mad, round(homogeneity, 6) AS homogeneity FROM sc")
def _(v):
    return evaluate.scored_borders(_even_segments(v), v.signals(), 6).select("tool", "readid", "start", *[F.round(n, 6).alias(n) for n in ("delta_median", "delta_mad", "homogeneity")])


@query("g7_median_scores", _SIG + " SELECT tool, round(median(delta_median), 6) AS delta_median, round(median(delta_mad), 6) AS delta_mad, round(median(homogeneity), 6) AS homogeneity FROM sc GROUP BY tool")
def _(v):
    names = ["delta_median", "delta_mad", "homogeneity"]
    return aggs.median_scores(evaluate.score_tools(_even_segments(v), v.signals(), 6), names).select("tool", *[F.round(n, 6).alias(n) for n in names])
