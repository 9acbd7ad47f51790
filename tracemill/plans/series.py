"""Queries on series: filters, edges, windows over arrays and observations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, windows
from tracemill.plans.base import query
from tracemill.plans.views import with_views as V


def _hampel_sql(w: int, n: float) -> str:
    half = w // 2
    return f"""hw AS (SELECT readid, pos, x, list(x) OVER (PARTITION BY readid ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {w - 1 - half} FOLLOWING) AS wl, count(*) OVER (PARTITION BY readid) AS cnt FROM points),
hm AS (SELECT *, list_median(wl) AS med FROM hw),
hd AS (SELECT *, list_median([abs(v - med) FOR v IN wl]) AS mad FROM hm),
hampel AS (SELECT readid, pos, x, CASE WHEN cnt > {w} AND pos >= {half} AND pos < cnt - {half} - 1 AND abs(x - med) > CAST({n} AS DOUBLE) * CAST(1.4826 AS DOUBLE) * mad THEN med ELSE x END AS filtered FROM hd)""".replace("list_median(", "list_aggregate_median(")


def _h(w: int, n: float) -> str:
    import re

    text = _hampel_sql(w, n)
    return re.sub(r"list_aggregate_median\(((?:[^()\[\]]|\[[^\]]*\]|\([^()]*\))*)\)", r"list_aggregate(\1, 'median')", text)


for _w, _n in ((3, 3), (6, 5), (7, 5)):

    @query(f"w1_hampel_{_w}_{_n}", V("points") + ", " + _h(_w, _n) + " SELECT readid, pos, x, round(filtered, 6) AS filtered FROM hampel")
    def _(v, w=_w, n=_n):
        return windows.hampel(v.points().select("readid", "pos", "x"), w, n).select("readid", "pos", "x", F.round("filtered", 6).alias("filtered"))


def _edges_sql(value: str, source: str, w: int = 6) -> str:
    left, right = f"(PARTITION BY readid ORDER BY pos ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)", f"(PARTITION BY readid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    return f"""edges AS (SELECT readid, pos, CASE WHEN pos >= {w} AND pos < cnt - {w} THEN abs(ml - mr) / (sl + CAST(1e-8 AS DOUBLE) + sr) ELSE 0.0 END AS score FROM (
SELECT readid, pos, count(*) OVER (PARTITION BY readid) AS cnt, avg({value}) OVER {left} AS ml, avg({value}) OVER {right} AS mr, stddev_pop({value}) OVER {left} AS sl, stddev_pop({value}) OVER {right} AS sr FROM {source}))"""


_EDGES = V("points") + ", " + _h(6, 5) + ", " + _edges_sql("filtered", "hampel")


def _edges(v):
    return windows.window_edges(windows.hampel(v.points().select("readid", "pos", "x"), 6, 5), 6, "filtered")


@query("w2_window_edges", _EDGES + " SELECT readid, pos, round(score, 6) AS score FROM edges")
def _(v):
    return _edges(v).select("readid", "pos", F.round("score", 6).alias("score"))


@query("edge_count_per_read", _EDGES + " SELECT readid, count(*) AS samples, count(*) FILTER (WHERE score >= 1.5) AS edges FROM edges GROUP BY readid")
def _(v):
    """Hampel filter, window edges, count: the flagship query."""
    return _edges(v).groupBy("readid").agg(F.count("*").alias("samples"), F.count_if(F.col("score") >= 1.5).alias("edges"))


def _peaks_sql(source: str, height: float, distance: int, name: str = "peaks") -> str:
    """The greedy choice as a fold: highest first, of equal ones the earlier."""
    return f"""tops AS (SELECT readid, pos, score FROM (SELECT readid, pos, score, lag(score) OVER w AS l, lead(score) OVER w AS r FROM {source} WINDOW w AS (PARTITION BY readid ORDER BY pos)) WHERE score > l AND score > r AND score >= CAST({height} AS DOUBLE)),
kept AS (SELECT readid, unnest(list_reduce(list([pos] ORDER BY score DESC, pos), lambda a, x: CASE WHEN len(list_filter(a, lambda q: abs(q - x[1]) < {distance})) > 0 THEN a ELSE list_concat(a, x) END)) AS pos FROM tops GROUP BY readid),
{name} AS (SELECT readid, pos, score FROM kept JOIN tops USING (readid, pos))"""


def _cwt_sql(source: str, value: str, scale: int) -> str:
    """The wavelet's response and its spread."""
    reach = 4 * scale
    kernel = ", ".join(f"CAST({-j / scale**2 * math.exp(-(j**2) / (2 * scale**2)) / math.sqrt(scale)!r} AS DOUBLE)" for j in range(-reach, reach + 1))
    return f"""cwt AS (SELECT readid, pos, CASE WHEN len(w) = {2 * reach + 1} THEN abs(list_inner_product(w, [{kernel}])) ELSE 0.0 END AS score FROM (SELECT readid, pos, list({value}) OVER (PARTITION BY readid ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS w FROM {source})),
steady AS (SELECT readid, pos, score, stddev_pop(score) OVER (PARTITION BY readid ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS spread FROM cwt)"""


@query("w3_cwt_peaks", V("points") + ", " + _cwt_sql("points", "x", 2) + ", " + _peaks_sql("cwt", 40.0, 3) + " SELECT p.readid, p.pos, round(p.score, 6) AS score FROM peaks p JOIN steady s USING (readid, pos) WHERE spread < 20")
def _(v):
    """Wavelet response of each series and its peaks."""
    return windows.cwt_peaks(v.points().select("readid", "pos", "x"), 2, 40.0, 3).withColumn("score", F.round("score", 6))


@query("w3b_find_peaks_5", V("points") + ", s AS (SELECT readid, pos, x AS score FROM points), " + _peaks_sql("s", 50.0, 5) + " SELECT readid, pos, score FROM peaks")
def _(v):
    """Peaks of which the higher suppress those nearer than five samples."""
    return windows.find_peaks(v.points().select("readid", "pos", F.col("x").alias("score")), 50.0, 5)


_SPANS = "spans AS (SELECT readid, readid % 7 AS start, max(pos) + 1 - readid % 3 AS \"end\" FROM points GROUP BY readid HAVING readid % 5 <> 0)"


@query("e8_extract_edges", V("points") + ", " + _h(6, 5) + ", " + _SPANS + ", part AS (SELECT h.readid, pos, filtered FROM hampel h JOIN spans s ON h.readid = s.readid AND pos >= start AND pos < \"end\"), " + _cwt_sql("part", "filtered", 2) + ", " + _peaks_sql("cwt", 30.0, 6) + " SELECT p.readid, p.pos, round(p.score, 6) AS score FROM peaks p JOIN steady s USING (readid, pos) WHERE spread < 15")
def _(v):
    """Edges of the part of each signal that its read covers, at positions of the whole signal."""
    points = v.points().select("readid", "pos", "x")
    start, end = (F.col("readid") % 7).alias("start"), (F.max("pos") + 1 - F.col("readid") % 3).alias("end")
    spans = points.groupBy("readid").agg(end).withColumn("start", start).where(F.col("readid") % 5 != 0)
    return windows.extract_edges(points, spans, 30.0, 2, 6).withColumn("score", F.round("score", 6))


@query("w3b_find_peaks", V("points") + """, s AS (SELECT readid, pos, x, lag(x) OVER w AS l, lead(x) OVER w AS r FROM points WINDOW w AS (PARTITION BY readid ORDER BY pos)),
tops AS (SELECT readid, pos, x FROM s WHERE x > l AND x > r AND x >= 50)
SELECT readid, pos, x AS score FROM tops t""")
def _(v):
    # strict maxima are two apart, so a distance of two suppresses none: SQL can say this one
    return windows.find_peaks(v.points().select("readid", "pos", F.col("x").alias("score")), 50.0, 2)


@query("w7_rolling", V("param_obs") + """SELECT param, seq_no, round(avg(value) OVER w, 9) AS mean, round(list_aggregate(list(value) OVER w, 'median'), 6) AS median
FROM param_obs WINDOW w AS (PARTITION BY param ORDER BY seq_no ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def _(v):
    return windows.rolling(v.param_obs(), 100).select("param", "seq_no", F.round("mean", 9).alias("mean"), F.round("median", 6).alias("median"))


@query("w10_top_mass", V("probs") + """SELECT readid, day, candidate, p FROM (SELECT *, coalesce(sum(CAST(p AS DECIMAL(18,9))) OVER (PARTITION BY readid, day ORDER BY p DESC, candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM probs) WHERE mass < 0.977970000""")
def _(v):
    rows = v.probs().withColumn("exact", F.col("p").cast("decimal(18,9)"))
    return windows.top_mass(rows, ["readid", "day"], F.lit("0.97797").cast("decimal(18,9)"), "exact").select("readid", "day", "candidate", "p")


@query("p1_signal_window", V("signals") + "SELECT readid, list_slice(signal, CAST(3 + label AS BIGINT), CAST(2 + label + 40 AS BIGINT)) AS part FROM signals")
def _(v):
    return v.signals().select("readid", X.signal_window(F.col("signal"), F.lit(2), F.col("label"), F.col("label") + 40).alias("part"))


# DuckDB rounds the product with 10^6, so where the written value ends in a half the last bit of the product decides; as decimals the halves go away from zero.
@query("p2_znorm", V("signals") + "SELECT readid, [coalesce(CAST(TRY_CAST(CAST(z AS VARCHAR) AS DECIMAL(38,6)) AS DOUBLE), z) FOR z IN [(x - 0.01) / 0.5 FOR x IN signal]] AS z FROM signals")
def _(v):
    """Scaled signals, to six decimals of the value as it is written, halves away from zero."""
    return v.signals().select("readid", F.transform(X.znorm(F.col("signal"), F.lit(0.01), F.lit(0.5)), lambda x: F.round(x, 6)).alias("z"))


@query("p14_median_mad", V("signals") + """, m AS (SELECT readid, signal, list_aggregate(signal, 'median') AS med FROM signals)
SELECT readid, round(med, 9) AS median, round(list_aggregate([abs(x - med) FOR x IN signal], 'median'), 9) AS mad FROM m""")
def _(v):
    rows = v.signals().withColumn("m", X.array_median(F.col("signal")))
    return rows.select("readid", F.round("m", 9).alias("median"), F.round(X.array_median(F.transform("signal", lambda x: F.abs(x - F.col("m")))), 9).alias("mad"))


@query("p22_clip", V("points") + "SELECT readid, pos, greatest(least(x, 100.0), 10.0) AS x FROM points")
def _(v):
    return v.points().select("readid", "pos", X.clip(F.col("x"), 10.0, 100.0).alias("x"))


@query("p16_moves_to_segments", V("points") + """, m AS (SELECT readid, pos, row_number() OVER (PARTITION BY readid ORDER BY pos DESC) - 1 AS position, max(pos) OVER (PARTITION BY readid) + 1 AS ns FROM points WHERE x > 50),
l AS (SELECT readid, max(pos) + 1 AS ns FROM points GROUP BY readid)
SELECT m.readid, CAST(position AS INTEGER) AS position, CAST(pos AS INTEGER) AS start, CAST(coalesce(lag(pos) OVER (PARTITION BY m.readid ORDER BY position), l.ns) AS INTEGER) AS "end" FROM m JOIN l USING (readid)""")
def _(v):
    from tracemill.operators.evaluate import moves_to_segments

    flags = v.points().groupBy("readid").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") > 50).cast("tinyint").alias("f")))).alias("m"))
    moves = flags.select("readid", F.concat(F.array(F.lit(1).cast("tinyint")), F.transform("m", lambda s: s["f"])).alias("mv"), F.size("m").alias("ns"), F.lit(0).alias("ts"))
    return moves_to_segments(moves)


@query("g19_edge_base_ratio", _EDGES + ", n AS (SELECT count(*) AS bases FROM points) SELECT CAST(t AS DOUBLE) / 2 AS threshold, count(*) FILTER (WHERE score >= CAST(t AS DOUBLE) / 2) AS edges, round(count(*) FILTER (WHERE score >= CAST(t AS DOUBLE) / 2) / CAST(any_value(bases) AS DOUBLE), 9) AS ratio FROM edges, n, (SELECT unnest(range(1, 21)) AS t) GROUP BY t")
def _(v):
    bases = v.table("events").count()
    return aggs.edge_base_ratio(_edges(v), bases, [k / 2 for k in range(1, 21)]).select("threshold", "edges", F.round("ratio", 9).alias("ratio"))
