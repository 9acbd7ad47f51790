"""Queries on the lattice's scores, with its recurrences as recursive SQL: a row for each border between samples, a list over the k-mers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, segment, train
from tracemill.plans.base import query
from tracemill.plans.segmentation import _prepared
from tracemill.plans.series import _h
from tracemill.plans.views import with_views as V

_D = lambda x: f"CAST({x!r} AS DOUBLE)"
_NONE = "CAST('-Infinity' AS DOUBLE)"
_M1, _E1, _E2 = (_D(segment.PARAMS[n]) for n in ("m1", "e1", "e2"))


def _add(a: str, b: str) -> str:
    """Log of the sum of two exponentials."""
    return f"(CASE WHEN {a} = {_NONE} THEN {b} WHEN {b} = {_NONE} THEN {a} ELSE greatest({a}, {b}) + ln(1 + exp(-abs({a} - {b}))) END)"


_READS = V("points", "event_reads", "event_kmers", "model").replace("WITH ", "WITH RECURSIVE ", 1) + ", z AS (SELECT readid, pos, (x - 50.0) / 50.0 AS x FROM points), " + _h(3, 3).replace("FROM points", "FROM z") + f""",
xs AS (SELECT readid, list(filtered ORDER BY pos) AS x FROM hampel GROUP BY readid), lv AS (SELECT readid, list(level_mean ORDER BY n) AS mu, list(level_stdv ORDER BY n) AS sd FROM event_kmers JOIN model USING (kmer) GROUP BY readid),
rd AS MATERIALIZED (SELECT r.readid, r.seq, xs.x, mu, sd, len(xs.x) + 1 AS nt, len(mu) + 1 AS nn, greatest(1, least({segment.BAND // 2}, (len(mu) + 1) // 2)) AS half FROM event_reads r JOIN xs USING (readid) JOIN lv USING (readid) WHERE length(r.seq) >= 5 AND len(r.x) >= 2 * (length(r.seq) - 4)),
sc AS MATERIALIZED (SELECT readid, t, x[t] AS x, nn, nt, half, list_transform(range(0, nn), lambda n: CASE WHEN n = 0 OR abs(n - t * nn // nt) > half THEN {_NONE} ELSE -0.5 * pow((x[t] - mu[n]) / sd[n], 2) - ln(sd[n]) - {_D(X.LOG_2PI / 2)} END) AS s
  FROM (SELECT *, unnest(range(1, nt)) AS t FROM rd)),
fw AS (SELECT readid, CAST(0 AS BIGINT) AS t, list_transform(range(0, nn), lambda n: {_NONE}) AS m, list_transform(range(0, nn), lambda n: CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE {_NONE} END) AS e FROM rd UNION ALL
  SELECT f.readid, f.t + 1, list_transform(range(1, nn + 1), lambda i: CASE WHEN i = 1 THEN {_NONE} ELSE f.e[i - 1] + s[i] + {_M1} END), list_transform(range(1, nn + 1), lambda i: {_add(f"(f.m[i] + s[i] + {_E1})", f"(f.e[i] + s[i] + {_E2})")})
  FROM fw f JOIN sc ON sc.readid = f.readid AND sc.t = f.t + 1),
bw AS (SELECT readid, CAST(nt - 1 AS BIGINT) AS t, list_transform(range(0, nn), lambda n: {_NONE}) AS m, list_transform(range(0, nn), lambda n: CASE WHEN n = nn - 1 THEN CAST(0 AS DOUBLE) ELSE {_NONE} END) AS e FROM rd UNION ALL
  SELECT b.readid, b.t - 1, list_transform(range(1, nn + 1), lambda i: CASE WHEN abs(i - 1 - (b.t - 1) * nn // nt) <= half THEN b.e[i] + s[i] + {_E1} ELSE {_NONE} END),
    list_transform(range(1, nn + 1), lambda i: CASE WHEN abs(i - 1 - (b.t - 1) * nn // nt) <= half THEN {_add(f"(b.e[i] + s[i] + {_E2})", f"(CASE WHEN i < nn THEN b.m[i + 1] + s[i + 1] + {_M1} ELSE {_NONE} END)")} ELSE {_NONE} END)
  FROM bw b JOIN sc ON sc.readid = b.readid AND sc.t = b.t),
ends AS MATERIALIZED (SELECT rd.readid, f.e[nn] AS zf, b.e[1] AS zb FROM rd JOIN fw f ON f.readid = rd.readid AND f.t = nt - 1 JOIN bw b ON b.readid = rd.readid AND b.t = 0),
po AS MATERIALIZED (SELECT readid, t, unnest(range(0, len(m))) AS n, unnest(m) AS m, unnest(e) AS e FROM (SELECT f.readid, f.t, list_transform(range(1, len(f.m) + 1), lambda i: f.m[i] + b.m[i] - zf) AS m, list_transform(range(1, len(f.e) + 1), lambda i: f.e[i] + b.e[i] - zf) AS e
  FROM fw f JOIN bw b ON b.readid = f.readid AND b.t = f.t JOIN ends ON ends.readid = f.readid))"""

_COUNTS = _READS + f""", g AS (SELECT p.readid, p.n, {_add("p.m", "p.e")} AS g, sc.x FROM po p JOIN sc ON sc.readid = p.readid AND sc.t = p.t WHERE p.n > 0),
w AS (SELECT g.readid, g.n, substring(seq, CAST(g.n AS INTEGER), 5) AS kmer, sum(exp(g)) AS w, sum(exp(g) * g.x) AS wx, sum(exp(g) * (g.x * g.x)) AS wxx FROM g JOIN rd ON rd.readid = g.readid GROUP BY g.readid, g.n, seq),
enter AS (SELECT readid, ln(sum(exp(m))) AS m1 FROM po GROUP BY readid),
stay AS (SELECT readid, ln(sum(list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(fe[i] + s[i] + {_E2} + be[i] - zf))))) AS e2 FROM (
  SELECT sc.readid, sc.s, f.e AS fe, b.e AS be, zf FROM sc JOIN fw f ON f.readid = sc.readid AND f.t = sc.t - 1 JOIN bw b ON b.readid = sc.readid AND b.t = sc.t JOIN ends ON ends.readid = sc.readid) GROUP BY readid),
tails AS (SELECT readid, sum(wx) / sum(w) AS tail FROM w WHERE kmer = 'AAAAA' GROUP BY readid HAVING sum(w) > 0),
counts AS MATERIALIZED (SELECT w.readid, w.n, kmer, w.w, wx, wxx, m1, e2, tail, zf FROM w JOIN enter USING (readid) JOIN stay USING (readid) JOIN ends USING (readid) LEFT JOIN tails USING (readid))"""

_WALK = f""", best AS (SELECT readid, CAST(0 AS BIGINT) AS t, list_transform(range(0, nn), lambda n: {_NONE}) AS m, list_transform(range(0, nn), lambda n: CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE {_NONE} END) AS e, list_transform(range(0, nn), lambda n: false) AS from_m FROM rd UNION ALL
  SELECT v.readid, v.t + 1, list_transform(range(1, len(pm) + 1), lambda i: CASE WHEN i = 1 THEN {_NONE} ELSE v.e[i - 1] + pm[i] END), list_transform(range(1, len(pm) + 1), lambda i: greatest(v.m[i], v.e[i]) + pe[i]), list_transform(range(1, len(pm) + 1), lambda i: v.m[i] >= v.e[i])
  FROM best v JOIN rows_ ON rows_.readid = v.readid AND rows_.t = v.t + 1),
back AS (SELECT readid, CAST(nt - 1 AS BIGINT) AS t, CAST(nn - 1 AS BIGINT) AS n, false AS in_m FROM rd UNION ALL
  SELECT k.readid, k.t - 1, CASE WHEN k.in_m THEN k.n - 1 ELSE k.n END, NOT k.in_m AND v.from_m[k.n + 1] FROM back k JOIN best v ON v.readid = k.readid AND v.t = k.t WHERE k.t > 1)"""


@query("a6_log_likelihood", _READS + """ SELECT r.readid, round(zf, 6) AS zf, round(zb, 6) AS zb, CAST(nt * nn AS BIGINT) AS cells, CASE WHEN length(r.seq) < 5 THEN 'sequence shorter than k-mer' WHEN len(r.x) < 2 * (length(r.seq) - 4) THEN 'signal too short' END AS error
FROM event_reads r LEFT JOIN ends ON ends.readid = r.readid LEFT JOIN rd ON rd.readid = r.readid""")
def _(v):
    """Forward and backward scores of every series."""
    return segment.log_likelihood(_prepared(v)).select("readid", F.round("zf", 6).alias("zf"), F.round("zb", 6).alias("zb"), "cells", "error")


@query("a7_expected_counts", _COUNTS + " SELECT readid, kmer, round(sum(w), 6) AS w, round(sum(wx), 6) AS wx, round(sum(wxx), 6) AS wxx, round(any_value(m1), 6) AS m1, round(any_value(e2), 6) AS e2, round(any_value(tail), 6) AS tail, round(any_value(zf), 6) AS zf FROM counts GROUP BY readid, kmer")
def _(v):
    """Expected weight and moments of each series' k-mers, and its expected transitions."""
    of = lambda f, *names: [F.round(f(c), 6).alias(c) for c in names]
    return segment.expected_counts(_prepared(v)).groupBy("readid", "kmer").agg(*of(F.sum, "w", "wx", "wxx"), *of(F.first, "m1", "e2", "tail", "zf"))


@query("a17_posterior_rows", _READS + f""" SELECT p.readid, CAST(t - 1 AS INTEGER) AS t, CAST(n - 1 AS INTEGER) AS n, substring(seq, CAST(n - 1 + 3 AS INTEGER), 1) AS base, round(exp(g), 6) AS p
FROM (SELECT readid, t, n, {_add("m", "e")} AS g FROM po WHERE t > 0) p JOIN rd ON rd.readid = p.readid WHERE exp(g) >= CAST(0.01 AS DOUBLE)""")
def _(v):
    return segment.posterior_rows(_prepared(v)).withColumn("p", F.round("p", 6))


@query("g25_base_posterior", _READS + f""", r AS (SELECT p.readid, CAST(t - 1 AS INTEGER) AS sample, substring(seq, CAST(n + 2 AS INTEGER), 1) AS base, exp(g) AS p
FROM (SELECT readid, t, n, {_add("m", "e")} AS g FROM po WHERE t > 0) p JOIN rd ON rd.readid = p.readid WHERE exp(g) >= CAST(0.01 AS DOUBLE))
SELECT readid, sample, {", ".join(f"round(coalesce(sum(p) FILTER (WHERE base = '{b}'), 0), 6) AS {chr(34)}{b}{chr(34)}" for b in "ACGT")} FROM r GROUP BY readid, sample""")
def _(v):
    return aggs.base_posterior(segment.posterior_rows(_prepared(v))).select("readid", "sample", *[F.round(b, 6).alias(b) for b in "ACGT"])


@query("g21_transition_update", _COUNTS + """, s AS (SELECT sum(exp(m1)) AS m, sum(exp(e2)) AS e FROM (SELECT DISTINCT readid, m1, e2 FROM counts)) SELECT 'm1' AS param, round(m / (m + e), 6) AS value FROM s UNION ALL SELECT 'e2', round(e / (m + e), 6) FROM s""")
def _(v):
    counts = segment.expected_counts(_prepared(v)).groupBy("readid").agg(F.first("m1").alias("m1"), F.first("e2").alias("e2"))
    return aggs.transition_update(counts).select("param", F.round("value", 6).alias("value"))


@query("a9_train_pooled", _COUNTS + """, s AS (SELECT kmer, sum(w) AS w, sum(wx) AS wx, sum(wxx) AS wxx FROM counts WHERE tail IS NULL OR tail >= 0.5 GROUP BY kmer)
SELECT kmer, round(CASE WHEN w > 0 THEN wx / w ELSE level_mean END, 5) AS level_mean, round(CASE WHEN w > 0 THEN sqrt(greatest(wxx / w - (wx / w) * (wx / w), 1e-12)) ELSE level_stdv END, 5) AS level_stdv FROM model LEFT JOIN s USING (kmer)""")
def _(v):
    """One step from the pooled counts of all series."""
    return train.train_pooled(_prepared(v), v.model()).select("kmer", F.round("level_mean", 5).alias("level_mean"), F.round("level_stdv", 5).alias("level_stdv"))


@query("a8_train_rolling", _COUNTS + """, o AS (SELECT readid, kmer, sum(w) AS w, sum(wx) / sum(w) AS m, sum(wxx) / sum(w) AS mm FROM counts WHERE tail IS NULL OR tail >= 0.5 GROUP BY readid, kmer HAVING sum(w) > 0),
seen AS (SELECT kmer, 1 AS after, CAST(readid AS VARCHAR) AS id, m AS level_mean, sqrt(greatest(mm - m * m, 1e-12)) AS level_stdv FROM o UNION ALL SELECT kmer, 0, NULL, level_mean, level_stdv FROM model),
last AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY after DESC, id DESC) AS k FROM seen) SELECT kmer, round(avg(level_mean), 5) AS level_mean, round(avg(level_stdv), 5) AS level_stdv FROM last WHERE k <= 100 GROUP BY kmer""")
def _(v):
    """Levels of each series by itself, then the mean of each k-mer's last hundred."""
    return train.train_rolling(_prepared(v), v.model()).select("kmer", F.round("level_mean", 5).alias("level_mean"), F.round("level_stdv", 5).alias("level_stdv"))


@query("a5_segment_reads", _READS + ", rows_ AS MATERIALIZED (SELECT readid, t, list(m ORDER BY n) AS pm, list(e ORDER BY n) AS pe FROM po GROUP BY readid, t)" + _WALK + """,
line AS (SELECT k.readid, k.t, k.n, k.in_m, exp(CASE WHEN k.in_m THEN p.m ELSE p.e END) AS p, sum(CAST(k.in_m AS INTEGER)) OVER (PARTITION BY k.readid ORDER BY k.t) AS seg FROM back k JOIN po p ON p.readid = k.readid AND p.t = k.t AND p.n = k.n),
segs AS (SELECT readid, seg, min(t) - 1 AS start, max(t) AS "end", min(n) - 1 AS n, median(p) AS p FROM line GROUP BY readid, seg)
SELECT s.readid, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(n + 2 AS INTEGER) AS basepos, substring(seq, CAST(n + 3 AS INTEGER), 1) AS base, substring(seq, CAST(n + 1 AS INTEGER), 5) AS motif, 'M' AS state, round(p, 6) AS posterior_probability, NULL AS error
FROM segs s JOIN rd ON rd.readid = s.readid UNION ALL
SELECT readid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN length(seq) < 5 THEN 'sequence shorter than k-mer' ELSE 'signal too short' END FROM event_reads WHERE length(seq) < 5 OR len(x) < 2 * (length(seq) - 4)""")
def _(v):
    """Segments of every series: borders, bases and the median posterior of each."""
    found = segment.segment_reads(_prepared(v))
    return found.select("readid", "start", "end", "basepos", "base", "motif", "state", F.round("posterior_probability", 6).alias("posterior_probability"), "error")
