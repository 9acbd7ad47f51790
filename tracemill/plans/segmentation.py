"""Queries on the segmentation job: every series of ``events`` against levels of its own sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, segment, train
from tracemill.plans.base import query
from tracemill.plans.series import _h
from tracemill.plans.views import with_views as V
from tracemill.sources.scratch import scratch


def _prepared(v, model=None):
    return segment.prepare_reads(v.event_reads(), model or v.model())


@query("a1_prepare_reads", V("event_reads", "model", "event_kmers") + """, m AS (SELECT readid, list(level_mean ORDER BY n) AS mu FROM event_kmers JOIN model USING (kmer) GROUP BY readid)
SELECT r.readid, length(seq) AS bases, len(x) AS samples, CASE WHEN length(seq) < 5 THEN 'sequence shorter than k-mer' WHEN len(x) < 2 * (length(seq) - 4) THEN 'signal too short' END AS error,
CASE WHEN length(seq) >= 5 AND len(x) >= 2 * (length(seq) - 4) THEN mu ELSE [] END AS mu FROM event_reads r LEFT JOIN m USING (readid)""")
def _(v):
    return _prepared(v).select("readid", F.length("seq").cast("long").alias("bases"), F.size("x").cast("long").alias("samples"), "error", "mu")


@query("p24_pore_defaults", V("reads") + """, p(i, pore, is_rna, k) AS (VALUES (0, 'rna002', true, 5), (1, 'rna004', true, 9), (2, 'dna_r9', false, 5), (3, 'dna_r10_260', false, 9), (4, 'dna_r10_400', false, 9))
SELECT readid, pore, is_rna, CAST(k AS INTEGER) AS k, CAST(greatest(0, length(seq) - k + 1) AS INTEGER) AS segments FROM reads JOIN p ON readid % 5 = i""")
def _(v):
    """What a read's pore type means for its segmentation: molecule, k and so the number of segments."""
    names = F.array(*[F.lit(p[0]) for p in X.PORES])
    rows = v.reads().withColumn("pore", F.get(names, (F.col("readid") % 5).cast("int"))).join(F.broadcast(X.pore_defaults(v.spark)), "pore")
    return rows.select("readid", "pore", "is_rna", "k", F.greatest(F.lit(0), F.length("seq") - F.col("k") + 1).alias("segments"))


_PORE = "rna002"
_Z = """b AS (SELECT * FROM basecalls WHERE qs >= 3), z AS (SELECT b.readid, p.pos - b.ts AS pos, ((CASE WHEN b.shift <= 400 THEN p.x ELSE floor(p.x + 450) END) - b.shift) / b.scale AS x
FROM points p JOIN b ON p.readid = b.user_id WHERE p.pos >= b.ts AND b.user_id % 11 <> 0), """


@query("a1_prepare_signals", V("points", "basecalls") + ", " + _Z + _h(3, 3).replace("FROM points", "FROM z") + """,
f AS (SELECT readid, list(round(filtered, 6) ORDER BY pos) AS x FROM hampel GROUP BY readid)
SELECT b.readid, coalesce(b.signalid, b.readid) AS signalid, CASE WHEN reverse(b.seq) LIKE 'AAAAAAAAA%' THEN reverse(b.seq) ELSE concat('AAAAAAAAA', reverse(b.seq)) END AS seq, coalesce(f.x, []) AS x,
CASE WHEN f.x IS NULL THEN 'no signal' WHEN len(f.x) < 2 * (length(b.seq) + CASE WHEN reverse(b.seq) LIKE 'AAAAAAAAA%' THEN 0 ELSE 9 END - 4) THEN 'signal too short' END AS error FROM b LEFT JOIN f USING (readid)""")
def _(v):
    """The whole preparation of an RNA pore: quality, signals, window, scale, Hampel filter, orientation, levels."""
    rows = segment.prepare(v.basecalls(), v.raw_signals(), v.all_kmers(), _PORE, 3.0)
    return rows.select("readid", "signalid", "seq", F.transform("x", lambda x: F.round(x, 6)).alias("x"), "error")


@query("a5_segment_rna", V("points", "basecalls") + """, r AS (SELECT concat('read-', user_id) AS readid, ns - ts AS samples, length(seq) + CASE WHEN reverse(seq) LIKE 'AAAAAAAAA%' THEN 0 ELSE 9 END AS bases FROM basecalls WHERE user_id % 11 <> 0)
SELECT readid, bases - 4 AS segments, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS empty, CAST(samples AS INTEGER) AS last_end, CAST(2 AS INTEGER) AS first_pos, CAST(bases - 3 AS INTEGER) AS last_pos FROM r WHERE samples >= 2 * (bases - 4)""")
def _(v):
    """Segments of all reads by an RNA pore, as invariants: they follow each other without gaps, from the 3' end to the 5' end."""
    _, is_rna, k, params = X.pore(_PORE)
    found = segment.segment_reads(segment.prepare(v.basecalls(), v.raw_signals(), v.all_kmers(), _PORE), k, params, is_rna=is_rna)
    ends = found.where("error IS NULL").groupBy("readid").agg(F.max_by("basepos", "start").alias("first_pos"), F.min_by("basepos", "start").alias("last_pos"))
    return segment.segment_invariants(found).join(ends, "readid")


@query("a16_segment_invariants", V("event_reads") + """SELECT readid, length(seq) - 4 AS segments, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS empty, CAST(len(x) AS INTEGER) AS last_end
FROM event_reads WHERE length(seq) >= 5 AND len(x) >= 2 * (length(seq) - 4)""")
def _(v):
    return segment.segment_invariants(segment.segment_reads(_prepared(v)))


@query("a15_segment_errors", V("event_reads") + "SELECT readid, CASE WHEN length(seq) < 5 THEN 'sequence shorter than k-mer' ELSE 'signal too short' END AS error FROM event_reads WHERE length(seq) < 5 OR len(x) < 2 * (length(seq) - 4)")
def _(v):
    return segment.segment_errors(segment.segment_reads(_prepared(v)))


@query("a3_band", V("event_reads") + """, r AS (SELECT readid, len(x) + 1 AS nr, length(seq) - 3 AS nc FROM event_reads WHERE length(seq) >= 5 AND len(x) >= 2 * (length(seq) - 4)),
b AS (SELECT readid, nc, t, t * nc // nr AS c, greatest(1, least(10, nc // 2)) AS h FROM (SELECT *, unnest(range(nr)) AS t FROM r))
SELECT readid, t, CAST(greatest(0, c - h) AS BIGINT) AS low, CAST(least(nc - 1, c + h) AS BIGINT) AS high FROM b""")
def _(v):
    return segment.band_rows(_prepared(v), 20)


@query("f10_z_consistent", V("event_reads") + "SELECT count(*) AS reads, CAST(0 AS BIGINT) AS inconsistent FROM event_reads WHERE length(seq) >= 5 AND len(x) >= 2 * (length(seq) - 4)")
def _(v):
    from tracemill.operators.filters import z_consistent

    rows = z_consistent(segment.log_likelihood(_prepared(v)).where("error IS NULL").drop("error"))
    return rows.agg(F.count("*").alias("reads"), F.count_if(F.col("error").isNotNull()).alias("inconsistent"))


@query("a7_expected_weight", V("event_reads") + "SELECT readid, CAST(len(x) AS BIGINT) AS weight FROM event_reads WHERE length(seq) >= 5 AND len(x) >= 2 * (length(seq) - 4)")
def _(v):
    """Every sample belongs to some k-mer: expected weights sum to the number of samples."""
    return segment.expected_counts(_prepared(v)).groupBy("readid").agg(F.round(F.sum("w")).cast("long").alias("weight"))


@query("a10_fit")
def _(v):
    """An epoch over the pooled counts of all reads, with new transitions and the scores before and after; held against known levels in the tests."""
    new, params, changes = train.fit(lambda m: _prepared(v, m), v.model(), checkpoint=scratch(v.spark, "fit"))
    return new.withColumns({"m1": F.lit(params["m1"]), "e2": F.lit(params["e2"]), "zchange": F.lit(changes[-1])})


@query("a10_fit_batches")
def _(v):
    """Steps over batches of 24 reads, the first four; the model after them. Held against loops in the tests."""
    return train.fit(lambda m: _prepared(v, m), v.model(), batch_size=train.BATCH, max_batches=4)[0]


@query("a8_merge_history", V("param_obs") + """SELECT param, count(*) AS observations, round(avg(value), 9) AS level_mean, round(avg(2 * value), 9) AS level_stdv
FROM (SELECT *, row_number() OVER (PARTITION BY param ORDER BY seq_no DESC) AS back FROM param_obs) WHERE back <= 100 GROUP BY param""")
def _(v):
    """The state of the last hundred observations, merged from three batches; equal to the last hundred of all."""
    rows = v.param_obs().select("param", "seq_no", F.col("value").alias("level_mean"), (F.col("value") * 2).alias("level_stdv"))
    last = rows.agg(F.max("seq_no")).first()[0] or 0
    state = rows.limit(0).select("param", F.array(F.struct("level_mean", "level_stdv")).alias("seen"))
    for lo, hi in ((0, last // 2), (last // 2, last - 30), (last - 30, last)):
        state = train.merge_history(state, rows.where((F.col("seq_no") > lo) & (F.col("seq_no") <= hi)))
    return train.model_of(state).join(state.select(F.col("param").alias("kmer"), F.size("seen").cast("long").alias("observations")), "kmer").select(
        F.col("kmer").alias("param"), "observations", F.round("level_mean", 9).alias("level_mean"), F.round("level_stdv", 9).alias("level_stdv")
    )


# k-mers from G on have no weight, so they keep their levels
_STATS = "stats AS (SELECT kmer, CAST(kmer < 'G' AS INTEGER) * CAST(1 AS DOUBLE) AS w, CAST(kmer < 'G' AS INTEGER) * CAST(n % 7 AS DOUBLE) AS wx, CAST(kmer < 'G' AS INTEGER) * CAST((n % 7) * (n % 7) AS DOUBLE) AS wxx FROM event_kmers)"


@query("g20_emission_update", V("event_kmers", "model") + f", {_STATS}, s AS (SELECT kmer, sum(w) AS w, sum(wx) AS wx, sum(wxx) AS wxx FROM stats GROUP BY kmer) SELECT kmer, round(CASE WHEN w > 0 THEN wx / w ELSE level_mean END, 6) AS level_mean, round(CASE WHEN w > 0 THEN sqrt(greatest(wxx / w - (wx / w) * (wx / w), 1e-12)) ELSE level_stdv END, 6) AS level_stdv FROM model LEFT JOIN s USING (kmer)")
def _(v):
    n = F.col("n") % 7
    w = (F.col("kmer") < "G").cast("double")
    stats = v.event_kmers().select("kmer", w.alias("w"), (w * n).alias("wx"), (w * n * n).alias("wxx"))
    return aggs.emission_update(stats, v.model()).select("kmer", F.round("level_mean", 6).alias("level_mean"), F.round("level_stdv", 6).alias("level_stdv"))
