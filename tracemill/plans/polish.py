"""Queries on the five-state segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import polish, segment
from tracemill.plans.base import query
from tracemill.plans.views import with_views as V


def _prepared(v):
    return segment.prepare_reads(v.event_reads(), v.model())


@query("a11_prune_positions")
def _(v):
    """Likely positions of each sample; the rule itself is held against SQL in w10_top_mass."""
    return polish.prune_positions(segment.posterior_rows(_prepared(v), 0.001))


@query("a12_prune_kmers")
def _(v):
    """Likely k-mers of each sample, whatever the sequence; held against all walks over the k-mers in the tests."""
    return polish.kmer_posterior_rows(_prepared(v), v.model(), mass=polish.MASS)


@query("a13_candidate_cells", V("event_kmers") + """, pos AS (SELECT readid, 2 * n + j AS t, n FROM event_kmers, (SELECT unnest([0, 1, 2]) AS j)),
km AS (SELECT DISTINCT readid, 2 * n + j AS t, kmer FROM event_kmers, (SELECT unnest([0, 1]) AS j))
SELECT readid, t, n, kmer FROM pos JOIN km USING (readid, t) UNION SELECT readid, t, n, kmer FROM pos JOIN event_kmers USING (readid, n)""")
def _(v):
    own = v.event_kmers()
    at = lambda *js: own.select("readid", F.explode(F.array(*[F.col("n") * 2 + j for j in js])).alias("t"), "n", "kmer")
    return polish.candidate_cells(at(0, 1, 2), at(0, 1).select("readid", "t", "kmer").distinct(), own)


@query("a14_polish_reads")
def _(v):
    """Every series of events; the sums are held against all paths in the tests."""
    return polish.polish_reads(_prepared(v), v.model())
