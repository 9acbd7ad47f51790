"""Queries on reads and their sequences, k-mers and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, evaluate, filters, joins
from tracemill.plans.base import query
from tracemill.plans.metrics import _N50
from tracemill.plans.views import with_views as V

_R = V("reads")


@query("f1_min_qscore", _R + "SELECT readid, raw_file, qs FROM reads WHERE qs >= 10")
def _(v):
    return filters.min_qscore(v.reads(), 10).select("readid", "raw_file", "qs")


@query("g24_skip_counters", _R + "SELECT raw_file, count(*) FILTER (WHERE qs >= 10) AS kept, count(*) FILTER (WHERE qs < 10) AS skipped FROM reads GROUP BY raw_file")
def _(v):
    return filters.skip_counters(v.reads(), 10)


_RATIO = ", ".join(f"(length(seq) - length(replace(seq, '{b}', ''))) / CAST(nullif(length(seq), 0) AS DOUBLE)" for b in "ACGT")


@query("f2_drop_low_complexity", _R + f"SELECT readid FROM reads WHERE length(seq) > 0 AND greatest({_RATIO}) < 0.33")
def _(v):
    return filters.drop_low_complexity(v.reads(), 0.33).select("readid")


@query("f3_validate", _R + """SELECT readid, CASE WHEN n_samples < 1 THEN 'empty signal' WHEN length(seq) < 5 THEN 'sequence shorter than k-mer'
  WHEN n_samples < 2 * (length(seq) - 4) THEN 'signal too short' WHEN NOT regexp_full_match(seq, '[ACGT]+') THEN 'letter outside the model' END AS error FROM reads""")
def _(v):
    return filters.validate(v.reads(), 5).select("readid", "error")


@query("p3_orient_sequence", _R + "SELECT readid, md5(CASE WHEN starts_with(reverse(seq), 'AAAAAAAAA') THEN reverse(seq) ELSE concat('AAAAAAAAA', reverse(seq)) END) AS oriented_md5 FROM reads")
def _(v):
    return v.reads().select("readid", F.md5(X.orient_sequence(F.col("seq"), True).cast("binary")).alias("oriented_md5"))


@query("p4_kmers", _R + "SELECT kmer, count(*) AS n FROM (SELECT substring(seq, CAST(i AS INTEGER), 5) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM reads)) GROUP BY kmer")
def _(v):
    return v.reads().select(F.explode(X.kmers(F.col("seq"), 5)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


_INT = " + ".join(f"(instr('ACGT', substring(kmer, {k}, 1)) - 1) * {4 ** (5 - k)}" for k in range(1, 6))


@query("p5_kmer_to_int", V("model") + f"SELECT kmer, CAST({_INT} AS BIGINT) AS number, kmer AS back FROM model")
def _(v):
    rows = v.model().select("kmer", X.kmer_to_int(F.col("kmer")).alias("number"))
    return rows.select("kmer", "number", X.int_to_kmer(F.col("number"), 5).alias("back"))


@query("p6_kmer_neighbours", V("model") + f""", m AS (SELECT kmer, CAST({_INT} AS BIGINT) AS number FROM model)
SELECT kmer, CAST(b AS BIGINT) AS letter, CAST((number % 256) * 4 + b AS BIGINT) AS successor, CAST(number // 4 + b * 256 AS BIGINT) AS predecessor FROM m, (SELECT unnest([0, 1, 2, 3]) AS b)""")
def _(v):
    rows = v.model().select("kmer", X.kmer_to_int(F.col("kmer")).alias("number"))
    both = F.arrays_zip(X.successors(F.col("number"), 5).alias("s"), X.predecessors(F.col("number"), 5).alias("p"))
    return rows.select("kmer", F.posexplode(both).alias("letter", "z")).select("kmer", F.col("letter").cast("long").alias("letter"), F.col("z.s").alias("successor"), F.col("z.p").alias("predecessor"))


_HAM = " + ".join(f"(CASE WHEN substring(a.kmer, {k}, 1) <> substring(b.kmer, {k}, 1) THEN -2 ELSE 0 END)" for k in range(1, 6))


@query("p7_hamming_penalty", V("event_kmers") + f"SELECT a.readid, a.n, CAST({_HAM} AS INTEGER) AS penalty FROM event_kmers a JOIN event_kmers b ON a.readid = b.readid AND b.n = a.n + 1")
def _(v):
    k = v.event_kmers()
    after = k.select("readid", (F.col("n") - 1).alias("n"), F.col("kmer").alias("after"))
    return k.join(after, ["readid", "n"]).select("readid", "n", X.hamming_penalty(F.col("kmer"), F.col("after")).alias("penalty"))


@query("p8_log_normal_pdf", V("points") + "SELECT readid, pos, round(-0.5 * ((x - 50.0) / 49.0) * ((x - 50.0) / 49.0) - ln(49.0) - ln(2 * pi()) / 2, 6) AS log_pdf FROM points")
def _(v):
    return v.points().select("readid", "pos", F.round(X.log_normal_pdf(F.col("x"), F.lit(50.0), F.lit(49.0)), 6).alias("log_pdf"))


@query("p9_log_plus", V("points") + "SELECT readid, pos, round(ln(exp(-x / 50) + exp(-pos / 50.0)), 6) AS log_sum FROM points")
def _(v):
    return v.points().select("readid", "pos", F.round(X.log_plus(-F.col("x") / 50, -F.col("pos") / 50.0), 6).alias("log_sum"))


@query("p9_log_sum_exp", V("points") + "SELECT readid, round(ln(sum(exp(-x / 50))), 6) AS log_sum FROM points GROUP BY readid")
def _(v):
    return aggs.log_sum_exp(v.points().select("readid", (-F.col("x") / 50).alias("v")), ["readid"], "v").select("readid", F.round("log_sum", 6).alias("log_sum"))


_COUNTS = ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS n_{b.lower()}, round((length(seq) - length(replace(seq, '{b}', ''))) / CAST(nullif(length(seq), 0) AS DOUBLE), 9) AS ratio_{b.lower()}" for b in "ACGT")


@query("p10_nt_counts", _R + f"SELECT readid, {_COUNTS} FROM reads")
def _(v):
    seq = F.col("seq")
    return v.reads().select("readid", *[c for b in "ACGT" for c in (X.nt_count(seq, b).alias(f"n_{b.lower()}"), F.round(X.nt_ratio(seq, b), 9).alias(f"ratio_{b.lower()}"))])


@query("p11_motif", V("event_reads") + """SELECT readid, i AS pos, substring(seq, CAST(greatest(i - 2, 0) + 1 AS INTEGER), CAST(least(i + 3, length(seq)) - greatest(i - 2, 0) AS INTEGER)) AS motif,
  substring(concat('NN', seq, 'NN'), CAST(i + 1 AS INTEGER), 5) AS padded, CAST(length(seq) - i - 1 AS INTEGER) AS flipped_pos FROM (SELECT readid, seq, unnest(range(0, length(seq))) AS i FROM event_reads)""")
def _(v):
    rows = v.event_reads().select("readid", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"))
    seq, pos = F.col("seq"), F.col("pos")
    return rows.select("readid", pos.cast("long").alias("pos"), X.motif(seq, pos, 5).alias("motif"), X.padded_motif(seq, pos, 5).alias("padded"), X.rna_flip(pos, X.motif(seq, pos, 5), F.length(seq))[0].alias("flipped_pos"))


@query("p12_rna_flip", V("event_kmers") + "SELECT readid, n, reverse(kmer) AS motif FROM event_kmers")
def _(v):
    return v.event_kmers().select("readid", "n", X.rna_flip(F.col("n"), F.col("kmer"), F.lit(0))[1].alias("motif"))


@query("p13_polish_text", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END, ''), 'NA') AS polish FROM documents")
def _(v):
    raw = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("lang"))
    return v.table("documents").select("doc_id", X.polish_text(raw).alias("polish"))


@query("p15_base_from_motif", V("event_kmers") + "SELECT readid, n, substring(replace(replace(kmer, 'T', 'U'), 'U', 'T'), 3, 1) AS base FROM event_kmers")
def _(v):
    return v.event_kmers().select("readid", "n", X.base_from_motif(F.replace("kmer", F.lit("T"), F.lit("U"))).alias("base"))


@query("j2_attach_levels", V("event_kmers", "model") + "SELECT readid, n, kmer, level_mean, level_stdv FROM event_kmers JOIN model USING (kmer)")
def _(v):
    return joins.attach_levels(v.event_kmers(), v.model()).select("readid", "n", "kmer", "level_mean", "level_stdv")


@query("p18_expected_level", V("event_kmers", "model") + "SELECT readid, n, round(level_mean - 1.96 * level_stdv, 6) AS low, round(level_mean + 1.96 * level_stdv, 6) AS high FROM event_kmers JOIN model USING (kmer)")
def _(v):
    rows = joins.attach_levels(v.event_kmers(), v.model())
    return rows.select("readid", "n", F.round(F.col("level_mean") - 1.96 * F.col("level_stdv"), 6).alias("low"), F.round(F.col("level_mean") + 1.96 * F.col("level_stdv"), 6).alias("high"))


@query("j4_lookup_base", _R + ", s AS (SELECT doc_id AS readid, CAST(n_chars % 50 AS INTEGER) AS kmer_idx FROM documents) SELECT readid, kmer_idx, substring(seq, kmer_idx + 1, 1) AS base FROM s JOIN reads USING (readid)")
def _(v):
    s = v.table("documents").select(F.col("doc_id").alias("readid"), (F.col("n_chars") % 50).cast("int").alias("kmer_idx"))
    return joins.lookup_base(s, v.reads()).select("readid", "kmer_idx", "base")


@query("j5_presence", V("pairs") + "SELECT readid, present, md5(CASE WHEN present THEN segmented_seq END) AS segmented_md5 FROM pairs")
def _(v):
    p = v.pairs()
    return joins.presence(p.select("readid", "seq"), p.where("present").select("readid", F.col("segmented_seq").alias("seq"))).select("readid", "present", F.md5(F.col("segmented_seq").cast("binary")).alias("segmented_md5"))


@query("u3_missing_reads", V("pairs") + "SELECT readid FROM pairs EXCEPT SELECT readid FROM pairs WHERE present")
def _(v):
    p = v.pairs()
    return p.select("readid").exceptAll(p.where("present").select("readid"))


@query("u2_intersect_ids", V("pairs") + "SELECT readid FROM pairs WHERE present INTERSECT SELECT readid FROM pairs WHERE length(segmented_seq) = length(seq)")
def _(v):
    p = v.pairs()
    return p.where("present").select("readid").intersect(p.where("length(segmented_seq) = length(seq)").select("readid"))


@query("g6_read_recovery_counts", V("pairs") + """SELECT count(*) AS total, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS missing,
  count(*) FILTER (WHERE present AND seq = segmented_seq) AS identical, count(*) FILTER (WHERE present AND length(segmented_seq) < length(seq)) AS truncated FROM pairs""")
def _(v):
    return aggs.read_recovery_stats(v.pairs()).drop("nt_changed")


# The segmented sequences of ``pairs`` lack a letter, have one changed or one more, or are the same: their distance is one where they
# differ, for which no table of a distance is needed. What the operator computes is held against a table in the tests.
_EDITS = "CAST(seq <> segmented_seq AS BIGINT)"
_RECOVERED = f"""count(*) AS total, count(*) FILTER (WHERE present) AS present, count(*) FILTER (WHERE NOT present) AS missing, count(*) FILTER (WHERE present AND seq = segmented_seq) AS identical,
  count(*) FILTER (WHERE present AND length(segmented_seq) < length(seq)) AS truncated, CAST(coalesce(sum({_EDITS}) FILTER (WHERE present), 0) AS BIGINT) AS nt_changed"""


@query("g6_read_recovery_edits", V("pairs") + f"SELECT {_RECOVERED} FROM pairs")
def _(v):
    """All recovery statistics, with the edits of whole sequences."""
    return aggs.read_recovery_stats(v.pairs())


@query("e7_sequence_edits", V("pairs") + f"SELECT readid, {_EDITS} AS edits FROM pairs WHERE present")
def _(v):
    """Edit distance of each whole basecalled sequence to its segmented one."""
    return evaluate.edit_distance(v.pairs().where("present")).select("readid", F.col("edits").cast("long").alias("edits"))


@query("e5_evaluate_reads", V("pairs") + f""", c AS (SELECT {_RECOVERED} FROM pairs), d AS (SELECT * REPLACE (CAST(total AS DOUBLE) AS total, CAST(present AS DOUBLE) AS present, CAST(missing AS DOUBLE) AS missing, CAST(identical AS DOUBLE) AS identical, CAST(truncated AS DOUBLE) AS truncated, CAST(nt_changed AS DOUBLE) AS nt_changed) FROM c),
lens AS (SELECT 'all' AS grp, length(segmented_seq) AS len FROM pairs WHERE present), n AS ({_N50.format("lens")}),
s AS (SELECT avg(len) AS mean_length, median(len) AS median_length, CAST(max(len) AS DOUBLE) AS max_length, CAST(min(len) AS DOUBLE) AS min_length, CAST(any_value(n50) AS DOUBLE) AS n50_length FROM lens JOIN n USING (grp))
SELECT metric, round(value, 6) AS value FROM (UNPIVOT d ON total, present, missing, identical, truncated, nt_changed INTO NAME metric VALUE value) UNION ALL
SELECT metric, round(value, 6) AS value FROM (UNPIVOT s ON n50_length, mean_length, median_length, max_length, min_length INTO NAME metric VALUE value)""")
def _(v):
    """Recovery, edits and lengths of the segmented reads."""
    p = v.pairs()
    return evaluate.evaluate_reads(p.select("readid", "seq"), p.where("present").select("readid", F.col("segmented_seq").alias("seq"))).withColumn("value", F.round("value", 6))


@query("g26_segments_to_sequence", V("triples") + "SELECT readid, string_agg(base, '' ORDER BY n DESC) AS seq FROM triples GROUP BY readid")
def _(v):
    p = v.points()
    t = p.groupBy("readid", F.floor(F.col("pos") / 3).alias("start")).agg(F.substring(F.lit("ACGT"), (F.sum("event_id") % 4).cast("int") + 1, F.lit(1)).alias("base"))
    return aggs.segments_to_sequence(t, is_rna=True)


@query("w11_batch_no", _R + ", b AS (SELECT readid, raw_file, CAST((row_number() OVER (PARTITION BY raw_file ORDER BY readid) - 1) // 24 AS INTEGER) AS batch FROM reads WHERE qs >= 10) SELECT readid, raw_file, batch FROM (SELECT *, count(*) OVER (PARTITION BY raw_file, batch) AS n FROM b) WHERE n = 24")
def _(v):
    from tracemill.operators import windows

    return windows.batch_no(filters.min_qscore(v.reads(), 10), ["readid"], 24, ["raw_file"]).select("readid", "raw_file", "batch")


@query("g23_reduce_model", V("event_reads") + """, nine AS (SELECT DISTINCT substring(seq, CAST(i AS INTEGER), 9) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 7)) AS i FROM event_reads))
SELECT substring(kmer, 3, 5) AS kmer, round(avg(instr('ACGT', substring(kmer, 1, 1)) + 4.0 * instr('ACGT', substring(kmer, 9, 1))), 6) AS level_mean, CAST(0.25 AS DOUBLE) AS level_stdv FROM nine GROUP BY 1""")
def _(v):
    nine = v.event_reads().select(F.explode(X.kmers(F.col("seq"), 9)).alias("kmer")).distinct()
    digit = lambda k: F.instr(F.lit("ACGT"), F.substring("kmer", k, 1))
    model = nine.select("kmer", (digit(1) + digit(9) * 4.0).alias("level_mean"), F.lit(0.25).alias("level_stdv"))
    return aggs.reduce_model(model).select("kmer", F.round("level_mean", 6).alias("level_mean"), "level_stdv")
