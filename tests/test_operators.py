"""Fixtures with known results and brute-force versions of what SQL can't express."""

import itertools
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import aggs, evaluate, filters, joins, segment, windows
from tracemill.plans import registry
from tracemill.plans.views import Views
from tracemill.sources import readers, sinks


def series(spark, values, readid=1):
    return spark.createDataFrame([(readid, k, float(v)) for k, v in enumerate(values)], "readid long, pos long, x double")


def hampel_loop(x, w, n):
    out, half = list(x), w // 2
    if len(x) <= w:
        return out
    for c in range(half, len(x) - half - 1):
        own = np.array(x[c - half : c - half + w])
        med = np.median(own)
        if abs(x[c] - med) > n * 1.4826 * np.median(np.abs(own - med)):
            out[c] = float(med)
    return out


@pytest.mark.parametrize("values", [[1, 1, 1, 10, 1, 1, 1], [1, 1, 50, 1, 1, 1, 75, 1], [5, 6], [], [3.5, -1, 9, 2, 2, 2, 8, 0]])
@pytest.mark.parametrize("w,n", [(3, 3.0), (6, 5.0), (7, 5.0)])
def test_hampel(spark, values, w, n):
    want = hampel_loop([float(v) for v in values], w, n)
    got = [r.filtered for r in windows.hampel(series(spark, values), w, n).orderBy("pos").collect()]
    assert got == want
    row = spark.createDataFrame([([float(v) for v in values],)], "x array<double>").select(segment.hampel_array(F.col("x"), w, n).alias("f")).first()
    assert row.f == want


def test_counts_and_ratios(spark):
    r = spark.createDataFrame([("ACGTACGT",), ("",), (None,)], "seq string").select(*[X.nt_count(F.col("seq"), b).alias(b) for b in "ACGT"], X.nt_ratio(F.col("seq"), "A").alias("r")).collect()
    assert tuple(r[0]) == (2, 2, 2, 2, 0.25)
    assert r[1].r is None and r[2].r is None


def test_model_round_trip(spark, tmp_path):
    rows = [("AAAAA", 100.0, 10.0), ("AAAAC", 110.0, 11.0), ("AAAAG", 120.0, 12.0)]
    sinks.write_kmer_model(spark.createDataFrame(rows, "kmer string, level_mean double, level_stdv double"), str(tmp_path / "m"))
    assert sorted(map(tuple, readers.read_kmer_model(spark, str(tmp_path / "m")).collect())) == rows
    (tmp_path / "bad.tsv").write_text("kmer\tlevel_mean\tlevel_stdv\nAA\t1\t1\nAAA\t1\t1\n")
    with pytest.raises(ValueError):
        readers.read_kmer_model(spark, str(tmp_path / "bad.tsv"))


def test_rolling(spark):
    rows = spark.createDataFrame([("p", k, float(k)) for k in range(1, 8)], "param string, seq_no long, value double")
    last = windows.rolling(rows, 5).orderBy(F.desc("seq_no")).first()
    assert (last["mean"], last["median"]) == (5.0, 5.0)


def test_errors_are_rows(spark):
    model = spark.createDataFrame([("AA", 0.0, 1.0)], "kmer string, level_mean double, level_stdv double")
    reads = spark.createDataFrame([(1, "AAA", [0.0] * 8), (2, "A", [0.0] * 8), (3, "AAAA", [0.0] * 3), (4, "AAN", [0.0] * 9), (5, "AAC", [0.0] * 9), (6, "AA", [])], "readid long, seq string, x array<double>")
    found = segment.segment_reads(segment.prepare_reads(reads, model, 2), 2)
    assert {r.readid: r.error for r in segment.segment_errors(found).collect()} == {2: "sequence shorter than k-mer", 3: "signal too short", 4: "letter outside the model", 5: "k-mer outside the model", 6: "empty signal"}
    good = found.where("error IS NULL").orderBy("start").collect()
    assert [(r.start, r.end) for r in good][0][0] == 0 and good[-1].end == 8 and len(good) == 2


def brute_z(x, mu, sd, p):
    """Log sum over all splits into runs of at least two samples, and the posterior of each sample's k-mer."""
    n, t, total, own = len(mu), len(x), [], []
    for cuts in itertools.combinations(range(1, t), n - 1):
        edges = [0, *cuts, t]
        if min(b - a for a, b in itertools.pairwise(edges)) < 2:
            continue
        s = 0.0
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            s += p["m1"] + p["e1"] + (b - a - 2) * p["e2"] + sum(-0.5 * ((v - mu[k]) / sd[k]) ** 2 - math.log(sd[k]) - 0.5 * math.log(2 * math.pi) for v in x[a:b])
        total.append(s)
        own.append(edges)
    return total, own


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3), st.data())
def test_lattice_against_all_paths(n, data):
    t = data.draw(st.integers(2 * n, 8))
    num = st.floats(-3, 3, allow_nan=False)
    x, mu = np.array(data.draw(st.lists(num, min_size=t, max_size=t))), np.array(data.draw(st.lists(num, min_size=n, max_size=n)))
    sd = np.full(n, 0.7)
    lat = segment.Lattice(x, mu, sd)
    scores, splits = brute_z(x, mu, sd, segment.PARAMS)
    z = np.logaddexp.reduce(scores)
    assert lat.zf == pytest.approx(z, abs=1e-8) and lat.zb == pytest.approx(z, abs=1e-8)
    pM, pE = lat.posteriors()
    mass = np.exp(np.logaddexp(pM[1:, 1:], pE[1:, 1:]))
    want = np.zeros((t, n))
    for s, edges in zip(scores, splits, strict=True):
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[a:b, k] += math.exp(s - z)
    assert np.allclose(mass, want, atol=1e-8) and np.allclose(mass.sum(1), 1)
    # the path: best sum of log posteriors over all splits
    def value(edges):
        return sum(pM[a + 1, k + 1] + pE[a + 2 : b + 1, k + 1].sum() for k, (a, b) in enumerate(itertools.pairwise(edges)))

    found = lat.path()
    starts = [s for s, _, _ in found]
    assert [k for _, k, _ in found] == list(range(n)) and starts[0] == 0
    assert value([*starts, t]) == pytest.approx(max(value(e) for e in splits), abs=1e-7)


def test_known_borders_are_found():
    rng = np.random.default_rng(0)
    mu = rng.permutation(np.linspace(-2, 2, 12))
    dwell = rng.integers(4, 12, 12)
    x = np.repeat(mu, dwell) + rng.normal(0, 0.05, dwell.sum())
    starts = [s for s, _, _ in segment.Lattice(x, mu, np.full(12, 0.25)).path()]
    assert np.abs(np.array(starts) - (np.cumsum(dwell) - dwell)).max() <= 2


def nearest_loop(gt, pred, far):
    found = [{p: abs(g - p) for p in pred if abs(g - p) <= far} for g in gt]
    out = {}
    for k, g in enumerate(gt):
        c = sorted(found[k].items(), key=lambda kv: (kv[1], kv[0]))
        if not c:
            continue
        take = c.pop(0)
        if k and take[0] in found[k - 1] and found[k - 1][take[0]] <= take[1]:
            take = c.pop(0) if c else None
        if take and k + 1 < len(gt) and take[0] in found[k + 1] and found[k + 1][take[0]] < take[1]:
            take = c.pop(0) if c else None
        if take:
            out[g] = take[0]
    return out


def test_nearest_within(spark):
    rng = np.random.default_rng(5)
    truth, pred, want = [], [], {}
    for r in range(20):
        gt, pr = sorted(set(rng.integers(0, 120, 15).tolist())), sorted(set(rng.integers(0, 120, 18).tolist()))
        truth += [(r, g) for g in gt]
        pred += [("t", r, p) for p in pr]
        want |= {(r, g): p for g, p in nearest_loop(gt, pr, 6).items()}
    got = joins.nearest_within(spark.createDataFrame(truth, "readid long, border long"), spark.createDataFrame(pred, "tool string, readid long, border long"), 6).collect()
    assert {(r.readid, r.border): r.near_border for r in got} == want


def test_find_peaks(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 300).astype(float)
    tops = [k for k in range(1, 299) if x[k] > x[k - 1] and x[k] > x[k + 1] and x[k] >= 10]
    kept = []
    for k in sorted(tops, key=lambda k: (-x[k], k)):
        if all(abs(k - j) >= 5 for j in kept):
            kept.append(k)
    got = windows.find_peaks(series(spark, x).withColumnRenamed("x", "score"), 10, 5).collect()
    assert sorted(r.pos for r in got) == sorted(kept)


def test_peaks_of_long_reads():
    """A million peaks in one run, and a run that goes over several batches."""
    import pyarrow as pa

    n = 1_000_000
    rng = np.random.default_rng(3)
    for score in (np.arange(n, dtype=float), rng.random(n)):
        begins = np.zeros(n, bool)
        begins[0] = True
        table = pa.table({"readid": np.zeros(n, np.int64), "pos": np.arange(n) * 2, "score": score, "begins": begins})
        kept = pa.Table.from_batches(windows._suppress(iter(table.to_batches(max_chunksize=10_000)), 5)).column("pos").to_numpy()
        assert (np.diff(kept) >= 5).all() and len(kept) > n / 5


def test_extract_edges_by_loops(spark):
    rng = np.random.default_rng(21)
    rows, spans, want = [], [], set()
    for r in range(12):
        x = np.repeat(rng.normal(0, 3, 12), 9) + rng.normal(0, 0.2, 108)
        a, b = int(rng.integers(0, 20)), int(rng.integers(80, 140))
        rows += [(r, k, float(v)) for k, v in enumerate(x)]
        if r % 4:
            spans.append((r, a, b))
            part = np.array(hampel_loop(x, 6, 5.0))[a:b]
            j = np.arange(-8, 9)
            kernel = -j / 4 * np.exp(-(j**2) / 8) / np.sqrt(2)
            score = np.array([abs((part[k - 8 : k + 9] * kernel).sum()) if 8 <= k < len(part) - 8 else 0.0 for k in range(len(part))])
            tops, kept = [k for k in range(1, len(part) - 1) if score[k] > score[k - 1] and score[k] > score[k + 1] and score[k] >= 2], []
            for k in sorted(tops, key=lambda k: (-score[k], k)):
                if all(abs(k - m) >= 6 for m in kept):
                    kept.append(k)
            want |= {(r, a + k) for k in kept if np.std(score[max(0, k - 3) : k + 3]) < 1}
    got = windows.extract_edges(spark.createDataFrame(rows, "readid long, pos long, x double"), spark.createDataFrame(spans, "readid long, start long, end long"), 2.0, 2, 6)
    assert {(r.readid, r.pos) for r in got.collect()} == want and want


def test_numbered(spark):
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][int(rng.integers(3))], int(k), "z") for k in rng.permutation(500)]
    df = spark.createDataFrame(rows, "param string, seq_no long, other string")
    want = {}
    for p, s, _ in sorted(rows, key=lambda r: r[1]):
        want[p, s] = sum(1 for q, t, _ in rows if q == p and t < s)
    got = windows.numbered(df, "param", "seq_no")
    assert got.columns == ["param", "seq_no", "other", "n"] and {(r.param, r.seq_no): r.n for r in got.collect()} == want
    assert windows.numbered(df.limit(0), "param", "seq_no").count() == 0


def test_stream_rolling(spark, tmp_path):
    """Ten small batches in any order, rows that come twice: the batch window's rows. With gaps each batch by itself."""
    from tracemill.streaming import jobs

    rng = np.random.default_rng(17)
    x = {(p, k): float(rng.normal()) for p in "ab" for k in range(1, 80)}
    keys = list(x)
    rng.shuffle(keys)
    keys += keys[:10]
    schema = "param string, seq_no long, value double"

    def run(rows, name, **more):
        for k in range(10):
            spark.createDataFrame([(p, s, x[p, s]) for p, s in rows[k::10]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
        out = jobs.stream_rolling_param(stream, 7, **more).writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "c"))
        out.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(schema + ", mean double").parquet(str(tmp_path / name / "out")).collect()

    got = run(keys, "ordered")
    assert len(got) == len(x)
    for r in got:
        assert r["mean"] == pytest.approx(np.mean([x[r.param, k] for k in range(max(1, r.seq_no - 6), r.seq_no + 1)]))
    gaps = run([k for k in x if k[1] % 3 == 0], "gaps", consecutive=False)
    assert len(gaps) == 52


def test_stream_rolling_blocks(spark, tmp_path):
    """The end comes first: blocks don't wait for each other, a group's state is bounded, nulls and infinite values count as in SQL."""
    from tracemill.streaming import jobs

    rng = np.random.default_rng(23)
    x = {(p, k): float(rng.normal()) for p in "ab" for k in range(1, 104)}
    x["a", 50], x["a", 51], x["b", 20] = None, None, float("inf")
    schema, at = "param string, seq_no long, value double", {n: str(tmp_path / n) for n in ("in", "out", "c", "d")}
    late = [k for k in x if k[1] > 30]
    early = [k for k in x if k[1] <= 30] + late[:5]
    rng.shuffle(late)

    def come(keys, *more):
        spark.createDataFrame([*((p, s, x[p, s]) for p, s in keys), *more], schema).coalesce(1).write.mode("append").parquet(at["in"])
        stream = spark.readStream.schema(schema).parquet(at["in"])
        out = jobs.stream_rolling_param(stream, 7, block=20).writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["c"])
        out.trigger(availableNow=True).start().awaitTermination()
        return {(r.param, r.seq_no): (r.value, r["mean"]) for r in spark.read.schema(schema + ", mean double").parquet(at["out"]).collect()}

    assert set(come(late)) == {k for k in x if k[1] > 40}  # the block of 21 to 40 waits for its first ten
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(at["c"]).select(F.length("value.early"), F.length("value.last")).collect()
    assert len(kept) > 2 and max(map(max, kept)) <= 16 * (20 + 6)
    got = come(early, ("a", None, 1.0), ("a", 0, 1.0), ("b", 3, x["b", 3] + 1))
    assert set(got) == set(x)
    for (p, s), (value, mean) in got.items():
        seen = [x[p, k] for k in range(max(1, s - 6), s + 1) if x[p, k] is not None]
        assert value == x[p, s] and mean == pytest.approx(np.mean(seen))
    assert spark.read.parquet(at["out"]).count() == len(x)
    assert [jobs._means(np.array(v, float), n).tolist() for v, n in (([1, 2, 4], 1), ([1, 2, 3], 9))] == [[1, 2, 4], [1, 1.5, 2]]


def test_cwt_edges(spark):
    rng = np.random.default_rng(4)
    x = np.r_[np.zeros(60), np.ones(60) * 3] + rng.normal(0, 0.1, 120)
    scale = 3
    j = np.arange(-4 * scale, 4 * scale + 1)
    kernel = -j / scale**2 * np.exp(-(j**2) / (2 * scale**2)) / np.sqrt(scale)
    want = np.zeros(120)
    for k in range(4 * scale, 120 - 4 * scale):
        want[k] = abs((x[k - 4 * scale : k + 4 * scale + 1] * kernel).sum())
    got = [r.score for r in windows.cwt_edges(series(spark, x), scale).orderBy("pos").collect()]
    assert np.allclose(got, want) and int(np.argmax(got)) in (59, 60)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=30))
def test_n50(spark, lengths):
    down, run = sorted(lengths, reverse=True), 0
    for want in down:
        run += want
        if 2 * run >= sum(lengths):
            break
    assert aggs.n50(spark.createDataFrame([("g", v) for v in lengths], "grp string, len long")).first().n50 == want


def test_transition_update(spark):
    rows = spark.createDataFrame([(math.log(3.0), math.log(1.0)), (math.log(1.0), float("-inf"))], "m1 double, e2 double")
    got = {r.param: r.value for r in aggs.transition_update(rows).collect()}
    assert got["m1"] == pytest.approx(0.8) and got["e2"] == pytest.approx(0.2)


def test_sentinels_and_layouts(spark):
    rows = spark.createDataFrame([("r", "0", "5", "9"), ("r", "1", ".", "."), ("r", "x", "1", "2")], "read_id string, kmer_idx string, start_raw_idx string, end_raw_idx string")
    assert filters.drop_sentinel(rows, "kmer_idx", "start_raw_idx").count() == 1
    assert readers.detect_format(["READ_ID", "kmer_idx", "start_raw_idx", "end_raw_idx"]) == "resquiggle"
    with pytest.raises(ValueError):
        readers.detect_format(["a", "b"])
    reads = spark.createDataFrame([("r", "GATTACA")], "readid string, seq string")
    assert readers.normalize_segments(rows, reads=reads).first().base == "G"


def test_vcf_and_fit(spark, tmp_path):
    from tracemill.operators import train

    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nc\t1\t.\tA\tT\t.\t.\tSVTYPE=DEL\nc\t2\t.\tA\tT\t.\t.\tDP=3\n")
    assert aggs.count_sv(readers.read_vcf(spark, str(tmp_path / "v.vcf"))).first().n_sv == 1
    rng = np.random.default_rng(1)
    levels = {a + b: float(k) for k, (a, b) in enumerate(itertools.product("ACGT", repeat=2))}
    reads = []
    for r in range(6):
        seq = "".join(rng.choice(list("ACGT"), 12))
        x = np.concatenate([rng.normal(levels[seq[k : k + 2]], 0.3, 6) for k in range(11)])
        reads.append((r, seq, x.tolist()))
    df = spark.createDataFrame(reads, "readid long, seq string, x array<double>")
    model = spark.createDataFrame([(k, v + 0.3, 1.0) for k, v in levels.items()], "kmer string, level_mean double, level_stdv double")
    new, params, change = train.fit(lambda m: segment.prepare_reads(df, m, 2), model, 1, 2, str(tmp_path / "ckpt"))
    assert change[0] > 0 and math.exp(params["m1"]) + math.exp(params["e2"]) == pytest.approx(1)
    seen = {s[k : k + 2] for _, s, _ in reads for k in range(11)} - {"AA"}
    off = [abs(r.level_mean - levels[r.kmer]) for r in new.collect() if r.kmer in seen]
    assert np.mean(off) < 0.3


def test_fit_in_batches(spark, tmp_path):
    from tracemill.operators import train

    rng = np.random.default_rng(2)
    levels = {a + b: float(k) for k, (a, b) in enumerate(itertools.product("ACGT", repeat=2))}
    reads = []
    for r in range(9):
        seq = "".join(rng.choice(list("ACGT"), 10))
        reads.append((f"b{r}-f00d", seq, np.concatenate([rng.normal(levels[seq[k : k + 2]], 0.3, 6) for k in range(9)]).tolist()))
    df = spark.createDataFrame(reads, "readid string, seq string, x array<double>")
    model = spark.createDataFrame([(k, v + 0.3, 1.0) for k, v in levels.items()], "kmer string, level_mean double, level_stdv double")
    log = str(tmp_path / "log")
    new, _, change = train.fit(lambda m: segment.prepare_reads(df, m, 2), model, 1, 2, str(tmp_path / "c"), batch_size=4, log=log)
    assert len(change) == 2 and new.count() == 16  # the ninth read makes no batch
    assert spark.read.csv(log, header=True).count() == 2
    assert spark.read.parquet(str(tmp_path / "c" / "model-0-0")).count() == 16
    # rolling means by hand: the start value, then the reads of both batches in order of id
    counts = segment.expected_counts(segment.prepare_reads(df, model, 2), 2).where("readid < 'b4'").collect()
    first = {}
    for kmer, level in levels.items():
        own = [level + 0.3]
        for r in sorted({c.readid for c in counts}):
            mine = [c for c in counts if c.readid == r and c.kmer == kmer and (c.tail is None or c.tail >= 0.5)]
            if mine:
                own.append(sum(c.wx for c in mine) / sum(c.w for c in mine))
        first[kmer] = np.mean(own)
    got = {r.kmer: r.level_mean for r in spark.read.parquet(str(tmp_path / "c" / "model-0-0")).collect()}
    assert got == pytest.approx(first)
    assert len(train.fit(lambda m: segment.prepare_reads(df, m, 2), model, 1, 2, str(tmp_path / "d"), batch_size=4, max_batches=1)[2]) == 1


def test_batches_are_prepared_once(spark, tmp_path):
    from tracemill.operators import train

    """A step reads its own batch only, whatever came before; the state stays bounded."""
    model = spark.createDataFrame([("A", 1.0, 0.5), ("C", 3.0, 0.5)], "kmer string, level_mean double, level_stdv double")
    rng = np.random.default_rng(2)
    rows = [(f"r{k:03}", "ACAC", np.repeat([1.0, 3, 1, 3], 3) + rng.normal(0, 0.1, 12)) for k in range(40)]
    df = spark.createDataFrame([(i, s, x.tolist()) for i, s, x in rows], "readid string, seq string, x array<double>")
    calls = []

    def prepare(m):
        calls.append(1)
        return segment.prepare_reads(df, m, 1)

    _, _, changes = train.fit(prepare, model, 2, 1, str(tmp_path / "c"), batch_size=10, max_batches=3)
    assert len(calls) == 1 and len(changes) == 6
    for e in range(2):
        for b in range(3):
            counts = spark.read.parquet(str(tmp_path / "c" / f"counts-{e}-{b}"))
            assert {r.readid for r in counts.select("readid").distinct().collect()} == {f"r{k:03}" for k in range(10 * b, 10 * b + 10)}
    state = spark.read.parquet(str(tmp_path / "c" / "state-1-2"))
    assert {len(r.seen) for r in state.collect()} == {61}
    assert {len(r.seen) for r in train.merge_history(state.select("param", "seen"), train.observations(counts.withColumn("tail", F.lit(None).cast("double"))), 20).collect()} == {20}


def test_blocks_and_band():
    rng = np.random.default_rng(6)
    mu = rng.normal(0, 1, 120)
    x = np.repeat(mu, rng.integers(2, 9, 120))
    x = x + rng.normal(0, 0.2, len(x))
    sd = np.full(120, 0.3)
    whole, parts, narrow = segment.Lattice(x, mu, sd), segment.Lattice(x, mu, sd, block=37), segment.Lattice(x, mu, sd, band=60)
    assert parts.zf == pytest.approx(whole.zf) and parts.zb == pytest.approx(whole.zb) and whole.zb == pytest.approx(whole.zf)
    assert [(s, n) for s, n, _ in parts.path()] == [(s, n) for s, n, _ in whole.path()] == [(s, n) for s, n, _ in narrow.path()]
    assert np.allclose([p for *_, p in parts.path()], [p for *_, p in whole.path()])
    for a, b in zip(parts.sums(), whole.sums(), strict=True):
        assert np.allclose(a, b)
    pM, pE = whole.posteriors()
    mass = np.exp(np.logaddexp(pM[1:, 1:], pE[1:, 1:]))
    assert np.allclose(mass.sum(1), 1) and np.allclose(whole.sums()[0], mass.sum(0))


def test_band_rows(spark):
    model = spark.createDataFrame([("AA", 0.0, 1.0), ("AC", 1.0, 1.0), ("CA", 1.0, 1.0)], "kmer string, level_mean double, level_stdv double")
    seq = "AC" * 15
    prepared = segment.prepare_reads(spark.createDataFrame([("r", seq, [0.5] * 77)], "readid string, seq string, x array<double>"), model, 2)
    lat = segment.Lattice(np.full(77, 0.5), np.zeros(29), np.ones(29), band=12)
    got = {r.t: (r.low, r.high) for r in segment.band_rows(prepared, 12).collect()}
    assert got == {t: (max(0, int(n)), min(lat.N - 1, int(n) + lat.W - 1)) for t, n in enumerate(lat.n0)}


def test_long_read_stays_small():
    import tracemalloc

    rng = np.random.default_rng(8)
    mu = rng.normal(0, 1, 2000)
    x = np.repeat(mu, 5) + rng.normal(0, 0.2, 10_000)
    tracemalloc.start()
    lat = segment.Lattice(x, mu, np.full(2000, 0.3), block=2000)
    found = lat.path()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 and peak < 100 << 20


def test_repeated_and_null_readids(spark):
    model = spark.createDataFrame([("AA", 0.0, 1.0), ("AC", 1.0, 1.0)], "kmer string, level_mean double, level_stdv double")
    reads = spark.createDataFrame([("u-1", "AAC", [0.0, 0.1, 1.0, 1.1]), ("u-1", "AAC", [0.0, 0.1, 1.0, 1.1]), (None, "AAC", [0.0] * 5), ("u-2", None, [0.0]), ("u-3", "AAC", None)], "readid string, seq string, x array<double>")
    rows = segment.segment_reads(segment.prepare_reads(reads, model, 2), 2).collect()
    assert sum(r.readid == "u-1" and r.error is None for r in rows) == 4 and sum(r.readid is None for r in rows) == 2
    assert {r.readid: r.error for r in rows if r.error} == {"u-2": "no sequence", "u-3": "no signal"}


def test_rna_is_turned_back(spark):
    bases = "ACGT"
    level = lambda k: float(sum(bases.index(c) * 4**j for j, c in enumerate(k)) % 97) / 10
    kmers = ["".join(k) for k in itertools.product(bases, repeat=5)]
    model = spark.createDataFrame([(k, level(k), 0.25) for k in kmers], "kmer string, level_mean double, level_stdv double")
    seq = "GATTACATTCAGGC"
    run = "A" * 9 + seq[::-1]  # the pore meets the tail first
    x = np.repeat([level(run[k : k + 5][::-1]) for k in range(len(run) - 4)], 6)
    calls = spark.createDataFrame([("r1", None, "f", seq, 9.0, len(x) + 3, 3, None, 0.0, 1.0), ("low", None, "f", seq, 1.0, 10, 0, None, 0.0, 1.0)], "readid string, signalid string, raw_file string, seq string, qs double, ns int, ts int, sp int, shift double, scale double")
    signals = spark.createDataFrame([("f", "r1", [7.0, 7.0, 7.0, *x.tolist()])], "raw_file string, signalid string, pa array<double>").withColumn("adc", F.lit(None).cast("array<smallint>"))
    prepared = segment.prepare(calls, signals, model, "rna002", 5.0)
    assert [r.seq for r in prepared.collect()] == [run]
    rows = segment.segment_reads(prepared, 5, X.pore("rna002")[3], is_rna=True).orderBy("start").collect()
    padded = seq + "A" * 9
    assert [r.basepos for r in rows] == list(range(len(padded) - 3, 1, -1)) and all(r.base == padded[r.basepos] and r.motif == padded[r.basepos - 2 : r.basepos + 3] for r in rows)
    # within the tail all levels are equal, so its inner borders may lie anywhere
    assert [r.start for r in rows][7:] == list(range(0, len(x), 6))[7:]


def edits_loop(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        left = [row[0] + 1]
        for k, y in enumerate(b):
            left.append(min(row[k] + (x != y), row[k + 1] + 1, left[k] + 1))
        row = left
    return row[-1]


def test_few_edits_along_diagonals():
    import time

    rng = np.random.default_rng(31)
    for _ in range(400):
        a = "".join(rng.choice(list("AC"), rng.integers(0, 30)))
        b = list(a)
        for _ in range(int(rng.integers(0, 6))):
            k = int(rng.integers(len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("AC"), rng.integers(0, 2)))
        b = "".join(b)
        want = edits_loop(a, b)
        assert X.edit_count(a, b) == want and X.few_edits(a, b) == want and X.few_edits(a, b, want - 1) is None
        c = "".join(rng.choice(list("ACG"), rng.integers(0, 90)))
        assert X.edit_count(a, c) == edits_loop(a, c)
    long = "".join(rng.choice(list("ACGT"), 1_000_000))
    other = long[:1000] + "T" + long[1000:700_000] + long[700_003:]
    start = time.time()
    assert X.edit_count(long, other) == edits_loop(long[990:1010], other[990:1011]) + 3 and time.time() - start < 2


def test_free_lead_and_far_peaks(spark):
    rng = np.random.default_rng(12)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("ACG"), rng.integers(0, 14))) for _ in range(2))
        assert X.edit_count(a, b, True) == min(edits_loop(a, b[k:]) for k in range(len(b) + 1))
    x = rng.integers(0, 50, 120).astype(float)
    tops = sorted((k for k in range(1, 119) if x[k] > x[k - 1] and x[k] > x[k + 1] and x[k] >= 10), key=lambda k: (-x[k], k))
    kept = []
    for k in tops:
        if all(abs(k - j) >= 5 for j in kept):
            kept.append(k)
    got = windows.find_peaks(series(spark, x).withColumnRenamed("x", "score"), 10.0, 5)
    assert sorted(r.pos for r in got.collect()) == sorted(kept) and len(kept) < len(tops)


def test_rolling_in_ranges(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=137)
    df = spark.createDataFrame([("p", k, float(v)) for k, v in enumerate(x)], "param string, seq_no long, value double")
    for r in windows.rolling(df, 7, 10).collect():
        own = x[max(0, r.seq_no - 6) : r.seq_no + 1]
        assert r["mean"] == pytest.approx(own.mean()) and r["median"] == pytest.approx(np.median(own))


def test_missing_reports(spark, tmp_path):
    assert aggs.count_sv(readers.read_vcf(spark, str(tmp_path / "none.vcf"))).first().n_sv == 0
    assert readers.read_assembly_info(spark, str(tmp_path / "none.txt")).count() == 0


def test_edits_of_whole_sequences(spark, small):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ACGT"), 400))
    rows = [(1, text, text[:50] + text[53:]), (2, text, "".join(rng.choice(list("ACGT"), 390))), (3, text, ""), (4, "", ""), (5, text, text)]
    rows.append((6, "A" * 3000, "C" * 2900))  # nothing in common
    got = {r.readid: r.edits for r in evaluate.edit_distance(spark.createDataFrame(rows, "readid long, seq string, segmented_seq string")).collect()}
    assert got == {**{i: edits_loop(a, b) for i, a, b in rows[:5]}, 6: 3000}
    for _ in range(200):
        a, b = ("".join(rng.choice(list("ACGé"), rng.integers(0, 30))) for _ in range(2))
        assert X.edit_count(a, b) == edits_loop(a, b)
    want, pairs = {}, Views(spark, small).pairs().collect()
    for r in (r for r in pairs if r.present):
        a, b = r.seq, r.segmented_seq
        k = len(os.path.commonprefix([a, b]))
        a, b = a[k:], b[k:]
        k = len(os.path.commonprefix([a[::-1], b[::-1]]))  # what both share costs nothing
        want[r.readid] = edits_loop(a[: len(a) - k], b[: len(b) - k])
    assert {r.readid: r.edits for r in registry.QUERIES["e7_sequence_edits"](spark, small).collect()} == want
    counts = registry.QUERIES["g6_read_recovery_edits"](spark, small).first()
    assert counts.nt_changed == sum(want.values()) > 0 and counts.total == len(pairs)
    report = {r.metric: r.value for r in registry.QUERIES["e5_evaluate_reads"](spark, small).collect()}
    lengths = [len(r.segmented_seq) for r in pairs if r.present]
    assert report["nt_changed"] == counts.nt_changed and report["missing"] == len(pairs) - len(want)
    assert report["mean_length"] == pytest.approx(np.mean(lengths)) and report["max_length"] == max(lengths)


def test_znorm_rounds_written_halves_as_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from conftest import same

    values = [0.13671875, -0.13671875, 0.0099999, 0.0100001, 34234.85546875, 0.5, None, float("nan"), 1e38, *[k / 256 for k in range(-257, 257, 2)]]
    rows = spark.createDataFrame([(1, values, 0), (2, [], 1), (3, None, 1)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(entry.queries()["p2_znorm"](spark, str(tmp_path)), con, entry.oracle_sql()["p2_znorm"])


def test_random_controls_in_pieces(spark):
    """Regions that overlap, are empty, or longer than a piece: as each read by itself."""
    import hashlib

    reads = {1: (7, [(0, 25), (20, 31)]), 2: (3, [(5, 5)]), 3: (50, [(4, 9)]), 4: (0, [(0, 9)])}
    regions = spark.createDataFrame([(k, n, [{"start": a, "end": b} for a, b in own]) for k, (n, own) in reads.items()], "readid long, n_bases int, regions array<struct<start:long,end:long>>")
    rank = lambda k, b: (hashlib.md5(f"{k}|{b}|42".encode()).hexdigest(), b)
    want = {(k, b) for k, (n, own) in reads.items() for b in sorted({b for s, e in own for b in range(s, e)}, key=lambda b, k=k: rank(k, b))[:n]}
    for piece in (4, 10_000):
        rows = [tuple(r) for r in evaluate.random_controls(regions, piece=piece).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_low_complexity_makes_each_sequence_once(spark, small):
    import __spark_entry__ as entry

    plan = entry.queries()["f2_drop_low_complexity"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert [line.count("regexp_replace(") for line in plan.splitlines() if "Filter (" in line] == [1]
    rows = spark.createDataFrame([(1, "ACGT"), (2, ""), (3, None), (4, "AAC")], "readid long, seq string")
    assert [r.readid for r in filters.drop_low_complexity(rows, 0.3).collect()] == [1]


def test_edits_take_pairs_in_small_batches(spark, small):
    import __spark_entry__ as entry

    for name in ("e7_edits_after_lead", "e7_sequence_edits", "e5_evaluate_reads"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
