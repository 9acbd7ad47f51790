"""Reads side by side in lanes give what each gives by itself."""

import numpy as np
import pytest

from tracemill.operators import lanes, segment


def reads_of(seed, n, most=60):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        k = int(rng.integers(1, most))
        mu = rng.normal(0, 1, k)
        x = np.repeat(mu, rng.integers(2, 6, k)) + rng.normal(0, 0.3, 0 if k == 0 else 1)
        out.append((x + rng.normal(0, 0.3, len(x)), mu, np.full(k, 0.4) + rng.random(k) / 5))
    return sorted(out, key=lambda r: -len(r[0]))


@pytest.mark.parametrize("seed,n,band", [(0, 1, 400), (1, 2, 400), (2, 40, 400), (3, 40, 10), (4, 17, 3)])
def test_lanes_equal_single_reads(seed, n, band):
    reads = reads_of(seed, n)
    many = lanes.Lanes(reads, segment.PARAMS, band)
    for k, read in enumerate(reads):
        one, lane = segment.Lattice(*read, band=band), lanes.Lane(many, k)
        assert (lane.T, lane.N) == (one.T, one.N)
        if not np.isfinite(one.zf):
            assert not np.isfinite(lane.zf)
            continue
        assert lane.zf == pytest.approx(one.zf, abs=1e-9) and lane.zb == pytest.approx(one.zb, abs=1e-9)
        assert [(s, m) for s, m, _ in lane.path()] == [(s, m) for s, m, _ in one.path()]
        assert np.allclose([p for *_, p in lane.path()], [p for *_, p in one.path()])
        for a, b in zip(lane.sums(), one.sums(), strict=True):
            assert np.allclose(a, b)
        (_, p, _), (_, q, _) = next(lane.blocks()), next(one.blocks())
        assert np.allclose(np.exp(p[:, :, : one.W]), np.exp(q)) and not np.exp(p[:, :, one.W :]).any()


def test_groups_hold_every_read_once():
    rng = np.random.default_rng(1)
    sizes = [(int(t), int(t) // 3 + 1) for t in rng.integers(1, 400, 200)] + [(50_000, 10_000)]
    groups = list(lanes.dealt(sizes, 400, 20_000, 16))
    assert sorted(k for g, _ in groups for k in g) == list(range(201)) and all(len(g) <= 16 for g, _ in groups)
    assert ([200], True) in groups
    for g, alone in groups:
        lengths = [sizes[k][0] for k in g]
        assert lengths == sorted(lengths, reverse=True) and (alone or (lengths[0] + 1) * (2 * max(1, min(200, max((sizes[k][1] + 1) // 2 for k in g))) + 3) * len(g) <= 20_000 or len(g) == 1)


def test_a_large_read_goes_by_blocks(spark, monkeypatch):
    """The same segments whether the reads fit into lanes or are lattices of their own."""
    model = spark.createDataFrame([("AA", 0.0, 0.3), ("AC", 1.0, 0.3), ("CA", -1.0, 0.3), ("CC", 2.0, 0.3)], "kmer string, level_mean double, level_stdv double")
    rng = np.random.default_rng(3)
    rows = []
    for k in range(20):
        seq = "".join(rng.choice(list("AC"), int(rng.integers(2, 30))))
        levels = [{"AA": 0.0, "AC": 1.0, "CA": -1.0, "CC": 2.0}[seq[j : j + 2]] for j in range(len(seq) - 1)]
        rows.append((k, seq, (np.repeat(levels, 4) + rng.normal(0, 0.1, 4 * len(levels))).tolist()))
    rows.append((20, None, [1.0]))
    prepared = segment.prepare_reads(spark.createDataFrame(rows, "readid long, seq string, x array<double>"), model, 2)
    found = [sorted(map(tuple, segment.segment_reads(prepared, 2).drop("posterior_probability").collect()), key=repr)]
    one = segment._lattices
    batch = prepared.toArrow().combine_chunks().to_batches()[0]
    alone = {}
    monkeypatch.setattr(segment, "LANE_CELLS", 10)
    for group in one(batch, segment.PARAMS, segment.BAND):
        assert len(group) == 1 or group[0]["error"]
        alone |= {r["readid"]: [s for s, _, _ in r["lattice"].path()] for r in group if not r["error"]}
    starts = {}
    for r in found[0]:
        if r[-1] is None:
            starts.setdefault(r[0], []).append(r[2])
    assert {k: sorted(v) for k, v in starts.items()} == alone and len(alone) == 20
