"""The five-state lattice against a plain one with an edge list and against all paths, and on a signal with a changed k-mer."""

import math

import numpy as np
import pytest

from tracemill.functions import exprs as X
from tracemill.operators import polish, segment
from tracemill.operators.polish import STEPS, kmer_posteriors


def _hamming(a: int, b: int) -> int:
    x, n = a ^ b, 0
    while x:
        n += bool(x & 3)
        x >>= 2
    return n


def _likely(log_p: np.ndarray, mass: float) -> np.ndarray:
    order = np.argsort(-log_p, kind="stable")
    before = np.concatenate(([0.0], np.cumsum(np.exp(log_p[order]))[:-1]))
    return np.sort(order[before < mass])


class Polisher:
    """The same lattice with a dictionary of nodes and a list of edges, and cells of its own."""

    def __init__(self, x: np.ndarray, kmers: list[int], mean: np.ndarray, stdv: np.ndarray, k: int, params: dict[str, float], mass: float = 0.97797, simple: dict[str, float] = segment.PARAMS):
        self.k, self.T, self.N = k, len(x), len(kmers)
        z = (x[:, None] - mean) / stdv
        pdf = np.where(np.isfinite(mean), -0.5 * z * z - np.log(stdv) - X.LOG_2PI / 2, -np.inf)
        plain = segment.Lattice(x, mean[kmers], stdv[kmers], simple)
        pM, pE = plain.posteriors()
        by_position = np.logaddexp(pM, pE)[1:, 1:]
        by_kmer = kmer_posteriors(pdf, k, simple["m1"], simple["e2"])
        self.cells = {(0, 0, -1)}
        for t in range(self.T):
            likely = set(_likely(by_kmer[t], mass).tolist())
            for n in _likely(by_position[t], mass).tolist():
                self.cells |= {(t + 1, n + 1, q) for q in likely | {kmers[n]} if np.isfinite(pdf[t, q])}
        self._edges(pdf, kmers, params)
        self._sums()

    def _edges(self, pdf: np.ndarray, kmers: list[int], params: dict[str, float]) -> None:
        """Nodes and weighted edges, every edge after all edges into its source."""
        self.node: dict[tuple, int] = {((0, 0, -1), "E"): 0}
        self.edges: list[tuple[int, int, float]] = []
        quarter = 4 ** (self.k - 1)
        for cell in sorted(self.cells - {(0, 0, -1)}):
            t, n, q = cell
            score = pdf[t - 1, kmers[n - 1]] + pdf[t - 1, q] - 2 * _hamming(kmers[n - 1], q)
            for to, source, name, step, moves in STEPS:
                row = t if to == "I" else t - 1
                if row == 0:
                    sources = [(0, 0, -1)] if n == 1 and to == "A" else []  # any k-mer may be the first
                else:
                    sources = [(row, n - step, p) for p in ((q // 4 + b * quarter for b in range(4)) if moves else (q,))]
                for s in sources:
                    at = self.node.get((s, source))
                    if at is not None:
                        self.edges.append((at, self.node.setdefault((cell, to), len(self.node)), params[name] + score))
        self.ends = [v for (cell, s), v in self.node.items() if s == "E" and cell[:2] == (self.T, self.N)]

    def _sums(self) -> None:
        n = len(self.node)
        f, b = [-math.inf] * n, [-math.inf] * n
        f[0] = 0.0
        for u, v, w in self.edges:
            f[v] = _log_add(f[v], f[u] + w)
        for v in self.ends:
            b[v] = 0.0
        for u, v, w in reversed(self.edges):
            b[u] = _log_add(b[u], b[v] + w)
        self.zf, self.zb = -math.inf, b[0]
        for v in self.ends:
            self.zf = _log_add(self.zf, f[v])
        self.log_p = [x + y - self.zf if self.zf > -math.inf else -math.inf for x, y in zip(f, b, strict=True)]

    def path(self) -> list[tuple[str, int, int, int, float]]:
        """(state M or P, first sample, position, proposed k-mer, probability) of the segments of the best path."""
        best, back = [-math.inf] * len(self.node), [-1] * len(self.node)
        best[0] = 0.0
        for u, v, _ in self.edges:
            if best[u] + self.log_p[v] > best[v]:
                best[v], back[v] = best[u] + self.log_p[v], u
        if not self.ends:
            return []
        names = list(self.node)
        v = max(self.ends, key=lambda e: (best[e], names[e][0][2]))  # the later k-mer of equals
        line = []
        while v > 0:
            line.append(v)
            v = back[v]
        out: list[list] = []
        for v in reversed(line):
            (t, n, q), state = names[v]
            if state in "AP":
                out.append(["M" if state == "A" else "P", t - 1, n - 1, q, []])
            out[-1][4].append(math.exp(self.log_p[v]))
        return [(*s[:4], float(np.median(s[4]))) for s in out]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def all_paths(p: Polisher):
    out = {}
    for u, v, w in p.edges:
        out.setdefault(u, []).append((v, w))
    totals = []

    def walk(v, score, line):
        if v in p.ends:
            totals.append((score, line))
        for nxt, w in out.get(v, []):
            walk(nxt, score + w, [*line, nxt])

    walk(0, 0.0, [])
    return totals


def test_sums_and_path():
    rng = np.random.default_rng(3)
    params = {n: math.log(v) for n, v in polish.PROBABILITIES["rna004"].items()}
    mean, stdv = rng.normal(0, 1, 16), np.full(16, 0.6)
    for n in (1, 2, 3):
        kmers = [5, 6, 11][:n]  # CC CG GT: each a successor of the one before
        x = np.repeat(mean[kmers], 2) + rng.normal(0, 0.2, 2 * n)
        p = Polisher(x, kmers, mean, stdv, 2, params, mass=0.7)
        paths = all_paths(p)
        assert paths
        z = np.logaddexp.reduce([s for s, _ in paths])
        assert p.zf == pytest.approx(z) and p.zb == pytest.approx(z)
        assert sum(p.log_p[v] for v in max(paths, key=lambda q: sum(p.log_p[v] for v in q[1]))[1]) == pytest.approx(sum(p.log_p[v] for v in _best_nodes(p)))
        for t in range(1, len(x) + 1):  # each sample belongs to some cell
            own = [v for (cell, s), v in p.node.items() if cell[0] == t and s != "I"]
            assert sum(math.exp(p.log_p[v]) for v in own) == pytest.approx(1)


def _best_nodes(p):
    best, back = [-math.inf] * len(p.node), [-1] * len(p.node)
    best[0] = 0.0
    for u, v, _ in p.edges:
        if best[u] + p.log_p[v] > best[v]:
            best[v], back[v] = best[u] + p.log_p[v], u
    v, line = max(p.ends, key=lambda e: best[e]), []
    while v > 0:
        line.append(v)
        v = back[v]
    return line


@pytest.mark.parametrize("seed", range(8))
def test_arrays_equal_the_edge_list(seed):
    rng = np.random.default_rng(seed)
    params = {n: math.log(v) for n, v in polish.PROBABILITIES["rna004"].items()}
    mean, stdv = rng.normal(0, 1, 64), 0.3 + rng.random(64)
    kmers = [int(rng.integers(64))]
    for _ in range(int(rng.integers(0, 6))):
        kmers.append(kmers[-1] * 4 % 64 + int(rng.integers(4)))
    x = np.repeat(mean[kmers], rng.integers(2, 5, len(kmers))) + rng.normal(0, 0.3, 1)
    plain = Polisher(x, kmers, mean, stdv, 3, params, mass=[0.5, 0.9, 0.98][seed % 3])
    t, n, q = np.array(sorted(plain.cells - {(0, 0, -1)})).T
    mixed = rng.permutation(len(t))
    lattice = polish.Cells(x, np.array(kmers), (t - 1)[mixed], (n - 1)[mixed], q[mixed], mean, stdv, 3, params)
    assert lattice.zf == pytest.approx(plain.zf) and lattice.zb == pytest.approx(plain.zb)
    place = {c: k for k, c in enumerate(zip((lattice.t + 1).tolist(), (lattice.n + 1).tolist(), lattice.q.tolist(), strict=True))}
    for (cell, state), v in plain.node.items():
        if v and plain.log_p[v] > -30:
            assert lattice.log_p["APSEI".index(state), place[cell]] == pytest.approx(plain.log_p[v], abs=1e-6)
    a, b = lattice.path(), plain.path()
    assert [s[:4] for s in a] == [s[:4] for s in b] and [s[4] for s in a] == pytest.approx([s[4] for s in b])


def test_a_long_read_stays_small():
    import tracemalloc

    rng = np.random.default_rng(4)
    params = {n: math.log(v) for n, v in polish.PROBABILITIES["rna004"].items()}
    mean, stdv = rng.normal(0, 1, 1024), np.full(1024, 0.3)
    kmers = [0]
    for _ in range(1999):
        kmers.append(kmers[-1] * 4 % 1024 + int(rng.integers(4)))
    kmers = np.array(kmers)
    x = np.repeat(mean[kmers], 5) + rng.normal(0, 0.1, 10_000)
    t = np.repeat(np.arange(10_000), 20)
    n = np.clip(t // 5 + np.tile(np.repeat([-1, 0, 1, 0], 5), 10_000), 0, 1999)
    q = np.where(np.tile(np.arange(20), 10_000) % 5 == 0, kmers[n], rng.integers(0, 1024, len(t)))
    t, n, q = np.unique(np.stack((t, n, q)), axis=1)
    tracemalloc.start()
    lattice = polish.Cells(x, kmers, t, n, q, mean, stdv, 5, params)
    found = lattice.path()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) >= 1990 and abs(lattice.zf - lattice.zb) < 1e-3 and peak < 100 << 20


def test_polish_reads(spark):
    from tracemill.operators import segment

    levels = {a + b: 2.0 * ("ACGT".index(a) * 4 + "ACGT".index(b)) / 5 - 3 for a in "ACGT" for b in "ACGT"}
    model = spark.createDataFrame([(k, v, 0.2) for k, v in levels.items()], "kmer string, level_mean double, level_stdv double")
    seq = "ACGTTGCA"
    x = [v + 0.01 * j for k in range(7) for j, v in enumerate([levels[seq[k : k + 2]]] * 4)]
    reads = spark.createDataFrame([(1, seq, x), (2, "A", x)], "readid long, seq string, x array<double>")
    rows = polish.polish_reads(segment.prepare_reads(reads, model, 2), model, 2).collect()
    good = sorted((r.start, r.motif, r.polish, r.state) for r in rows if r.readid == 1)
    assert [g[1] for g in good if g[3] == "M"] == [seq[k : k + 2] for k in range(7)]
    assert all(g[1] == g[2] for g in good)
    assert [r.error for r in rows if r.readid == 2] == ["sequence shorter than k-mer"]


def test_kmer_posteriors_against_all_walks(spark):
    import itertools

    rng = np.random.default_rng(3)
    names = ["".join(p) for p in itertools.product("ACGT", repeat=1)]
    level = dict(zip(names, (-1.0, -0.2, 0.5, 1.3), strict=True))
    x = rng.normal(size=5)
    model = spark.createDataFrame([(n, v, 0.6) for n, v in level.items()], "kmer string, level_mean double, level_stdv double")
    reads = spark.createDataFrame([(1, "AC", x.tolist())], "readid long, seq string, x array<double>")
    prepared = segment.prepare_reads(reads, model, 1, window=99)
    got = {(r.t, r.kmer): r.p for r in polish.kmer_posterior_rows(prepared, model, 1, 0.0).collect()}
    p, total, own = segment.PARAMS, 0.0, {}
    for states in itertools.product(names, repeat=5):
        for cuts in itertools.product((0, 1), repeat=4):  # where a next k-mer begins
            borders = [k + 1 for k, c in enumerate(cuts) if c]
            runs = list(itertools.pairwise([0, *borders, 5]))
            if any(len(set(states[a:b])) > 1 for a, b in runs) or any(b - a < 2 for a, b in runs[1:]):
                continue
            score = sum(-0.5 * ((v - level[s]) / 0.6) ** 2 for v, s in zip(x, states, strict=True))
            score += (len(runs) - 1) * p["m1"] + p["e2"] * sum(b - a - 2 for a, b in runs[1:])
            first = runs[0][1]  # goes on from before the signal, or is entered from one of four
            weight = math.exp(score) * (math.exp(p["e2"] * first) + (4 * math.exp(p["m1"] + p["e2"] * (first - 2)) if first > 1 else 0))
            total += weight
            for t, s in enumerate(states):
                own[t, s] = own.get((t, s), 0.0) + weight
    assert all(abs(v - own.get(k, 0.0) / total) < 1e-6 for k, v in got.items())


def test_lanes_equal_single_reads():
    rng = np.random.default_rng(11)
    params = {n: math.log(v) for n, v in polish.PROBABILITIES["rna004"].items()}
    mean, stdv, reads = rng.normal(0, 1, 64), 0.3 + rng.random(64), []
    for size in (5, 1, 3, 5):
        kmers = [int(rng.integers(64))]
        for _ in range(size - 1):
            kmers.append(kmers[-1] * 4 % 64 + int(rng.integers(4)))
        x = np.repeat(mean[kmers], rng.integers(2, 5, size)) + rng.normal(0, 0.3, 1)
        cells = np.array(sorted(Polisher(x, kmers, mean, stdv, 3, params, mass=0.9).cells - {(0, 0, -1)})).T
        reads.append((x, np.array(kmers), cells[0] - 1, cells[1] - 1, cells[2]))
    reads.append((reads[0][0], reads[0][1], *(np.zeros(0, np.int64),) * 3))  # no cells: no path
    lanes = polish.CellLanes(reads, mean, stdv, 3, params)
    for k, read in enumerate(reads):
        alone = polish.Cells(*read, mean, stdv, 3, params)
        assert lanes.zf[k] == pytest.approx(alone.zf, abs=1e-9) and lanes.zb[k] == pytest.approx(alone.zb, abs=1e-9)
        assert [s[:4] for s in lanes.path(k)] == [s[:4] for s in alone.path()] and bool(alone.path()) == bool(len(read[2]))
        assert [s[4] for s in lanes.path(k)] == pytest.approx([s[4] for s in alone.path()])


def test_kmer_lanes_in_blocks():
    """Reads of unlike length side by side, and a read in blocks of three samples, as each read by itself."""
    rng = np.random.default_rng(5)
    scores = [rng.normal(-200, 200, (n, 16)) for n in (11, 7, 1)]
    scores[1][:, 3] = -np.inf
    lanes = polish.KmerLanes([11, 7, 1], lambda t, n: np.maximum(np.stack([s[t] for s in scores[:n]]), -1e300), 16, -0.7, -0.4)
    for rows in (3, 100):
        got = np.concatenate([p for _, p in lanes.blocks(rows)][::-1])
        for k, s in enumerate(scores):
            fM, fE = np.full(16, -np.inf), np.zeros(16)
            ahead = []
            with np.errstate(invalid="ignore"):
                for v in s:
                    before = np.logaddexp.reduce(fE.reshape(4, 4), axis=0)
                    fM, fE = before[np.arange(16) >> 2] + v - 0.7, np.logaddexp(fM, fE - 0.4) + v
                    ahead.append((fM, fE))
                bM, bE = np.full(16, -np.inf), np.zeros(16)
                for t in range(len(s) - 1, -1, -1):
                    want = np.logaddexp(ahead[t][0] + bM, ahead[t][1] + bE)
                    assert got[t, k] == pytest.approx(np.exp(want - np.logaddexp.reduce(want)), abs=1e-12)
                    after = np.logaddexp.reduce((bM + s[t] - 0.7).reshape(4, 4), axis=1)
                    bM, bE = bE + s[t], np.logaddexp(after[np.arange(16) % 4], bE + s[t] - 0.4)
            assert not got[len(s) :, k].any()


def test_pruned_kmers_and_cells_as_by_rows(spark):
    levels = {a + b: 2.0 * ("ACGT".index(a) * 4 + "ACGT".index(b)) / 5 - 3 for a in "ACGT" for b in "ACGT"}
    model = spark.createDataFrame([(k, v, 0.9) for k, v in levels.items()], "kmer string, level_mean double, level_stdv double")
    rng = np.random.default_rng(2)
    reads = spark.createDataFrame([(j, "ACGTTGCA"[: 8 - j], (rng.normal(0, 1, 20 + j)).tolist()) for j in range(4)], "readid long, seq string, x array<double>")
    prepared = segment.prepare_reads(reads, model, 2)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    whole = polish.kmer_posterior_rows(prepared, model, 2, 0.001)
    assert rows(polish.kmer_posterior_rows(prepared, model, 2, 0.001, mass=0.9), "readid", "t", "kmer", "p") == rows(polish.prune_kmers(whole, 0.9), "readid", "t", "kmer", "p")
    positions = polish.prune_positions(segment.posterior_rows(prepared, 0.1 / (2 * segment.BAND), k=2), 0.9)
    kmers = polish.prune_kmers(polish.kmer_posterior_rows(prepared, model, 2, 0.1 / 32), 0.9)
    own = prepared.where("error IS NULL").selectExpr("readid", "explode(sequence(0, length(seq) - 2)) AS n", "seq").selectExpr("readid", "n", "substring(seq, n + 1, 2) AS kmer")
    want = {(r.readid, r.t, r.n * 16 + polish._number(r.kmer)) for r in polish.candidate_cells(positions, kmers, own).collect()}
    got = [(r.readid, s.t, c) for r in polish.likely_cells(prepared, model, 2, 0.9).collect() for s in r.cells for c in s.own]
    assert len(got) == len(set(got)) and set(got) == want
