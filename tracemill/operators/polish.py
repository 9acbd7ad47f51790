"""Segmentation that proposes a k-mer of its own for each stretch of samples, for models of up to five letters.

The lattice has cells (sample, sequence position, proposed k-mer) and five states: A enters the next
position with a successor k-mer, P stays with a successor k-mer, S enters the next position with
the same k-mer, E goes on, I skips a position without a sample. Only likely cells are kept: positions
and k-mers of each sample that hold most of the posterior of two simpler models.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import segment
from tracemill.operators.windows import top_mass
from tracemill.sources.scratch import scratch

#: Share of the posterior that the kept positions, or k-mers, of a sample hold.
MASS = 0.97797

# Transition probabilities of the five states, by pore type.
PROBABILITIES = {
    "rna002": {
        "a1": 0.019326040280789637, "a2": 0.19725479693713352, "p1": 0.1979799841413514, "p2": 0.0006135538271005425, "p3": 0.7669801909288386,
        "s1": 0.27034500789657623, "s2": 0.00032463686748883153, "s3": 0.02916688206070035, "e1": 1.0, "e2": 0.7296549921055607,
        "e3": 0.8020200158564497, "e4": 0.9797333838008437, "i1": 2.3852272324574183e-06, "i2": 0.006598130068516047,
    },
    "rna004": {
        "a1": 0.029709838889618322, "a2": 0.2837864344979079, "p1": 0.15353628902814298, "p2": 0.0041495012884881655, "p3": 0.47456322874771467,
        "s1": 0.05012685122100474, "s2": 0.0006112333189296363, "s3": 0.13506593503589423, "e1": 1.0, "e2": 0.949873148779652,
        "e3": 0.8464637109688202, "e4": 0.9654529072452087, "i1": 7.651926003806137e-05, "i2": 0.10658440170772512,
    },
}

#: (to, from, transition, position step, whether the k-mer moves to a successor); all but I take a sample.
STEPS = [
    ("A", "E", "a1", 1, True), ("A", "I", "a2", 1, True), ("P", "S", "p1", 0, True), ("P", "E", "p2", 0, True), ("P", "I", "p3", 0, True), ("S", "P", "s1", 1, False), ("S", "E", "s2", 1, False),
    ("S", "I", "s3", 1, False), ("E", "A", "e1", 0, False), ("E", "P", "e2", 0, False), ("E", "S", "e3", 0, False), ("E", "E", "e4", 0, False), ("I", "E", "i1", 1, False), ("I", "I", "i2", 1, False),
]


def _number(kmer: str) -> int:
    out = 0
    for c in kmer:
        out = out * 4 + "ACGT".index(c)
    return out


def _kmer(number: int, k: int) -> str:
    return "".join("ACGT"[number >> 2 * j & 3] for j in range(k - 1, -1, -1))


#: Samples of reads whose k-mer posteriors are computed together, and at once of a long read; cells of five-state lattices computed together.
KMER_ROWS, LANE_CELLS = 1024, 200_000
#: Stands for log 0 where sums must stay finite.
_NEVER = -1e300


def _log_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high, out = np.maximum(a, b), np.minimum(a, b)
    out -= high
    np.exp(out, out=out)
    out += 1
    np.log(out, out=out)
    out += high
    return out


def _log_sum_4(parts: list[np.ndarray]) -> np.ndarray:
    """Log of the summed exponentials of four arrays of finite scores."""
    high = np.maximum(np.maximum(parts[0], parts[1]), np.maximum(parts[2], parts[3]))
    out = np.zeros_like(high)
    for v in parts:
        v = v - high
        np.exp(v, out=v)
        out += v
    np.log(out, out=out)
    out += high
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    """Log of the summed exponentials; minus infinity of nothing else."""
    high = a.max(axis=axis, keepdims=True)
    high = np.where(high > -np.inf, high, 0.0)
    return np.log(np.exp(a - high).sum(axis=axis)) + high.squeeze(axis)


class KmerLanes:
    """Posteriors of each sample's k-mer, whatever the sequence, of reads side by side: ``score(row, lanes)`` gives
    the log densities (lane, k-mer) of a sample of the first lanes. Reads come longest first; ``blocks`` gives the rows' probabilities
    (row, lane, k-mer) from the last block to the first, of which a long read's are computed one after the other."""

    def __init__(self, sizes: list[int], score: Callable[[int, int], np.ndarray], size: int, match: float, extend: float):
        self.T, self.score, self.size, self.match, self.extend = np.array(sizes), score, size, match, extend
        self.lanes = np.searchsorted(-self.T, -np.arange(self.T[0] + 1), "left")  # that have a sample of this number, or a later one

    def _ahead(self, first: int, rows: int, start: np.ndarray) -> np.ndarray:
        """Forward scores (row, M and E, lane, k-mer) of the borders from ``first`` on; the first one's are given."""
        out = np.full((rows, *start.shape), _NEVER)
        out[0] = start
        for j in range(1, rows):
            n = self.lanes[first + j - 1]
            (m, e), s = out[j - 1, :, :n], self.score(first + j - 1, n)
            quarter = self.size // 4
            before = _log_sum_4([e[:, b * quarter : (b + 1) * quarter] for b in range(4)])
            before += self.match
            np.add(before[:, :, None], s.reshape(n, quarter, 4), out=out[j, 0].reshape(-1, quarter, 4)[:n])
            np.add(_log_plus(m, e + self.extend), s, out=out[j, 1, :n])
        return out

    def blocks(self, rows: int = KMER_ROWS) -> Iterator[tuple[int, np.ndarray]]:
        most, lanes = int(self.T[0]), len(self.T)
        start = np.full((2, lanes, self.size), _NEVER)
        start[1] = 0.0
        kept = [start]
        for a in range(0, max(most - rows, 0), rows):
            kept.append(self._ahead(a, rows + 1, kept[-1])[-1].copy())
        after, quarter = np.full((2, lanes, self.size), _NEVER), self.size // 4
        for k in range(len(kept) - 1, -1, -1):
            a, b = k * rows, min((k + 1) * rows, most)
            both = self._ahead(a, b - a + 1, kept[k])[1:]
            for r in range(b, a, -1):
                n, more = self.lanes[r - 1], self.lanes[r] if r < most else 0
                after[1, more:n] = 0.0  # reads that end here
                if more:
                    (m, e), s = after[:, :more], self.score(r, more)
                    m += s
                    e += s
                    enter = _log_sum_4([m[:, b::4] for b in range(4)])
                    enter += self.match
                    stay = e + self.extend
                    m[:] = e
                    for b in range(0, self.size, quarter):
                        e[:, b : b + quarter] = _log_plus(enter, stay[:, b : b + quarter])
                both[r - a - 1, :, :n] += after[:, :n]
            high = both.max(axis=(1, 3), keepdims=True)
            both -= high
            np.exp(both, out=both)
            p = both[:, 0] + both[:, 1]
            p /= p.sum(axis=2, keepdims=True)
            p[high[:, 0, :, 0] < _NEVER / 2] = 0.0  # nothing is possible, or the read has no such sample
            yield a, p


def kmer_posteriors(score: np.ndarray, k: int, match: float, extend: float) -> np.ndarray:
    """Log posterior of each k-mer by sample when any successor may follow: no sequence is given."""
    lanes = KmerLanes([len(score)], lambda t, _: np.maximum(score[t], _NEVER)[None], score.shape[1], match, extend)
    with np.errstate(divide="ignore"):
        return np.log(np.concatenate([p[:, 0] for _, p in lanes.blocks()][::-1])) if len(score) else score


_STATE = {name: k for k, name in enumerate("APSEI")}
#: Kinds of sources: in the row before the position before by the first letter of the k-mer (0 to 3), the same position by it (4 to 7),
#: the same k-mer at the position before (8) and at the same one (9).
_KINDS = {(1, True): (0, 1, 2, 3), (0, True): (4, 5, 6, 7), (1, False): (8,), (0, False): (9,)}


class CellLanes:
    """The five-state lattices of some reads ``(x, kmers, t, n, q)`` over their candidate cells, as sorted arrays.

    Cells (sample, read, position, proposed k-mer) are sorted; a sample's cells of all reads are a row, and all
    sources of all cells are found by binary search at once. Scores are held for the cells only, five numbers
    each; the last place of an array, minus infinity, stands for a cell that isn't there.
    """

    def __init__(self, reads: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], mean: np.ndarray, stdv: np.ndarray, k: int, params: dict[str, float]):
        size, quarter, self.params = 4**k, 4 ** (k - 1), params
        self.samples = np.array([len(x) for x, *_ in reads])
        lane = np.repeat(np.arange(len(reads)), [len(t) for _, _, t, _, _ in reads])
        t, n, q = (np.concatenate([r[c] for r in reads]) for c in (2, 3, 4))
        x, own = (np.concatenate([r[0][r[2]] for r in reads]), np.concatenate([r[1][r[3]] for r in reads]))
        last = np.array([len(r[1]) - 1 for r in reads])
        width = int(last.max()) + 2  # no position is before the first
        order = np.lexsort((q, n, lane, t))
        self.t, self.lane, self.n, self.q, x, own = (v[order] for v in (t, lane, n, q, x, own))
        self.row = np.searchsorted(self.t, np.arange(int(self.samples.max()) + 1))
        row_step, place = len(reads) * width * size, (self.lane * width + self.n + 1) * size
        key = self.t * row_step + place + self.q
        differ = own ^ self.q
        pdf = lambda m: -0.5 * ((x - mean[m]) / stdv[m]) ** 2 - np.log(stdv[m]) - X.LOG_2PI / 2
        self.count = len(key)
        self.score = np.r_[pdf(own) + pdf(self.q) - 2.0 * np.bitwise_count((differ | differ >> 1) & 0x5555555555555555), 0.0]
        self.ends = np.flatnonzero((self.t == self.samples[self.lane] - 1) & (self.n == last[self.lane]))
        self._sources(key, row_step, place, size, quarter)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.ahead = self._forward()
            self.zf = self._by_lane(self.ahead[_STATE["E"], self.ends], self.ends)
            self.back = self._backward()
            first = np.flatnonzero((self.t == 0) & (self.n == 0))
            self.zb = self._by_lane(self.back[0, first] + self.score[first] + params["a1"], first)
            self.log_p = np.where(self.zf[self.lane] > -np.inf, (self.ahead + self.back)[:, :-1] - self.zf[self.lane], -np.inf)

    def _sources(self, key: np.ndarray, row_step: int, place: np.ndarray, size: int, quarter: int) -> None:
        """Where each cell's sources and targets are, by kind, and the order of the I states within a row."""

        def find(want: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            return np.where(key[at] == want, at, self.count).astype(np.int32) if len(key) else want.astype(np.int32)

        before = self.t * row_step + place - row_step
        moved = [self.q // 4 + b * quarter for b in range(4)]
        self.sources = np.stack([find(before - size + m) for m in moved] + [find(before + m) for m in moved] + [find(before - size + self.q), find(before + self.q)])
        self.targets = np.full((10, self.count + 1), self.count, np.int32)
        cells = np.arange(self.count, dtype=np.int32)
        for kind, at in enumerate(self.sources):
            to = kind // 4 * 4 + self.q % 4 if kind < 8 else kind  # of a cell's targets, by the last letter
            self.targets[to, at] = cells
        self.targets[:, self.count] = self.count
        self.beside = find(key - size)  # the position before, of the same sample, with the same k-mer
        first = np.r_[True, (np.diff(self.t) != 0) | (np.diff(self.lane) != 0)] if self.count else np.zeros(0, bool)
        rank = np.cumsum(np.r_[True, np.diff(key // size) != 0]) if self.count else np.zeros(0, np.int64)
        rank = rank - np.maximum.accumulate(np.where(first, rank, 0))
        self.skips: list[list[np.ndarray]] = []
        for a, b in zip(self.row[:-1], self.row[1:], strict=True):
            there = a + np.flatnonzero(self.beside[a:b] < self.count)
            there = there[np.argsort(rank[there], kind="stable")]
            self.skips.append(np.split(there, np.flatnonzero(np.diff(rank[there])) + 1) if len(there) else [])

    def _by_lane(self, values: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.full(len(self.samples), -np.inf)
        np.logaddexp.at(out, self.lane[cells], values)
        return out

    def _empty(self) -> np.ndarray:
        return np.full((5, self.count + 1), -np.inf)

    def _forward(self) -> np.ndarray:
        out, p = self._empty(), self.params
        for r, (a, b) in enumerate(zip(self.row[:-1], self.row[1:], strict=True)):
            if r == 0:  # any k-mer may be the first
                out[0, a:b] = np.where(self.n[a:b] == 0, p["a1"], -np.inf)
            else:
                for to in "APSE":
                    out[_STATE[to], a:b] = _log_sum(np.concatenate([out[_STATE[source]][self.sources[list(_KINDS[step, moves]), a:b]] + p[name] for own, source, name, step, moves in STEPS if own == to]), 0)
            out[:4, a:b] += self.score[a:b]
            for own in self.skips[r]:
                at = self.beside[own]
                out[4, own] = np.logaddexp(out[3, at] + p["i1"], out[4, at] + p["i2"]) + self.score[own]
        return out

    def _backward(self) -> np.ndarray:
        out, p = self._empty(), self.params
        ends = np.zeros(self.count + 1, bool)
        ends[self.ends] = True
        for r in range(len(self.row) - 2, -1, -1):
            a, b = self.row[r], self.row[r + 1]
            if r < len(self.row) - 2:
                for source in "APSEI":
                    parts = []
                    for to, own, name, step, moves in STEPS:
                        if own == source and to != "I":
                            at = self.targets[list(_KINDS[step, moves]), a:b]
                            parts.append(out[_STATE[to]][at] + self.score[at] + p[name])
                    out[_STATE[source], a:b] = _log_sum(np.concatenate(parts), 0)
            out[3, a:b][ends[a:b]] = 0.0
            for own in reversed(self.skips[r]):
                value, at = out[4, own] + self.score[own], self.beside[own]
                for s, name in ((3, "i1"), (4, "i2")):
                    out[s, at] = np.logaddexp(out[s, at], value + p[name])
        return out

    @cached_property
    def _best(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each state the best sum of log posteriors of a path to it, and the state before (state times cells plus cell; -1 at the start)."""
        best, back = self._empty(), np.full((5, self.count + 1), -1, np.int64)
        for r, (a, b) in enumerate(zip(self.row[:-1], self.row[1:], strict=True)):
            if r == 0:
                best[0, a:b] = np.where(self.n[a:b] == 0, 0.0, -np.inf)
            else:
                for to in "APSE":
                    steps = [(_STATE[source], self.sources[list(_KINDS[step, moves]), a:b]) for own, source, _, step, moves in STEPS if own == to]
                    value, at = np.concatenate([best[s][places] for s, places in steps]), np.concatenate([s * self.count + places.astype(np.int64) for s, places in steps])
                    pick = value.argmax(axis=0), np.arange(b - a)  # the first of equals
                    best[_STATE[to], a:b], back[_STATE[to], a:b] = value[pick], np.where(value[pick] > -np.inf, at[pick], -1)
            best[:4, a:b] += self.log_p[:4, a:b]
            for own in self.skips[r]:
                at = self.beside[own]
                e, i = best[3, at], best[4, at]
                value = np.maximum(e, i)
                best[4, own], back[4, own] = value + self.log_p[4, own], np.where(value > -np.inf, np.where(i > e, 4, 3) * self.count + at.astype(np.int64), -1)
        return best, back[:, :-1].ravel()

    def path(self, lane: int) -> list[tuple[str, int, int, int, float]]:
        """(state M or P, first sample, position, proposed k-mer, probability) of the segments of a read's best path."""
        with np.errstate(invalid="ignore"):
            (best, back), n = self._best, self.count
        good = [v for v in self.ends[self.lane[self.ends] == lane] if best[3, v] > -np.inf]
        if not good:
            return []
        at, line = 3 * n + int(max(good, key=lambda v: (best[3, v], self.q[v]))), []  # the later k-mer of equals
        while at >= 0:
            line.append(at)
            at = int(back[at])
        line = np.array(line[::-1])
        p, (state, cell) = np.exp(self.log_p.ravel()[line]).tolist(), np.divmod(line, n)
        begin = np.flatnonzero(state < 2)
        own = cell[begin]
        names = ["MP"[s] for s in state[begin]]
        ends = [*begin[1:].tolist(), len(line)]
        middle = [median(p[a:b]) for a, b in zip(begin.tolist(), ends, strict=True)]
        return list(zip(names, self.t[own].tolist(), self.n[own].tolist(), self.q[own].tolist(), middle, strict=True))


class Cells(CellLanes):
    """The lattice of one read."""

    def __init__(self, x: np.ndarray, kmers: np.ndarray, t: np.ndarray, n: np.ndarray, q: np.ndarray, mean: np.ndarray, stdv: np.ndarray, k: int, params: dict[str, float]):
        super().__init__([(x, kmers, t, n, q)], mean, stdv, k, params)
        self.zf, self.zb = float(self.zf[0]), float(self.zb[0])

    def path(self) -> list[tuple[str, int, int, int, float]]:
        return super().path(0)


def prune_positions(posteriors: DataFrame, mass: float = MASS) -> DataFrame:
    """Of ``(readid, t, n, p)`` the likeliest positions of each sample that hold ``mass``."""
    return top_mass(posteriors, ["readid", "t"], F.lit(mass), "p", "n")


def _kmer_lanes(batch: pa.RecordBatch, mean: np.ndarray, stdv: np.ndarray, params: dict[str, float], min_p: float, mass: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the batch, sample, k-mer number, posterior) of at least ``min_p``, likeliest first, of each sample until they hold ``mass``."""
    size = len(mean)
    good = [k for k, error in enumerate(batch.column("error").to_pylist()) if error is None]
    xs = {k: batch.column("x")[k].values.to_numpy(zero_copy_only=False).astype(float) for k in good}
    const = np.where(np.isfinite(mean), -np.log(stdv) - X.LOG_2PI / 2, _NEVER)
    levels = np.where(np.isfinite(mean), mean, 0.0)
    good, at = sorted((k for k in good if len(xs[k])), key=lambda k: -len(xs[k])), 0
    while at < len(good):
        own = np.array(good[at : at + max(1, KMER_ROWS // len(xs[good[at]]))])
        at += len(own)
        x = np.zeros((len(xs[own[0]]), len(own)))
        for j, k in enumerate(own):
            x[: len(xs[k]), j] = xs[k]
        score = lambda t, n: const - 0.5 * ((x[t, :n, None] - levels) / stdv) ** 2  # noqa: E731, B023
        for first, p in KmerLanes([len(xs[k]) for k in own], score, size, params["m1"], params["e2"]).blocks():
            r, q = np.nonzero(p.reshape(-1, size) >= min_p)
            value = p.reshape(-1, size)[r, q]
            order = np.lexsort((q, -value, r))
            r, q, value = r[order], q[order], value[order]
            if mass < 1:
                count = np.bincount(r, minlength=p.shape[0] * p.shape[1])
                place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
                held = np.zeros((len(count), int(count.max(initial=0)) + 1))
                held[r, place + 1] = value
                keep = np.cumsum(held, axis=1)[r, place] < mass
                r, q, value = r[keep], q[keep], value[keep]
            yield own[r % len(own)], first + r // len(own), q, value


def kmer_posterior_rows(prepared: DataFrame, model: DataFrame, k: int = 5, min_p: float = 0.001, params: dict[str, float] = segment.PARAMS, mass: float = 1, packed: bool = False) -> DataFrame:
    """Sparse ``(readid, t, kmer, p)``: posteriors of each sample's k-mer when no sequence is given, of at least ``min_p``.

    With ``mass`` below 1 only the rows that ``prune_kmers`` leaves: a sample's posteriors are all in one place
    when they are computed, and most of them are beyond the mass. ``packed`` gives ``(readid, t, qs)``, a row for each
    sample with the numbers of its k-mers.
    """
    mean, stdv = _levels(model, k)
    kind = prepared.schema["readid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([_kmer(q, k) for q in range(4**k)])
        for batch in batches:
            for own, t, q, p in _kmer_lanes(batch, mean, stdv, params, min_p, mass):
                if packed:
                    begin = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(t) != 0)]) if len(t) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(t)].astype(np.int32)), pa.array(q.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("readid").take(pa.array(own[begin])), pa.array(t[begin].astype(np.int32)), lists], ["readid", "t", "qs"])
                    continue
                yield pa.RecordBatch.from_arrays([batch.column("readid").take(pa.array(own)), pa.array(t.astype(np.int32)), names.take(pa.array(q)), pa.array(p)], ["readid", "t", "kmer", "p"])

    return segment.spread(prepared).mapInArrow(run, f"readid {kind}, t int, " + ("qs array<int>" if packed else "kmer string, p double"))


def prune_kmers(posteriors: DataFrame, mass: float = MASS) -> DataFrame:
    """Of ``(readid, t, kmer, p)`` the likeliest k-mers of each sample that hold ``mass``; ``kmer_posterior_rows`` can leave the others out itself."""
    return top_mass(posteriors, ["readid", "t"], F.lit(mass), "p", "kmer")


def candidate_cells(positions: DataFrame, kmers: DataFrame, own: DataFrame) -> DataFrame:
    """``(readid, t, n, kmer)``: likely positions of a sample with its likely k-mers, and with the position's own k-mer.

    From ``positions(readid, t, n)``, ``kmers(readid, t, kmer)`` and ``own(readid, n, kmer)``; each cell once.
    """
    likely = positions.select("readid", "t", "n").join(kmers.select("readid", "t", "kmer"), ["readid", "t"])
    given = positions.select("readid", "t", "n").join(own.select("readid", "n", "kmer"), ["readid", "n"])
    return likely.select("readid", "t", "n", "kmer").unionByName(given.select("readid", "t", "n", "kmer")).distinct()


def _levels(model: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations by k-mer number; at most 4^5 of them."""
    if k > 5:
        raise ValueError("models of more than five letters have too many states")
    mean, stdv = np.full(4**k, np.nan), np.ones(4**k)
    rows = model.select("kmer", "level_mean", "level_stdv").limit(4**k + 1).collect()
    if len(rows) > 4**k or len({r.kmer for r in rows}) < len(rows):
        raise ValueError("the model has more rows than k-mers")
    for row in rows:
        mean[_number(row.kmer)], stdv[_number(row.kmer)] = row.level_mean, row.level_stdv
    return mean, stdv


def likely_cells(prepared: DataFrame, model: DataFrame, k: int = 5, mass: float = MASS) -> DataFrame:
    """``(readid, cells)``: the cells ``n * 4^k + q`` of each sample ``t`` of a read's lattice, from the likely positions and k-mers.

    ``cells`` is an array of ``(t, own)``. The same cells as of ``candidate_cells``, a row for each read: what is
    joined by sample are the arrays of its positions and of its k-mers, not the cells. Posteriors are taken down to a size at which
    all that is left out is less than what ``mass`` leaves.
    """
    positions = prune_positions(segment.posterior_rows(prepared, (1 - mass) / (2 * segment.BAND), k=k), mass).groupBy("readid", "t").agg(F.collect_list("n").alias("ns"))
    kmers = kmer_posterior_rows(prepared, model, k, (1 - mass) / (2 * 4**k), mass=mass, packed=True)
    n = segment.tasks(prepared.sparkSession)
    samples = positions.join(kmers, ["readid", "t"], "left").repartition(n, "readid").groupBy("readid").agg(F.collect_list(F.struct("t", "ns", F.coalesce("qs", F.array().cast("array<int>")).alias("qs"))).alias("s"))
    given = F.transform(X.kmers(F.col("seq"), k), lambda m: X.kmer_to_int(m).cast("int"))
    rows = prepared.where("error IS NULL").select("readid", given.alias("given")).repartition(n, "readid").join(samples, "readid")
    of = lambda s: F.flatten(F.transform(s["ns"], lambda n: F.transform(F.array_union(s["qs"], F.array(F.get("given", n))), lambda q: n.cast("long") * 4**k + q)))
    return rows.select("readid", F.transform("s", lambda s: F.struct(s["t"].alias("t"), of(s).alias("own"))).alias("cells"))


def polish_reads(prepared: DataFrame, model: DataFrame, k: int = 5, pore: str = "rna004", mass: float = MASS) -> DataFrame:
    """``(readid, start, end, basepos, motif, state, posterior_probability, polish, error)``.

    As ``segment_reads``, with the proposed k-mer in ``polish`` and state P where the k-mer moved on
    within a position. Spark makes the candidate cells; a task runs the recurrences over those of some
    reads at once. Reads are stored under a number of their own first, so repeated or null readids are reads like any
    other. The model has at most 4^5 rows and goes to every task.
    """
    params = {n: math.log(p) for n, p in PROBABILITIES[pore].items()}
    mean, stdv = _levels(model, k)
    path = scratch(prepared.sparkSession, "polish")
    prepared.withColumn("uid", F.monotonically_increasing_id()).write.parquet(path)
    stored = prepared.sparkSession.read.schema(prepared.withColumn("uid", F.lit(0).cast("long")).schema).parquet(path)
    cells = likely_cells(stored.withColumn("readid", F.col("uid")), model, k, mass)
    rows = stored.select("uid", "readid", "seq", "x", "error").repartition(segment.tasks(stored.sparkSession), "uid").join(cells.select(F.col("readid").alias("uid"), "cells"), "uid", "left").drop("uid")
    kind = prepared.schema["readid"].dataType.simpleString()

    def lattices(batch: pa.RecordBatch, good: list[int], seqs: list[str]) -> Iterator[tuple[list[int], CellLanes]]:
        """The good rows of a batch in groups of like length, with the lattice of each group."""
        reads = {}
        sizes = {j: len(batch.column("x")[j].values) for j in good}
        group: list[int] = []
        held = 0
        for j in [*sorted(good, key=lambda j: -sizes[j]), None]:
            if j is not None:
                own = batch.column("cells")[j].values
                t, lists = (own.field("t").to_numpy().astype(np.int64), own.field("own")) if own is not None else (np.zeros(0, np.int64), pa.array([], pa.list_(pa.int64())))
                keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                t = np.repeat(t, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                kmers = np.array([_number(seqs[j][i : i + k]) for i in range(len(seqs[j]) - k + 1)])
                reads[j] = batch.column("x")[j].values.to_numpy(zero_copy_only=False).astype(float), kmers, t, keys // 4**k, keys % 4**k
            if group and (j is None or held + len(reads[j][2]) > LANE_CELLS):
                yield group, CellLanes([reads.pop(g) for g in group], mean, stdv, k, params)
                group, held = [], 0
            if j is not None:
                group.append(j)
                held += len(reads[j][2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["readid", "start", "end", "basepos", "motif", "state", "posterior_probability", "polish", "error"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()]

        def table(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([batch.column("readid").take(pa.array(c[0])), *[pa.array(v, t) for v, t in zip(c[1:], types, strict=True)]], names)

        for batch in batches:
            seqs, errors = batch.column("seq").to_pylist(), batch.column("error").to_pylist()
            if bad := [(j, *[None] * 7, e) for j, e in enumerate(errors) if e is not None]:
                yield table(batch, bad)
            for group, lattice in lattices(batch, [j for j, e in enumerate(errors) if e is None], seqs):
                out: list[tuple] = []
                for lane, j in enumerate(group):
                    found, seq = lattice.path(lane), seqs[j]
                    if not found or not abs(lattice.zf[lane] - lattice.zb[lane]) <= 1e-8 * max(1, int((lattice.lane == lane).sum())):
                        out.append((j, *[None] * 7, "no path through the likely cells"))
                        continue
                    ends = [s[1] for s in found[1:]] + [int(lattice.samples[lane])]
                    for (state, start, i, q_, p), end in zip(found, ends, strict=True):
                        out.append((j, start, end, i + k // 2, seq[i : i + k], state, p, _kmer(q_, k), None))
                yield table(batch, out)

    return rows.mapInArrow(run, f"readid {kind}, start int, end int, basepos int, motif string, state string, posterior_probability double, polish string, error string")
