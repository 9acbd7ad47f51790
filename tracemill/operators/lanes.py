"""The lattice of many reads at once: arrays with a lane for each read share one loop over the samples.

The same recurrences as of one read, over the same band, for reads of like length. Lanes are sorted by
their number of samples, longest first, so the lanes that are still running are always the first ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

from tracemill.functions import exprs as X

_NONE = -np.inf


class Lanes:
    """Scores, posteriors, best paths and expected counts of reads ``(x, mu, sd)``, longest first."""

    def __init__(self, reads: list[tuple[np.ndarray, np.ndarray, np.ndarray]], params: dict[str, float], band: int):
        self.params, self.reads = params, reads
        self.T, self.N = np.array([len(x) + 1 for x, _, _ in reads]), np.array([len(m) + 1 for _, m, _ in reads])
        self.half = np.maximum(1, np.minimum(band // 2, self.N // 2))
        self.width = 2 * self.half + 1
        lanes, rows, self.W = len(reads), int(self.T[0]), int(self.width.max())
        self.n0 = np.arange(rows)[:, None] * self.N // self.T - self.half  # (row, lane)
        self.lanes = np.searchsorted(-self.T, -np.arange(rows), "left")  # that have this row
        self._beyond = np.where(np.arange(self.W) < self.width[:, None], 0.0, _NONE)
        pad = int(self.half.max()) + 2
        size = int(self.N.max()) + 2 * pad + self.W
        self._shift = pad - 1 + np.arange(lanes) * size  # where column 0's level would be
        self._mu, self._sd, self._base = np.zeros((lanes, size)), np.ones((lanes, size)), np.full((lanes, size), _NONE)
        self.x = np.zeros((rows, lanes))
        for k, (x, mu, sd) in enumerate(reads):
            own = slice(pad, pad + len(mu))
            self._mu[k, own], self._sd[k, own], self._base[k, own] = mu, sd, -np.log(sd) - X.LOG_2PI / 2
            self.x[1 : len(x) + 1, k] = x
        with np.errstate(invalid="ignore", over="ignore"):
            self._ahead, self._back = self._forward(), self._backward()
        own = np.arange(lanes)
        self.zf, self.zb = self._ahead[self.T - 1, own, 1, self.half + 1], self._back[0, own, 1, self.half + 1]

    def _score(self, t: int, k: int) -> np.ndarray:
        """Log density of the sample before row ``t`` under the levels of the band, for the first ``k`` lanes."""
        at = (self.n0[t, :k] + self._shift[:k])[:, None] + np.arange(self.W)
        z = (self.x[t, :k, None] - self._mu.ravel()[at]) / self._sd.ravel()[at]
        return self._base.ravel()[at] - 0.5 * z * z + self._beyond[:k]

    def _rows(self) -> np.ndarray:
        return np.full((len(self.x), len(self.T), 2, self.W + 2), _NONE)

    def _moved(self, t: int, k: int) -> np.ndarray:
        """By how many columns the band of row ``t`` lies further on than that of the row before; 0 or 1."""
        return (self.n0[t, :k] - self.n0[t - 1, :k])[:, None].astype(bool)

    def _forward(self) -> np.ndarray:
        p, w, out = self.params, self.W, self._rows()
        out[0, np.arange(len(self.T)), 1, self.half + 1] = 0.0
        for t in range(1, len(out)):
            k = self.lanes[t]
            d, s = self._moved(t, k), self._score(t, k)
            m, e = out[t - 1, :k, 0], out[t - 1, :k, 1]
            here = np.where(d, e[:, 2 : 2 + w], e[:, 1 : 1 + w])
            out[t, :k, 0, 1:-1] = np.where(d, e[:, 1 : 1 + w], e[:, :w]) + s + p["m1"]
            out[t, :k, 1, 1:-1] = np.logaddexp(np.where(d, m[:, 2 : 2 + w], m[:, 1 : 1 + w]) + s + p["e1"], here + s + p["e2"])
        return out

    def _backward(self) -> np.ndarray:
        p, w, out = self.params, self.W, self._rows()
        out[self.T - 1, np.arange(len(self.T)), 1, self.half + 1] = 0.0
        for t in range(len(out) - 2, -1, -1):
            k = self.lanes[t + 1]
            if not k:
                continue
            d = self._moved(t + 1, k)
            s = np.full((k, w + 2), _NONE)
            s[:, 1:-1] = self._score(t + 1, k)
            stay, enter = out[t + 1, :k, 1] + s, out[t + 1, :k, 0] + s
            stay = np.where(d, stay[:, :w], stay[:, 1 : 1 + w])
            enter = np.where(d, enter[:, 1 : 1 + w], enter[:, 2 : 2 + w]) + p["m1"]
            out[t, :k, 0, 1:-1] = stay + p["e1"] + self._beyond[:k]
            out[t, :k, 1, 1:-1] = np.logaddexp(stay + p["e2"], enter) + self._beyond[:k]
        return out

    @cached_property
    def log_p(self) -> np.ndarray:
        """Log posteriors (row, lane, M and E, band); nothing in rows that a lane doesn't have."""
        with np.errstate(invalid="ignore"):
            return self._ahead[..., 1:-1] + self._back[..., 1:-1] - self.zf[:, None, None]

    @cached_property
    def paths(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first samples, k-mers, probabilities) of each lane's path with the best summed log posteriors."""
        rows, lanes, w, p = len(self.x), len(self.T), self.W, self.log_p
        from_m, row = np.zeros((rows, lanes, w), bool), np.full((lanes, 2, w + 2), _NONE)
        row[np.arange(lanes), 1, self.half + 1] = 0.0
        with np.errstate(invalid="ignore"):
            for t in range(1, rows):
                k = self.lanes[t]
                d = self._moved(t, k)
                m, e = (np.where(d, row[:k, s, 2 : 2 + w], row[:k, s, 1 : 1 + w]) for s in (0, 1))
                from_m[t, :k] = m >= e
                enter = np.where(d, row[:k, 1, 1 : 1 + w], row[:k, 1, :w])
                row[:k, 0, 1:-1] = enter + p[t, :k, 0]
                row[:k, 1, 1:-1] = np.maximum(m, e) + p[t, :k, 1]
        n, in_m = self.N - 1, np.zeros(lanes, bool)
        line, stay, prob = np.zeros((rows, lanes), np.int64), np.zeros((rows, lanes), bool), np.zeros((rows, lanes))
        for t in range(rows - 1, 0, -1):
            k = self.lanes[t]
            own = np.arange(k)
            line[t, :k], stay[t, :k] = n[:k], ~in_m[:k]
            at = n[:k] - self.n0[t, :k]
            prob[t, :k] = np.exp(p[t, own, stay[t, :k].astype(int), at])
            n[:k] -= in_m[:k]
            in_m[:k] = ~in_m[:k] & from_m[t, own, at]
        valid = np.arange(rows)[None, :] < self.T[:, None]
        valid[:, 0] = False
        begins = valid & ~stay.T
        lane, first = np.nonzero(begins)
        segment = np.cumsum(begins.ravel()) - 1
        own, value = segment[valid.ravel()], prob.T[valid]
        value = value[np.lexsort((value, own))]
        size = np.bincount(own, minlength=len(lane))
        start = np.cumsum(size) - size
        median = (value[start + (size - 1) // 2] + value[start + size // 2]) / 2
        cut = np.searchsorted(lane, np.arange(lanes + 1))
        kmer = line[first, lane] - 1
        return [(first[a:b] - 1, kmer[a:b], median[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    @cached_property
    def sums(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]:
        """Each lane's expected weight and moments of its k-mers, and its expected logs of entering and of staying."""
        rows, lanes, w, p = len(self.x), len(self.T), self.W, self.log_p
        most = int(self.N.max()) + 1
        moments, enter, stay = np.zeros((3, lanes * most)), np.zeros(lanes), np.zeros(lanes)
        with np.errstate(invalid="ignore", divide="ignore"):
            for t in range(1, rows):
                k = self.lanes[t]
                g = np.exp(np.logaddexp(p[t, :k, 0], p[t, :k, 1]))
                n = np.clip(self.n0[t, :k, None] + np.arange(w), 0, self.N[:k, None]) + most * np.arange(k)[:, None]
                x = self.x[t, :k, None]
                for j, v in enumerate((g, g * x, g * (x * x))):
                    moments[j, : k * most] += np.bincount(n.ravel(), v.ravel(), k * most)
                enter[:k] += np.exp(p[t, :k, 0]).sum(axis=1)
                d = self._moved(t, k)
                e = self._ahead[t - 1, :k, 1]
                stays = np.where(d, e[:, 2 : 2 + w], e[:, 1 : 1 + w]) + self._score(t, k) + self.params["e2"] + self._back[t, :k, 1, 1:-1] - self.zf[:k, None]
                stay[:k] += np.exp(stays).sum(axis=1)
            enter, stay = np.log(enter + np.exp(p[0, :, 0]).sum(axis=1)), np.log(stay)
        moments = moments.reshape(3, lanes, most)
        return [(*moments[:, k, 1:n], float(a), float(b)) for k, (n, a, b) in enumerate(zip(self.N.tolist(), enter, stay, strict=True))]


class Lane:
    """One read of some lanes, as the lattice of a single read answers."""

    def __init__(self, lanes: Lanes, k: int):
        self._lanes, self._k = lanes, k
        self.x, self.T, self.N, self.W = lanes.reads[k][0], int(lanes.T[k]), int(lanes.N[k]), lanes.W
        self.zf, self.zb = float(lanes.zf[k]), float(lanes.zb[k])
        self.n0 = lanes.n0[:, k]

    def blocks(self) -> Iterator[tuple[int, np.ndarray, float]]:
        yield 0, self._lanes.log_p[: self.T, self._k], 0.0

    def path(self) -> list[tuple[int, int, float]]:
        return list(zip(*(v.tolist() for v in self._lanes.paths[self._k]), strict=True))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        return self._lanes.sums[self._k]


def dealt(sizes: list[tuple[int, int]], band: int, cells: int, most: int) -> Iterator[tuple[list[int], bool]]:
    """Reads of ``sizes`` (samples, k-mers) in groups of at most ``most`` lanes and about ``cells`` cells of the lattice.

    Also whether the group is a lattice of its own: one read that is larger than ``cells``.
    """
    width = [2 * max(1, min(band // 2, (n + 1) // 2)) + 3 for _, n in sizes]
    group: list[int] = []
    wide = 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k][0]):
        rows = sizes[group[0] if group else k][0] + 1
        if group and (len(group) == most or rows * max(wide, width[k]) * (len(group) + 1) > cells):
            yield group, False
            group, wide = [], 0
        if (sizes[k][0] + 1) * width[k] > cells:
            yield [k], True
            continue
        group.append(k)
        wide = max(wide, width[k])
    if group:
        yield group, False
