"""Segmentation of series against expected levels: a two-state hidden Markov model as a Spark job.

Spark selects, joins and prepares the reads, joins the levels, deals the reads to tasks by their number
and sorts them by length; within a task the recurrences run over many reads of like length at once
(``lanes``), vectorised over a band of positions of their sequences. State M enters a k-mer, state E
stays in it; a k-mer owns at least two samples. Only the band is stored, and of a read too long for a
lane only a block of samples at a time, so a read's memory is bounded by block times band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import filters, joins
from tracemill.operators.lanes import Lane, Lanes, dealt

#: Logs of the transitions: enter the next k-mer, first extension, further extension.
PARAMS = {"m1": float(np.log(0.5)), "e1": 0.0, "e2": float(np.log(0.5))}
BAND = 400
#: Samples of a read whose scores are held at once.
BLOCK = 20_000
#: Cells of the lattices that are computed together, and the most reads of one group.
LANE_CELLS, MOST_LANES = 1_000_000, 512
#: Above this shift a read is scaled from raw readings, not from calibrated ones.
CALIBRATED_SHIFT = 400
_NONE = -np.inf


def prepare(reads: DataFrame, signals: DataFrame, model: DataFrame, pore: str = "dna_r10_400", min_q: float | None = None) -> DataFrame:
    """Reads of basecalls and their signals, ready to be segmented: everything before the recurrence.

    ``reads(readid, signalid, raw_file, seq, qs, ns, ts, sp, shift, scale)`` of quality ``min_q`` on are joined to
    ``signals(raw_file, signalid, adc, pa)``; a null signalid is the readid, a null sp is 0. The part of the signal
    that the read covers is scaled and Hampel-filtered, the sequence is turned the way the molecule runs, and the
    levels are joined. Reads without a signal have an error like all others that can't be segmented.
    """
    is_rna, k = X.pore(pore)[1:3]
    good = filters.min_qscore(reads.withColumn("signalid", F.coalesce("signalid", "readid")), min_q)
    joined = good.join(signals.select("raw_file", "signalid", "adc", "pa"), ["raw_file", "signalid"], "left")
    raw = F.when(F.col("shift") <= CALIBRATED_SHIFT, F.col("pa").cast("array<double>")).otherwise(F.col("adc").cast("array<double>"))
    x = X.znorm(X.signal_window(raw, F.coalesce("sp", F.lit(0)), F.col("ts"), F.col("ns")), F.col("shift"), F.col("scale"))
    return prepare_reads(joined.select("readid", "signalid", X.orient_sequence(F.col("seq"), is_rna).alias("seq"), x.alias("x")), model, k, is_rna=is_rna)


def prepare_reads(reads: DataFrame, model: DataFrame, k: int = 5, window: int = 3, n_sigmas: float = 3.0, is_rna: bool = False) -> DataFrame:
    """``(readid, signalid, seq, x, mu, sd, error)`` from ``reads(readid, seq, x)``; x is Hampel-filtered in the row.

    The sequence is in the molecule's direction; an RNA model's k-mers are turned to match. Reads that
    can't be segmented have an error and empty arrays. Levels are joined by the sequence, so repeated or
    null readids are rows like any other.
    """
    signal = F.coalesce("signalid", F.col("readid").cast("string")) if "signalid" in reads.columns else F.col("readid").cast("string")
    plain = reads.select("readid", signal.alias("signalid"), "seq", "x", F.coalesce(F.size("x"), F.lit(0)).alias("n_samples"))
    checked = filters.validate(plain, k).withColumn("error", F.coalesce(F.when(F.col("x").isNull(), "no signal"), F.when(F.col("seq").isNull(), "no sequence"), "error"))
    filtered = checked.select("readid", "signalid", "seq", hampel_array(F.col("x"), window, n_sigmas).alias("x"), "error")
    return with_levels(filtered, model, k, is_rna)


def with_levels(reads: DataFrame, model: DataFrame, k: int = 5, is_rna: bool = False) -> DataFrame:
    """``(readid, signalid, seq, x, mu, sd, error)``: filtered reads with the levels of their k-mers, joined by the sequence."""
    rows = reads.select("readid", "signalid", "seq", "x", "error", F.md5("seq").alias("_seq"))
    levels = model.select(F.reverse("kmer").alias("kmer"), "level_mean", "level_stdv") if is_rna else model
    kmers = rows.where("error IS NULL").select("_seq", "seq").dropDuplicates(["_seq"]).select("_seq", F.posexplode(X.kmers(F.col("seq"), k)).alias("n", "kmer"))
    found = joins.attach_levels(kmers, levels).groupBy("_seq").agg(F.array_sort(F.collect_list(F.struct("n", "level_mean", "level_stdv"))).alias("lv"))
    out = rows.join(found, "_seq", "left")
    complete = F.size("lv") == F.length("seq") - k + 1
    error = F.coalesce(F.col("error"), F.when(~F.coalesce(complete, F.lit(False)), "k-mer outside the model"))
    none = F.array().cast("array<double>")
    pick = lambda f: F.when(error.isNull(), F.transform("lv", lambda s: s[f])).otherwise(none)
    return out.select("readid", "signalid", "seq", F.coalesce("x", none).alias("x"), pick("level_mean").alias("mu"), pick("level_stdv").alias("sd"), error.alias("error"))


def hampel_array(signal, window: int = 3, n_sigmas: float = 3.0):
    """The Hampel filter on an array, without a shuffle; the same result as the window operator."""
    half = window // 2

    def at(x, i):
        replaced = lambda m, own: X.let(X.array_median(F.transform(own, lambda v: F.abs(v - m))), lambda mad: F.when(F.abs(x - m) > n_sigmas * X.MAD_SCALE * mad, m).otherwise(x))
        return X.let(F.slice(signal, i - half + 1, window), lambda own: X.let(X.array_median(own), lambda m: replaced(m, own)))

    n = F.size(signal)
    return F.when(n > window, F.transform(signal, lambda x, i: F.when((i >= half) & (i < n - half - 1), at(x, i)).otherwise(x))).otherwise(signal)


def band_rows(prepared: DataFrame, band: int = BAND) -> DataFrame:
    """``(readid, t, low, high)``: the columns (0 before the first k-mer) that each border's band holds, borders between samples."""
    rows = prepared.where("error IS NULL").select("readid", (F.size("x") + 1).cast("long").alias("rows"), (F.size("mu") + 1).cast("long").alias("columns"))
    half = F.greatest(F.lit(1), F.least(F.lit(band // 2), F.floor(F.col("columns") / 2)))
    rows = rows.select("readid", "rows", "columns", half.alias("half"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("t"))
    centre = F.floor(F.col("t") * F.col("columns") / F.col("rows"))
    return rows.select("readid", "t", F.greatest(F.lit(0), centre - F.col("half")).alias("low"), F.least(F.col("columns") - 1, centre + F.col("half")).alias("high"))


class Lattice:
    """Forward and backward scores of one read. Rows are borders between samples, columns the k-mers of a band.

    A row's band begins at ``n0``; a row is stored with one more place on either side. Rows are computed in
    blocks: of a read of more than one block only the rows at the blocks' edges are kept, and a block is
    computed again from them when it is needed.
    """

    def __init__(self, x: np.ndarray, mu: np.ndarray, sd: np.ndarray, params: dict[str, float] = PARAMS, band: int = BAND, block: int = BLOCK):
        self.x, self.params = x, params
        self.T, self.N = len(x) + 1, len(mu) + 1
        self.half = max(1, min(band // 2, self.N // 2))
        self.W = 2 * self.half + 1
        self.n0 = np.arange(self.T) * self.N // self.T - self.half
        pad = np.full(self.half + 2, 0.0)
        self._shift = self.half + 2 - 1  # where column 0's level would be
        self._mu, self._sd = np.r_[pad, mu, pad], np.r_[pad + 1, sd, pad + 1]
        outside = np.full(self.half + 2, _NONE)
        self._base = np.r_[outside, -np.log(sd) - X.LOG_2PI / 2, outside]
        self.edges = list(range(0, self.T, block)) + [self.T]
        with np.errstate(invalid="ignore", over="ignore"):
            self._ahead, self._back = self._passes()
        self.zf, self.zb = float(self._last[1][self.half + 1]), float(self._first[1][self.half + 1])

    def _score(self, t: int) -> np.ndarray:
        """Log density of the sample before border ``t`` under the levels of the row's band."""
        at = self.n0[t] + self._shift
        own = slice(at, at + self.W)
        z = (self.x[t - 1] - self._mu[own]) / self._sd[own]
        return self._base[own] - 0.5 * z * z

    def _rows(self, n: int) -> np.ndarray:
        return np.full((n, 2, self.W + 2), _NONE)

    def _forward(self, t: int, before: np.ndarray, out: np.ndarray) -> None:
        p, d, w = self.params, self.n0[t] - self.n0[t - 1], self.W
        s = self._score(t)
        m, e = before
        out[0, 1:-1] = e[d : d + w] + s + p["m1"]
        out[1, 1:-1] = np.logaddexp(m[1 + d : 1 + d + w] + s + p["e1"], e[1 + d : 1 + d + w] + s + p["e2"])

    def _backward(self, t: int, after: np.ndarray, out: np.ndarray) -> None:
        p, d, w = self.params, self.n0[t + 1] - self.n0[t], self.W
        s = np.full(w + 2, _NONE)
        s[1:-1] = self._score(t + 1)
        stay = (after[1] + s)[1 - d : 1 - d + w]
        enter = (after[0] + s)[2 - d : 2 - d + w] + p["m1"]
        out[0, 1:-1] = stay + p["e1"]
        out[1, 1:-1] = np.logaddexp(stay + p["e2"], enter)

    def _passes(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of each block, forward and backward; with several blocks only the first, or last, row of each."""
        one = len(self.edges) == 2
        ahead, back, row = [], [], self._rows(1)[0]
        row[1, self.half + 1] = 0.0
        for a, b in zip(self.edges[:-1], self.edges[1:], strict=True):
            rows = self._rows(b - a) if one else self._rows(2)
            for t in range(a, b):
                own = rows[t - a if one else t % 2]
                if t:
                    self._forward(t, row, own)
                else:
                    own[:] = row
                row = own
                if t == a and not one:
                    ahead.append(own.copy())
            if one:
                ahead.append(rows)
        self._last = row.copy()
        row = self._rows(1)[0]
        row[1, self.half + 1] = 0.0
        for a, b in zip(self.edges[-2::-1], self.edges[:0:-1], strict=True):
            rows = self._rows(b - a) if one else self._rows(2)
            for t in range(b - 1, a - 1, -1):
                own = rows[t - a if one else t % 2]
                if t < self.T - 1:
                    self._backward(t, row, own)
                else:
                    own[:] = row
                row = own
                if t == b - 1 and not one:
                    back.append(own.copy())
            if one:
                back.append(rows)
        self._first = row.copy()
        return ahead, back[::-1]

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows of a block, forward and backward."""
        if len(self.edges) == 2:
            return self._ahead[0], self._back[0]
        a, b = self.edges[k], self.edges[k + 1]
        ahead, back = self._rows(b - a), self._rows(b - a)
        ahead[0], back[-1] = self._ahead[k], self._back[k]
        for t in range(a + 1, b):
            self._forward(t, ahead[t - 1 - a], ahead[t - a])
        for t in range(b - 2, a - 1, -1):
            self._backward(t, back[t + 1 - a], back[t - a])
        return ahead, back

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row and the log posteriors (rows, M and E, band) of each block; and what the stays in it sum to."""
        before = None
        for k, a in enumerate(self.edges[:-1]):
            with np.errstate(invalid="ignore"):
                ahead, back = self._block(k)
                stays = 0.0
                for j in range(len(ahead)):
                    prior = ahead[j - 1] if j else before
                    if prior is not None and self._want_stays:
                        t = a + j
                        d = self.n0[t] - self.n0[t - 1]
                        stays += float(np.exp(prior[1][1 + d : 1 + d + self.W] + self._score(t) + self.params["e2"] + back[j][1][1:-1] - self.zf).sum())
                before = ahead[-1].copy()
                yield a, ahead[:, :, 1:-1] + back[:, :, 1:-1] - self.zf, stays

    _want_stays = False

    def posteriors(self) -> tuple[np.ndarray, np.ndarray]:
        """Log posteriors of M and E as whole matrices: for small reads."""
        out = np.full((2, self.T, self.N), _NONE)
        for a, p, _ in self.blocks():
            for j in range(len(p)):
                n = self.n0[a + j] + np.arange(self.W)
                inside = (n >= 0) & (n < self.N)
                out[:, a + j, n[inside]] = p[j][:, inside]
        return out[0], out[1]

    def path(self) -> list[tuple[int, int, float]]:
        """(first sample, k-mer, probability) of each segment of the path with the best summed log posteriors."""
        row, from_m = self._rows(1)[0], np.zeros((self.T, -(-self.W // 8)), np.uint8)
        row[1, self.half + 1] = 0.0
        for a, p, _ in self.blocks():
            for j in range(len(p)):
                t = a + j
                if not t:
                    continue
                d = self.n0[t] - self.n0[t - 1]
                m, e = row[0][1 + d : 1 + d + self.W], row[1][1 + d : 1 + d + self.W]
                from_m[t] = np.packbits(m >= e)
                new = self._rows(1)[0]
                new[0, 1:-1] = row[1][d : d + self.W] + p[j, 0]
                new[1, 1:-1] = np.maximum(m, e) + p[j, 1]
                row = new
        line, t, n, in_m = np.zeros((self.T, 2), np.int64), self.T - 1, self.N - 1, False
        starts = []
        while t > 0:
            line[t] = n, not in_m
            if in_m:
                starts.append(t)
                n, in_m = n - 1, False
            else:
                at = n - self.n0[t]
                in_m = bool(from_m[t, at >> 3] >> (7 - (at & 7)) & 1)
            t -= 1
        p_of = np.zeros(self.T)
        for a, p, _ in self.blocks():
            t = np.arange(max(a, 1), a + len(p))
            p_of[t] = np.exp(p[t - a, line[t, 1], line[t, 0] - self.n0[t]])
        starts = starts[::-1]
        return [(s - 1, int(line[s, 0]) - 1, float(np.median(p_of[s:e]))) for s, e in zip(starts, [*starts[1:], self.T], strict=True)]

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Expected weight and moments of each k-mer, and the expected logs of entering and of staying."""
        w, enter, stay = np.zeros((3, self.N + 1)), 0.0, 0.0
        self._want_stays = True
        for a, p, stays in self.blocks():
            first = max(a, 1)
            g = np.exp(np.logaddexp(p[first - a :, 0], p[first - a :, 1]))
            n = np.clip(self.n0[first : a + len(p)][:, None] + np.arange(self.W), 0, self.N)
            x = self.x[first - 1 : a + len(p) - 1]
            for k, v in enumerate((g, g * x[:, None], g * (x * x)[:, None])):
                w[k] += np.bincount(n.ravel(), v.ravel(), self.N + 1)
            enter += float(np.exp(p[:, 0]).sum())
            stay += stays
        self._want_stays = False
        with np.errstate(divide="ignore"):
            return *w[:, 1 : self.N], float(np.log(enter)), float(np.log(stay))


def tasks(session: SparkSession) -> int:
    """Partitions of work that goes by samples: a number of the session's, not of the bytes."""
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def spread(prepared: DataFrame) -> DataFrame:
    """Reads dealt to tasks by number, whatever their bytes, and sorted by length within: the kernel's cost goes by samples."""
    return prepared.repartition(tasks(prepared.sparkSession), F.xxhash64("readid", "seq", "x")).sortWithinPartitions(F.size("x"))


def _lattices(batch: pa.RecordBatch, params: dict[str, float], band: int) -> Iterator[list[dict]]:
    """The rows of a batch in groups, each row with an error or its lattice."""
    names = batch.schema.names
    rows = batch.select([c for c in ("readid", "signalid", "seq", "error") if c in names]).to_pylist()
    good = [k for k, row in enumerate(rows) if row["error"] is None]
    if len(good) < len(rows):
        yield [row for row in rows if row["error"] is not None]
    x, mu, sd = (batch.column(names.index(c)) for c in ("x", "mu", "sd"))
    of = lambda column, k: column[k].values.to_numpy(zero_copy_only=False).astype(float)
    for group, alone in dealt([(len(x[k].values), len(mu[k].values)) for k in good], band, LANE_CELLS, MOST_LANES):
        own = [good[j] for j in group]
        reads = [(of(x, k), of(mu, k), of(sd, k)) for k in own]
        lanes = None if alone else Lanes(reads, params, band)
        for j, k in enumerate(own):
            lat = rows[k]["lattice"] = Lattice(*reads[j], params, band) if alone else Lane(lanes, j)
            if not np.isfinite(lat.zf) or not np.isfinite(lat.zb):
                rows[k]["error"] = "score is not finite"
            elif abs(lat.zf - lat.zb) / (lat.T * lat.N) > 1e-8:
                rows[k]["error"] = "forward and backward scores differ"
        yield [rows[k] for k in own]
        for k in own:
            del rows[k]["lattice"]


def segment_reads(prepared: DataFrame, k: int = 5, params: dict[str, float] = PARAMS, band: int = BAND, is_rna: bool = False) -> DataFrame:
    """``(readid, signalid, start, end, basepos, base, motif, state, posterior_probability, polish, error)``.

    Reads with an error give one row that holds nothing else. For RNA the base's position and the motif are
    turned back to the 5' to 3' direction.
    """
    kind = prepared.schema["readid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["readid", "signalid", "start", "end", "basepos", "base", "motif", "posterior_probability", "error"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
        for batch in batches:
            for group in _lattices(batch, params, band):
                out = []
                for row in group:
                    if row["error"]:
                        out.append((row["readid"], row["signalid"], None, None, None, None, None, None, row["error"]))
                        continue
                    seq, found = row["seq"], row["lattice"].path()
                    ends = [s for s, _, _ in found[1:]] + [len(row["lattice"].x)]
                    for (s, n, p), e in zip(found, ends, strict=True):
                        at = n + k // 2
                        motif = seq[max(0, at - k // 2) : at + k // 2 + 1]
                        out.append((row["readid"], row["signalid"], s, e, len(seq) - at - 1 if is_rna else at, seq[at], motif[::-1] if is_rna else motif, p, None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("readid").type), *[pa.array(c, t) for c, t in zip(cols[1:], types, strict=True)]], names)

    schema = f"readid {kind}, signalid string, start int, end int, basepos int, base string, motif string, posterior_probability double, error string"
    return spread(prepared).mapInArrow(run, schema).select(
        "readid", "signalid", "start", "end", "basepos", "base", "motif", F.when(F.col("error").isNull(), "M").alias("state"), "posterior_probability", F.lit("NA").alias("polish"), "error"
    )


def log_likelihood(prepared: DataFrame, params: dict[str, float] = PARAMS, band: int = BAND) -> DataFrame:
    """``(readid, zf, zb, cells, error)`` of each read."""
    kind = prepared.schema["readid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _lattices(batch, params, band):
                rows = []
                for r in group:
                    lat = r.get("lattice")
                    rows.append((r["readid"], lat and lat.zf, lat and lat.zb, lat and lat.T * lat.N, r["error"]))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.schema.field("readid").type), pa.array(c[1], pa.float64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.string())], ["readid", "zf", "zb", "cells", "error"])

    return spread(prepared).mapInArrow(run, f"readid {kind}, zf double, zb double, cells bigint, error string")


def expected_counts(prepared: DataFrame, k: int = 5, params: dict[str, float] = PARAMS, band: int = BAND) -> DataFrame:
    """``(readid, kmer, w, wx, wxx, m1, e2, tail, zf)``: expected weight and moments of each k-mer, expected log transitions.

    ``tail`` is the read's new mean of the tail's k-mer (all A), null where it has none, ``zf`` its score.
    """
    kind = prepared.schema["readid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _lattices(batch, params, band):
                ids, kmers, sums, rest = [], [], [], []
                for row in group:
                    if row["error"]:
                        continue
                    lat = row["lattice"]
                    w, wx, wxx, m1, e2 = lat.sums()
                    names = [row["seq"][j : j + k] for j in range(lat.N - 1)]
                    tail = np.array(names) == "A" * k
                    mean = float(wx[tail].sum() / w[tail].sum()) if w[tail].sum() > 0 else None
                    ids += [row["readid"]] * len(names)
                    kmers += names
                    sums.append(np.stack((w, wx, wxx)))
                    rest += [(m1, e2, mean, lat.zf)] * len(names)
                if ids:
                    columns = [pa.array(c, pa.float64()) for c in (*np.concatenate(sums, axis=1), *zip(*rest, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("readid").type), pa.array(kmers), *columns], ["readid", "kmer", "w", "wx", "wxx", "m1", "e2", "tail", "zf"])

    return spread(prepared).mapInArrow(run, f"readid {kind}, kmer string, w double, wx double, wxx double, m1 double, e2 double, tail double, zf double")


def posterior_rows(prepared: DataFrame, min_p: float = 0.01, params: dict[str, float] = PARAMS, band: int = BAND, k: int = 5) -> DataFrame:
    """Sparse ``(readid, t, n, base, p)``: posteriors of sample and k-mer of at least ``min_p``; base is the k-mer's middle."""
    kind = prepared.schema["readid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for group in _lattices(batch, params, band) for r in group):
                if row["error"]:
                    continue
                lat, letters = row["lattice"], np.array(list(row["seq"]))
                for a, p, _ in lat.blocks():
                    g = np.exp(np.logaddexp(p[:, 0], p[:, 1]))
                    j, at = np.nonzero(g >= min_p)
                    j, at = j[a + j > 0], at[a + j > 0]
                    t, n = a + j - 1, lat.n0[a + j] + at - 1
                    yield pa.RecordBatch.from_arrays([pa.array([row["readid"]] * len(t), batch.schema.field("readid").type), pa.array(t.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(letters[n + k // 2].tolist(), pa.string()), pa.array(g[j, at])], ["readid", "t", "n", "base", "p"])

    return spread(prepared).mapInArrow(run, f"readid {kind}, t int, n int, base string, p double")


def segment_invariants(segments: DataFrame) -> DataFrame:
    """For each read: segments, gaps between neighbours, empty segments, last end."""
    from pyspark.sql import Window

    order = Window.partitionBy("readid").orderBy("start")
    rows = segments.where("error IS NULL").withColumn("_next", F.lead("start").over(order))
    return rows.groupBy("readid").agg(F.count("*").alias("segments"), F.count_if(F.col("_next") != F.col("end")).alias("gaps"), F.count_if(F.col("end") <= F.col("start")).alias("empty"), F.max("end").alias("last_end"))


def segment_errors(segments: DataFrame) -> DataFrame:
    return segments.where("error IS NOT NULL").select("readid", "error")
