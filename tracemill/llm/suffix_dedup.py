"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes when a string of LENGTH bytes that covers it also starts earlier. Sorting every suffix
of the corpus would move each byte many times over, so the strings are first dealt out by anchors:
of the GRAM-byte grams inside a string the one with the least hash is its anchor, at the same place
in every copy of the string. Strings of a document that share an anchor make a span. Spans whose
gram occurs once in the corpus hold nothing repeated; equal spans are one class, of which all but
the first are covered whole. What is left, the first spans of classes that share a gram with other
classes, is settled by sorting their suffixes: prefix polynomial hashes and a binary search give the
common extension of two suffixes, which makes a comparison of a mergesort logarithmic in their
length. Suffixes that come out equal are compared byte by byte before they count as equal.

Documents are dealt into chunks by one shuffle that all steps share; grams, spans and verdicts
travel, the texts don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import chunk_count, portions, release_memory, releasing, whole_text

LENGTH = 100
GRAM = 36
#: Grams that occur more often than this are settled by aggregation instead of within one task.
HOT = 20_000
#: Text bytes that are hashed at once within a task, and those of a chunk of documents.
PIECE, CHUNK_BYTES = 1 << 19, 12 << 20
#: Spans that are compared at once, but for a gram that has more.
SPANS_AT_ONCE = 20_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_power = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_power["up"]) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _power[name] = np.cumprod(np.concatenate(([_U(1)], np.full(n, _U(b)))), dtype=np.uint64)
    return _power["up"][:n], _power["down"][:n]


class Hashes:
    """Prefix polynomial hashes of a byte string; any substring's hash in one step."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Spans:
    """Spans of some texts: per span its text, the first and last string start in it, its gram, its class."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    group: np.ndarray
    content: list[bytes] | None = None


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in portions of about PIECE bytes; a longer text comes in parts that overlap by a string less one."""
    own: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at >= LENGTH:
            part = text[at : at + PIECE + LENGTH - 1]
            own.append((k, at, part))
            size += len(part)
            at += PIECE
            if size >= PIECE:
                yield own
                own, size = [], 0
    if own:
        yield own


def _anchors(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(piece, first, last, gram hash, content hash, place in the joined bytes) of each span, and the joined bytes."""
    raw = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    h = Hashes(raw)
    places = np.arange(len(raw) - gram + 1)
    grams = _mix(h.of(places, gram))
    least = (grams & _U(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    width, k = length - gram + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    size = np.array([len(p) for _, _, p in pieces])
    end = np.cumsum(size)
    piece = np.repeat(np.arange(len(pieces)), size)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= end[piece]
    border = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])])
    after = np.r_[border[1:], len(anchor)]
    border, after = border[whole[border]], after[whole[border]]
    content = _mix(h.of(border, after - border + length - 1)) ^ _mix((after - border).astype(np.uint64))
    return piece[border], border, after - 1, grams[anchor[border]], content, end - size, raw


def spans_of(texts: list[bytes], wanted: np.ndarray | None = None, with_content: bool = False, length: int = LENGTH, gram: int = GRAM) -> Spans:
    """The spans of some texts, those with ``wanted`` (sorted) gram hashes only if given.

    ``group`` numbers equal spans; equal hashes are compared byte by byte.
    """
    doc, first, last, grams, contents, blobs = [], [], [], [], [], []
    for pieces in _pieces(texts):
        p, a, b, g, c, begin, raw = _anchors(pieces, length, gram)
        if wanted is not None:
            keep = np.zeros(len(g), bool) if not len(wanted) else wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g
            p, a, b, g, c = p[keep], a[keep], b[keep], g[keep], c[keep]
        number = np.array([k for k, _, _ in pieces], np.int64)
        shift = np.array([at for _, at, _ in pieces], np.int64) - begin
        doc.append(number[p])
        first.append(a + shift[p])
        last.append(b + shift[p])
        grams.append(g)
        contents.append(c)
        if with_content:
            whole = raw.tobytes()
            blobs += [whole[x : y + length] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    out = Spans(join(doc, np.int64), join(first, np.int64), join(last, np.int64), join(grams, np.uint64), join(contents, np.uint64))
    out.group = np.unique(out.group, return_inverse=True)[1]
    if with_content:
        out.content = blobs
        seen: dict[int, bytes] = {}
        other: dict[tuple[int, bytes], int] = {}
        for k, (g, blob) in enumerate(zip(out.group.tolist(), blobs, strict=True)):
            if seen.setdefault(g, blob) != blob:
                out.group[k] = other.setdefault((g, blob), len(blobs) + len(other))
    return out


def suffix_sort(raw: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes, cut at ``length`` bytes, within their buckets.

    Returns the sorted order and for each place whether it begins a run of equal suffixes. All
    buckets are merged at once, bottom-up; each comparison finds the common extension by a binary
    search over prefix hashes and then compares one byte.
    """
    h = Hashes(raw)

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        apart = np.flatnonzero(h.of(a, length) != h.of(b, length))
        x, y = a[apart], b[apart]
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), length - 1)
        while (live := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = h.of(x, mid) == h.of(y, mid)
            lo = np.where(live & same, mid, lo)
            hi = np.where(live & ~same, mid - 1, hi)
        out[apart] = np.where(raw[x + lo] < raw[y + lo], -1, 1)
        return out

    order = np.argsort(bucket, kind="stable")
    key = bucket[order]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begins, len(key)])
    begin, end = np.repeat(begins, size), np.repeat(begins + size, size)
    now = start[order]
    width = 1
    while len(size) and size.max() > width:
        at = np.flatnonzero(end - begin > width)
        run = begin[at] + (at - begin[at]) // (2 * width) * (2 * width)
        mid, stop = np.minimum(run + width, end[at]), np.minimum(run + 2 * width, end[at])
        left = at < mid
        low, high = np.where(left, mid, run), np.where(left, stop, mid)
        lo, hi = low.copy(), high.copy()
        while (live := np.flatnonzero(lo < hi)).size:
            m = (lo[live] + hi[live]) >> 1
            c = compare(now[m], now[at[live]])
            up = np.where(left[live], c < 0, c <= 0)
            lo[live] = np.where(up, m + 1, lo[live])
            hi[live] = np.where(up, hi[live], m)
        target = np.where(left, at, run + at - mid) + lo - low
        now[target], order[target] = now[at].copy(), order[at].copy()
        width *= 2
    fresh = np.ones(len(now), bool)
    if len(now) > 1:
        same = np.flatnonzero((key[1:] == key[:-1]) & (h.of(now[1:], length) == h.of(now[:-1], length)))
        for k in range(0, len(same), 100_000):  # collision verification
            part = same[k : k + 100_000]
            cols = np.arange(length)
            same_bytes = (raw[now[part + 1][:, None] + cols] == raw[now[part][:, None] + cols]).all(axis=1)
            fresh[part[same_bytes] + 1] = False
    return order, fresh


#: ``again`` marks stretches that the chunk itself has earlier; they need no comparison.
_SPAN = "gram long, chunk int, doc long, tie long, first int, last int, content binary, hot boolean, again boolean"
_VERDICT = "chunk int, doc long, tie long, first int, last int"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered string starts of spans that come gram after gram, all spans of a gram together; some grams at a time."""
    for table in portions(batches, ["gram"], SPANS_AT_ONCE):
        yield from _settled(table)


def _settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from t.filter(t.column("again")).select(["chunk", "doc", "tie", "first", "last"]).to_batches()
    t = t.filter(pc.invert(pc.or_(t.column("hot"), t.column("again"))))
    gram, chunk, doc, tie, first, last = (t.column(c).to_numpy() for c in ("gram", "chunk", "doc", "tie", "first", "last"))
    if not len(t):
        return
    blobs = t.column("content").combine_chunks()
    group = blobs.dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((first, tie, doc))  # corpus order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((rank, group))
    head = np.r_[True, group[by][1:] != group[by][:-1]]
    out = [by[~head]]  # every span but the first of its class is covered whole
    covered = [(first[out[0]], last[out[0]])]
    firsts = by[head]
    number = np.unique(gram[firsts], return_inverse=True)[1]
    shared = firsts[np.bincount(number)[number] > 1]
    if len(shared):
        number = np.unique(gram[shared], return_inverse=True)[1]
        n = last[shared] - first[shared] + 1
        contents = blobs.take(pa.array(shared))
        raw = np.frombuffer(b"".join(contents.to_pylist()), np.uint8)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        owner = np.repeat(np.arange(len(shared)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        # strings can be equal only at the same distance from the anchor, the place of the least gram
        anchor = _anchor_offsets(raw, begin, n)
        bucket = number[owner] * (2 * LENGTH) + (anchor[owner] - offset + LENGTH)
        _, which, count = np.unique(bucket, return_inverse=True, return_counts=True)
        many = np.flatnonzero(count[which] > 1)
        order, fresh = suffix_sort(raw, begin[owner[many]] + offset[many], which[many])
        runs = np.flatnonzero(fresh)
        if len(runs):
            ranked = rank[shared][owner[many][order]]
            least = np.repeat(np.minimum.reduceat(ranked, runs), np.diff(np.r_[runs, len(order)]))
            dup = np.sort(many[order[ranked > least]])
            if len(dup):
                new = np.flatnonzero(np.r_[True, (np.diff(dup) != 1) | (np.diff(owner[dup]) != 0)])
                stop = np.r_[new[1:], len(dup)] - 1
                row = shared[owner[dup[new]]]
                out.append(row)
                covered.append((first[row] + offset[dup[new]], first[row] + offset[dup[stop]]))
    rows = np.concatenate(out)
    a, b = (np.concatenate(x) for x in zip(*covered, strict=True))
    for k in range(0, len(rows), 100_000):
        own = rows[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[own]), pa.array(doc[own]), pa.array(tie[own]), pa.array(a[k : k + 100_000].astype(np.int32)), pa.array(b[k : k + 100_000].astype(np.int32))], ["chunk", "doc", "tie", "first", "last"])


def _anchor_offsets(raw: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the anchor gram within each span: the least one that all of its strings hold."""
    out = np.zeros(len(begin), np.int64)
    h = Hashes(raw)
    for k in range(0, len(begin), 20_000):
        b, m = begin[k : k + 20_000], n[k : k + 20_000]
        # the grams that lie in the first string and in the last one
        width = LENGTH - GRAM + 1 - (m - 1)
        at = np.arange(LENGTH - GRAM + 1)[None, :]
        lo = (m - 1)[:, None] + at
        valid = at < width[:, None]
        places = b[:, None] + np.where(valid, lo, (m - 1)[:, None])
        hashed = (_mix(h.of(places.ravel(), GRAM)) >> _U(32)).astype(np.int64).reshape(places.shape)
        out[k : k + 20_000] = (m - 1) + np.argmin(np.where(valid, hashed, np.iinfo(np.int64).max), axis=1)
    return out


def _only_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column("hot"))


def _hot_verdicts(spans: DataFrame) -> DataFrame:
    """The same verdicts for grams too frequent for one task: strings are grouped by their bytes."""
    own = F.struct("doc", "tie", "first")
    rows = spans.select("chunk", own.alias("own"), "content").withColumn("least", F.min("own").over(Window.partitionBy("content")))
    later = rows.where("own <> least").select("chunk", "own.doc", "own.tie", "own.first", (F.col("own.first") + F.octet_length("content") - LENGTH).alias("last"))
    strings = rows.where("own = least").select("chunk", "own", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - LENGTH)).alias("k"))
    strings = strings.select("chunk", "own", "k", F.substring("content", F.col("k") + 1, F.lit(LENGTH)).alias("string"))
    earliest = strings.groupBy("string").agg(F.min("own").alias("least"))
    start = F.col("own.first") + F.col("k")
    again = strings.join(earliest, "string").where("own <> least").select("chunk", "own.doc", "own.tie", start.alias("first"), start.alias("last"))
    return later.unionByName(again)


def _ordered(t: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, list[int], list[int]]:
    """The different documents of a chunk in corpus order: texts, ids, ties; each row's document and its row."""
    texts = [x.encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
    doc, tie = t.column("doc").to_numpy(), t.column("tie").to_numpy()
    order = sorted(range(len(texts)), key=lambda k: (doc[k], tie[k], texts[k]))
    row_of, firsts = [0] * len(texts), []
    for k in order:
        if not firsts or (doc[k], tie[k], texts[k]) != (doc[firsts[-1]], tie[firsts[-1]], texts[firsts[-1]]):
            firsts.append(k)
        row_of[k] = len(firsts) - 1
    return [texts[k] for k in firsts], doc[firsts], tie[firsts], row_of, firsts


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(chunk, gram, n)``: grams of the spans of each chunk."""
    parts: dict[int, list[pa.Table]] = {}
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        for c in np.unique(chunk):
            own = pa.Table.from_batches([batch]).filter(pa.array(chunk == c))
            texts, *_ = _ordered(own)
            parts.setdefault(int(c), []).append(spans_of(texts).gram)
    for c, grams in parts.items():
        gram, n = np.unique(np.concatenate(grams), return_counts=True)
        for k in range(0, len(gram), 200_000):
            own = gram[k : k + 200_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(own), pa.array(n[k : k + 200_000])], ["chunk", "gram", "n"])


def _class_firsts(left: pa.Table, right: pa.Table) -> pa.Table:
    """The first span of each class of a chunk, among spans whose grams occur again somewhere."""
    texts, doc, tie, *_ = _ordered(left)
    gram, total = right.column("gram").to_numpy().view(np.uint64), right.column("total").to_numpy()
    order = np.argsort(gram)
    gram, total = gram[order], total[order]
    s = spans_of(texts, gram, with_content=True)
    first = np.unique(s.group, return_index=True)[1]  # spans come in corpus order
    hot = total[np.searchsorted(gram, s.gram[first])] > HOT if len(first) else np.zeros(0, bool)
    later = np.ones(len(s.doc), bool)
    later[first] = False
    later = np.flatnonzero(later)
    # spans that follow each other make one stretch
    begins = np.flatnonzero(np.r_[True, (s.doc[later][1:] != s.doc[later][:-1]) | (s.first[later][1:] != s.last[later][:-1] + 1)]) if len(later) else later
    a, b = later[begins], later[np.r_[begins[1:], len(later)][: len(begins)] - 1]
    row, n = np.concatenate((first, a)), len(first)
    chunk = left.column("chunk")[0].as_py() if len(left) else 0
    out = pa.table({
        "gram": pa.array(s.gram[row].view(np.int64)), "chunk": pa.array(np.full(len(row), chunk, np.int32)), "doc": pa.array(doc[s.doc[row]]), "tie": pa.array(tie[s.doc[row]]),
        "first": pa.array(s.first[row].astype(np.int32)), "last": pa.array(np.concatenate((s.last[first], s.last[b])).astype(np.int32)),
        "content": pa.array([*(s.content[k] for k in first), *[None] * len(a)], pa.binary()), "hot": pa.array(np.concatenate((hot, np.zeros(len(a), bool)))), "again": pa.array(np.arange(len(row)) >= n),
    })
    del s, texts
    release_memory()
    return out


def covered_runs(n: int, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Maximal runs [start, end) of the bytes covered by strings that start in the given ranges."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    inside = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
    return np.flatnonzero(np.diff(inside)).reshape(-1, 2)


def _removals(left: pa.Table, right: pa.Table) -> list[tuple[bytes, np.ndarray]]:
    """Bytes and removed runs of each row of a chunk."""
    texts, doc, tie, row_of, _ = _ordered(left)
    number = {(int(d), int(t)): k for k, (d, t) in enumerate(zip(doc, tie, strict=True))}
    told = [number[d, t] for d, t in zip(right.column("doc").to_pylist(), right.column("tie").to_pylist(), strict=True)]
    which = np.array(told, np.int64)
    first, last = right.column("first").to_numpy(), right.column("last").to_numpy()
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(texts) + 1))
    runs = [covered_runs(len(t), first[order[a:b]], last[order[a:b]]) for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]
    return [(texts[k], runs[k]) for k in row_of]


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    if not len(runs):
        return text
    ends = [0, *runs[:, 1].tolist()]
    return b"".join(text[a:b] for a, b in zip(ends, [*runs[:, 0].tolist(), len(text)], strict=True))


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents dealt into chunks, and the verdicts on their spans."""
    n_chunks = chunk_count(docs, CHUNK_BYTES)
    text = whole_text()
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(n_chunks)).cast("int").alias("chunk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(text).alias("tie"), text.alias("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"),
    ).repartitionById(n_chunks, F.col("chunk"))
    grams = dealt.mapInArrow(releasing(_wanted), "chunk int, gram long, n long")
    again = grams.withColumn("total", F.sum("n").over(Window.partitionBy("gram"))).where("total > 1").select("chunk", "gram", "total").repartitionById(n_chunks, F.col("chunk"))
    spans = dealt.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(_class_firsts, _SPAN)
    # one exchange for both ways; the spans of a hot gram are dealt by their content, what needs no comparison by its place
    spread = spans.repartition(F.when(F.col("again"), F.xxhash64("chunk", "doc", "first")).when(F.col("hot"), F.xxhash64("content")).otherwise(F.col("gram")))
    mild, hot = spread.sortWithinPartitions("gram").mapInArrow(releasing(_verdicts), _VERDICT), spread.mapInArrow(_only_hot, _SPAN)
    return dealt, mild.unionByName(_hot_verdicts(hot)).repartitionById(n_chunks, F.col("chunk"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` for each row; spans are byte ranges.

    Null texts are empty; texts shorter than LENGTH keep all. The corpus order is by doc_id (null first),
    then by the text's hash for different texts under one id; rows that are the same in both are one
    document and get the same result. Other columns are not read; an empty table gives no rows.
    """
    dealt, verdicts = _plan(docs.select("doc_id", "text"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _removals(left, right)
        kept = [_kept(t, r) for t, r in rows]
        release_memory()
        return pa.table({
            "doc_id": pa.array([x["doc_id"] for x in left.column("row").to_pylist()], pa.int64()), "n_bytes": pa.array([len(t) for t, _ in rows], pa.int64()),
            "n_removed": pa.array([len(t) - len(k) for (t, _), k in zip(rows, kept, strict=True)], pa.int64()), "n_spans": pa.array([len(r) for _, r in rows], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            "spans": pa.array([[{"start": int(a), "end": int(b)} for a, b in r] for _, r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut out of the texts; parts of a cut character go too."""
    dealt, verdicts = _plan(docs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = [_kept(t, r).decode("utf-8", "ignore") for t, r in _removals(left, right)]
        release_memory()
        return pa.table({"row": left.column("row"), "new_text": pa.array(kept, pa.string())})

    kind = dealt.schema["row"].dataType.simpleString()
    out = dealt.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(run, f"row {kind}, new_text string")
    columns = [F.col("new_text").alias(c) if c == "text" else F.length("new_text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
