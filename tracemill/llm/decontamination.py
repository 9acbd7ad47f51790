"""Benchmark decontamination by a CGK embedding and bit-sampling LSH.

A benchmark item and a window of a document that has as many words are embedded by the same random
walks (CGK): a walk copies the current word to its output and then stays or steps on, by a random bit
of the word and the step. Word sequences at a small edit distance give outputs at a small Hamming
distance, so sampled output places are often all equal; REPEATS walks with SAMPLES places each reach
the target recall. Windows that fall into an item's bucket are verified by an exact edit distance.

A window within the distance shares runs of words with its item: each edit breaks at most as many
runs as one has words, so a known number of the item's runs must turn up in the text, in places that
the edits can have shifted only so far. Windows with fewer are not embedded. That test loses nothing,
and everything else goes through the embedding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import releasing

SIMILARITY = 0.8
REPEATS = 32
SAMPLES = 2
#: Items are held against all documents in blocks of so many words, which bounds what is broadcast.
BLOCK_WORDS = 2_000_000
#: Longest run of words that selects windows.
RUN = 3
#: Words whose hash a worker remembers.
REMEMBERED = 250_000
#: Words of text that are looked at at once.
WORDS_AT_ONCE = 1_000_000
#: Pairs of places, or of windows and items, that are looked at at once.
PAIRS_AT_ONCE = 1_000_000

_U = np.uint64
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|-–—…«»„“”‘’¡¿"
_known: dict[str, int] = {}
_hashes = np.zeros(REMEMBERED, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, lower-cased, without punctuation at the ends; bare punctuation is no word."""
    words = text.split()
    if len(_known) + len(words) > REMEMBERED:
        _known.clear()
    if len(words) > REMEMBERED:
        return np.concatenate([word_hashes(" ".join(words[k : k + REMEMBERED // 2])) for k in range(0, len(words), REMEMBERED // 2)])
    ids = list(map(_known.get, words))
    if None in ids:
        for raw in {w for w, i in zip(words, ids, strict=True) if i is None}:
            w = raw.lower().strip(_EDGE)
            _known[raw] = len(_known)
            _hashes[_known[raw]] = (xxhash.xxh64_intdigest(w) | 1) if w else 0
        ids = list(map(_known.get, words))
    found = _hashes[np.array(ids, np.int64)]
    return found[found != 0]


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that leave ``n`` words similar enough."""
    return int((1 - similarity) * n + 1e-9)


def _run_of(n: int, similarity: float) -> int:
    e = allowed(n, similarity)
    return max(1, min(RUN, -(-(n - e) // (e + 1))))


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    h = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        h = h * _U(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
    return _mix(h + _U(k))


def embed_samples(sequences: np.ndarray, repeats: int = REPEATS, samples: int = SAMPLES) -> np.ndarray:
    """Bucket keys (sequences, repeats) of word sequences of one length, a row each.

    Walk r steps on after output place j where bit j of the word's hash under r is set. Only the
    sampled places are kept; the walk ends at the last of them.
    """
    count, n = sequences.shape
    padded = np.concatenate((sequences, np.zeros((count, 1), np.uint64)), axis=1)
    rng = np.random.default_rng(n)
    # a walk ends after about 2n places, with a spread of about the root of 2n; beyond it there is only padding
    reach = max(n, int(2 * n - 2 * np.sqrt(2 * n)))
    places = np.stack([rng.choice(reach, min(samples, reach), replace=False) for _ in range(repeats)])
    seeds = rng.integers(1, 1 << 63, (reach // 64 + 1, repeats)).astype(np.uint64)
    rows, walks = np.arange(count)[:, None], np.arange(repeats)[None, :]
    at = np.zeros((count, repeats), np.int64)
    keys = np.broadcast_to((np.arange(repeats) * 1000 + n).astype(np.uint64), (count, repeats)).copy()
    bits = np.zeros((0, 0, 0), np.uint64)
    for j in range(int(places.max()) + 1):
        if j % 64 == 0:
            bits = _mix(padded[:, None, :] ^ seeds[j // 64][None, :, None])
        if (sampled := (places == j).any(axis=1)).any():
            keys[:, sampled] = _mix(keys[:, sampled] ^ padded[rows, at[:, sampled]])
        at = np.minimum(at + ((bits[rows, walks, at] >> _U(j % 64)) & _U(1)).astype(np.int64), n)
    return keys


def edit_distances(a: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least edit distance of ``a`` to any stretch of ``b``, and where the best one ends."""
    count, m = b.shape
    cols = np.arange(m + 1, dtype=np.int32)
    valid = cols <= b_len[:, None]
    row = np.zeros((count, m + 1), np.int32)  # a stretch may begin anywhere
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - cols, axis=1) + cols
    row = np.where(valid, row, np.iinfo(np.int32).max)
    end = row.argmin(axis=1)
    return row[np.arange(count), end], end


@dataclass
class Items:
    """A block of benchmark items, ready to be searched for."""

    ids: list[int]
    words: list[np.ndarray]
    run_hash: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by run length: sorted hashes, items, places
    buckets: dict[int, tuple[np.ndarray, np.ndarray]]  # by item length: sorted keys, items
    similarity: float


def prepare(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY) -> Items:
    ids, words = [], []
    for item_id, text in rows:
        w = word_hashes(text or "")
        if len(w) and item_id is not None:
            ids.append(item_id)
            words.append(w)
    by_run: dict[int, list] = {}
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        run = _run_of(len(w), similarity)
        h = _runs(w, run)
        by_run.setdefault(run, []).append((h, np.full(len(h), k), np.arange(len(h))))
        by_length.setdefault(len(w), []).append(k)
    run_hash = {}
    for run, parts in by_run.items():
        h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        run_hash[run] = (h[order], item[order], at[order])
    buckets = {}
    for n, own in by_length.items():
        keys = embed_samples(np.stack([words[k] for k in own]))
        item = np.repeat(own, keys.shape[1])
        order = np.argsort(keys.ravel())
        buckets[n] = (keys.ravel()[order], item[order])
    return Items(ids, words, run_hash, buckets, similarity)


def _expanded(sorted_keys: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (place in keys, place in sorted_keys) of equal keys, about PAIRS_AT_ONCE at a time."""
    lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, "right")
    some = np.flatnonzero(hi > lo)
    lo, n = lo[some], (hi - lo)[some]
    until = np.cumsum(n)
    k = 0
    while k < len(some):
        end = max(k + 1, int(np.searchsorted(until, until[k] - n[k] + PAIRS_AT_ONCE)))
        m = n[k:end]
        yield np.repeat(some[k:end], m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[k:end], m)
        k = end


def _likely(items: Items, run: int, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which matches of a run stand with so many others of the same document and item, at shifts that differ
    by so little, that the item may be there within the distance."""
    slack = np.array([allowed(int(n), items.similarity) for n in range(int(lengths.max(initial=0)) + 1)])
    e = slack[lengths[item]]
    need = np.maximum(1, lengths[item] - run + 1 - e * run)
    order = np.lexsort((shift, item, doc))
    d, i, s, e, need = doc[order], item[order], shift[order], e[order], need[order]
    group = np.cumsum(np.r_[0, (d[1:] != d[:-1]) | (i[1:] != i[:-1])])
    place = group * (int(s.max() - s.min()) + 2 * int(e.max()) + 2) + (s - s.min())
    end = np.searchsorted(place, place + 2 * e, "right")
    full = np.flatnonzero(end - np.arange(len(place)) >= need)
    mark = np.zeros(len(place) + 1, np.int64)
    np.add.at(mark, full, 1)
    np.add.at(mark, end[full], -1)
    out = np.zeros(len(order), bool)
    out[order] = np.cumsum(mark[:-1]) > 0
    return out


def _windows(items: Items, flat: np.ndarray, owner: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (words, start, document) of the windows that may be within the distance of some item."""
    lengths = np.array([len(w) for w in items.words])
    found = [np.zeros((0, 3), np.int64)]
    for run, (hashes, item, at) in items.run_hash.items():
        if len(flat) < run:
            continue
        h = _runs(flat, run)
        maybe = np.zeros(1 << 20, bool)
        maybe[(hashes & _U((1 << 20) - 1)).astype(np.int64)] = True
        q = np.flatnonzero(maybe[(h & _U((1 << 20) - 1)).astype(np.int64)])
        q = q[q + run <= end[owner[q]]]
        longest = int(lengths.max()) * 2 + 2
        before: list[tuple[np.ndarray, np.ndarray]] = []  # matches that may belong with the next piece's
        for a, b in _expanded(hashes, h[q]):
            before.append((q[a], b))
            place, b = (np.concatenate(x) for x in zip(*before, strict=True))
            doc, own, shift = owner[place], item[b], place - at[b]
            keep = _likely(items, run, doc, own, shift, lengths)
            found.append(np.unique(np.column_stack((lengths[own], shift, doc))[keep], axis=0))
            near = place >= place[-1] - longest
            before = [(place[near], b[near])]
    return np.unique(np.concatenate(found), axis=0)


def find(items: Items, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
    """For each document its items, with the best match: (distance, first word, words).

    Of equal distances the match that begins first counts. Pairs of windows and items are verified
    in pieces, so many items that open alike, or a text that repeats an opening, take time but no
    more memory.
    """
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
    if not docs or not items.ids:
        return found
    flat = np.concatenate([np.asarray(d, np.uint64) for d in docs])
    size = np.array([len(d) for d in docs])
    end = np.cumsum(size)
    begin = end - size
    windows = _windows(items, flat, np.repeat(np.arange(len(docs)), size), end)
    for n in np.unique(windows[:, 0]):
        own = windows[windows[:, 0] == n]
        slack = allowed(int(n), items.similarity)
        keys, held = items.buckets[int(n)]
        for k in range(0, len(own), 2_000):
            _, start, doc = own[k : k + 2_000].T
            place = start[:, None] + np.arange(n)
            inside = (place >= begin[doc][:, None]) & (place < end[doc][:, None])
            seq = np.where(inside, flat[np.clip(place, 0, len(flat) - 1)], _U(0))
            pairs = [np.unique(w // REPEATS * len(items.ids) + held[b]) for w, b in _expanded(keys, embed_samples(seq).ravel())]
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            for j in range(0, len(pairs), 20_000):
                w, i = np.divmod(pairs[j : j + 20_000], len(items.ids))
                d = doc[w]
                lo = np.maximum(start[w] - slack, begin[d])
                place = lo[:, None] + np.arange(n + 2 * slack)
                text = np.where(place < end[d][:, None], flat[np.clip(place, 0, len(flat) - 1)], _U(0))
                dist, stop = edit_distances(np.stack([items.words[x] for x in i]), text, np.minimum(end[d] - lo, n + 2 * slack))
                for x in np.flatnonzero(dist <= slack).tolist():
                    first = max(0, int(lo[x] + stop[x] - n - begin[d[x]]))
                    item_id, own_hits = items.ids[i[x]], found[d[x]]
                    best = own_hits.get(item_id)
                    if best is None or (int(dist[x]), first) < best[:2]:
                        own_hits[item_id] = (int(dist[x]), first, int(n))
    return found


_HITS = "array<struct<item_id:bigint,start_word:bigint,n_words:bigint,distance:bigint,similarity:double>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size, each read by itself."""
    own, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        own.append((row.item_id, row.text))
        words += len(row.text or "") // 4 + 1
        if words >= BLOCK_WORDS:
            yield own
            own, words = [], 0
    if own:
        yield own


def with_hits(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(row, hits)``: each document as a struct and the benchmark items that it contains.

    A hit is an item of ``n_words`` words with a stretch of the document at an edit distance (in words)
    of at most ``(1 - similarity) * n_words``. Null or empty texts have no hits, an item without words is
    in no document, an item given twice counts once. Empty tables give no hits or no rows.
    """
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.array().cast(_HITS).alias("hits"))
    kind = out.schema["row"].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark):
        shared = context.broadcast(prepare(block, similarity))  # about BLOCK_WORDS words at most

        @releasing
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                texts, before, k = batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist(), 0
                while k < len(texts):
                    words, total, end = [], 0, k
                    while end < len(texts) and (end == k or total < WORDS_AT_ONCE):
                        words.append(word_hashes(texts[end] or ""))
                        total += len(words[-1])
                        end += 1
                    hits = [
                        old + [{"item_id": i, "start_word": a, "n_words": n, "distance": x, "similarity": 1 - x / n} for i, (x, a, n) in sorted(new.items())]
                        for old, new in zip(before[k:end], find(items, words), strict=True)
                    ]
                    part = batch.slice(k, end - k)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, _HIT)], ["row", "hits"])
                    k = end

        out = out.mapInArrow(run, f"row {kind}, hits {_HITS}")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, distance, similarity)``: one row for each document and item in it."""
    hits = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, similarity)
    return hits.select("row.doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminating_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a benchmark item go."""
    return with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("hits") == 0).select("row.*")
