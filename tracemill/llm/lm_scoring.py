"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to powers of two; an n-gram of level q is put into the
filter q times, once for each level up to its own. Probing levels until one is missing gives the
count back within a factor of two, and never too small a level. N-grams are dealt to buckets by the
top bits of their hashes. The task that has summed a bucket's counts knows how many levels it holds
and gives its filter that many times LEVEL_BITS, so the rate of false levels is the same for every
size of corpus. The filter grows with the corpus, so it is never gathered nor broadcast: each chunk
of documents sends its distinct n-grams to the buckets and gets levels and exact word counts back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import chunk_count, deal, materialise, release_memory, releasing, whole_text

#: Text for each bucket of n-grams, and for each chunk of documents that is scored.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 24 << 20
#: Bits of the filter for each level put in: with three probes 17% are set, 0.5% of levels are false.
LEVEL_BITS = 16
#: Bits of a segment: those of one n-gram are all in one.
SEGMENT_BITS = 1 << 13
PROBES = 3
MOST_LEVELS = 48
#: Weight of the pair's relative frequency against the word's.
PAIR_WEIGHT = 0.4
#: Text that is counted at once within a task, and that whose tokens are at hand at once.
COUNT_BYTES, SLICE_BYTES = 7 << 20, 2 << 20
#: Words whose hash a worker remembers; beyond it only the half met most often stays.
REMEMBERED = 500_000

_U = np.uint64
END = _U(0x2545F4914F6CDD1D)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(3) + mix(b + _U(0x9E3779B97F4A7C15)))


_number: dict[bytes, int] = {}
_hash = np.zeros(1 << 16, np.uint64)
_met = np.zeros(1 << 16, np.int32)


def _forget(most: int) -> None:
    """Keep only the ``most`` words met most often."""
    global _number
    n = len(_number)
    stay = np.sort(np.argsort(-_met[:n], kind="stable")[:most])
    words = list(_number)
    _number = {words[k]: j for j, k in enumerate(stay.tolist())}
    _hash[: len(stay)], _met[: len(stay)] = _hash[stay], _met[stay] // 2
    _met[len(stay) :] = 0


def _codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, by which ``_hash`` has its hash."""
    global _hash, _met
    found = list(map(_number.get, words))
    if None in found:
        known = len(_number)
        fresh = [k for k, x in enumerate(found) if x is None]
        for k in fresh:
            found[k] = _number.setdefault(words[k], len(_number))
        if len(_number) > len(_hash):
            more = max(len(_hash), len(_number) - len(_hash))
            _hash, _met = np.concatenate((_hash, np.zeros(more, np.uint64))), np.concatenate((_met, np.zeros(more, np.int32)))
        _hash[known : len(_number)] = [xxhash.xxh64_intdigest(w) for w in dict.fromkeys(words[k] for k in fresh)]
    return np.array(found, np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Tokens:
    """The tokens of some texts: the words, ASCII letters lower-cased, then one end each.

    ``word`` has the hashes of the different tokens, sorted, ``index`` each token's place in it.
    """

    def __init__(self, texts: list[str]):
        if len(_number) > REMEMBERED:
            _forget(REMEMBERED // 2)
        words: list[bytes] = []
        self.count = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = text.encode("utf-8", "replace").lower().split()
            words += own
            self.count[k] = len(own) + 1
        codes = _codes(words)
        here = np.zeros(len(_number), bool)
        here[codes] = True
        here = np.flatnonzero(here)
        _met[here] += 1
        hashes = np.append(_hash[here], END)
        order = np.argsort(hashes)
        self.word = hashes[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        of_code = np.zeros(len(_number), np.int32)
        of_code[here] = place[:-1]
        self.end = place[-1]
        self.first = np.cumsum(self.count) - self.count
        self.index = np.full(len(words) + len(texts), self.end, np.int32)
        is_word = np.ones(len(self.index), bool)
        is_word[self.first + self.count - 1] = False
        self.index[is_word] = of_code[codes]

    def pairs(self) -> np.ndarray:
        """A hash for each token with the one before it; the end of a text stands before the next one's first word."""
        hashes = self.word[self.index]
        return pair_key(np.concatenate((np.array([END])[: len(hashes)], hashes[:-1])), hashes)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Level 1 is a count of 1, level 2 counts of 2 and 3, and so on."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(levels > 0, 0.75 * 2.0**levels - 0.5, 0.0)


class Filter:
    """Bits of the log-frequency Bloom filter: ``size`` of them, in segments of SEGMENT_BITS."""

    def __init__(self, size: int, data: np.ndarray | None = None):
        self.segments = size // SEGMENT_BITS
        self.data = data if data is not None else np.zeros(size // 8, np.uint8)

    def places(self, keys: np.ndarray, level: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(keys ^ (level.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        step = mix(h) | _U(1)
        base = (keys % _U(self.segments)) * _U(SEGMENT_BITS)
        for k in range(PROBES):
            yield base + (h + _U(k) * step) % _U(SEGMENT_BITS)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """For each key the levels that are there, from 1 on without a gap."""
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for level in range(1, MOST_LEVELS + 1):
            there = np.ones(len(live), bool)
            for at in self.places(keys[live], np.full(len(live), level)):
                there &= (self.data[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
            live = live[there]
            if not len(live):
                break
            out[live] = level
        return out


class Segments:
    """The segments that one task makes; room is taken only for those it meets."""

    def __init__(self, size: int):
        self.filter = Filter(size, np.zeros(0, np.uint8))
        self.slot = np.full(self.filter.segments, -1)
        self.bits = np.zeros((0, SEGMENT_BITS), bool)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        new = np.unique(keys % _U(self.filter.segments)).astype(np.int64)
        new = new[self.slot[new] < 0]
        self.slot[new] = len(self.bits) + np.arange(len(new))
        self.bits = np.concatenate((self.bits, np.zeros((len(new), SEGMENT_BITS), bool)))
        top = levels_of(counts)
        for level in range(1, int(top.max(initial=0)) + 1):
            now = keys[top >= level]
            for at in self.filter.places(now, np.full(len(now), level)):
                self.bits[self.slot[(at // _U(SEGMENT_BITS)).astype(np.int64)], (at % _U(SEGMENT_BITS)).astype(np.int64)] = True

    def rows(self) -> tuple[np.ndarray, list[bytes]]:
        own = np.flatnonzero(self.slot >= 0)
        return own, [x.tobytes() for x in np.packbits(self.bits[self.slot[own]], axis=1, bitorder="little")]


def held_out(divisor: int = 7, remainder: int = 2) -> Column:
    """Whether a document's id leaves it out of training; a null id is read as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor)) == remainder


def _batches(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[list[str]]:
    texts, size = [], 0
    for batch in batches:
        for text in batch.column(column).to_pylist():
            texts.append(text)
            size += len(text)
            if size >= most:
                yield texts
                texts, size = [], 0
    if texts:
        yield texts


def _bucket_count(docs: DataFrame) -> int:
    """A power of two that follows the text."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, 1 << (text_bytes // BUCKET_BYTES).bit_length())


def _edges(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted n-grams, and their end."""
    first = np.arange(buckets, dtype=np.uint64) << _U(65 - buckets.bit_length())
    return np.append(np.searchsorted(gram, first), len(gram))


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of an array in pieces."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(pieces: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(pieces.to_pylist()), dtype)


def ngram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, words, word_n, pairs, pair_n)``: sorted hashes and their counts, summed within each task only."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _batches(batches, 0, COUNT_BYTES):
            tokens, columns, some = Tokens(texts), [pa.array(np.arange(buckets, dtype=np.int32))], np.zeros(buckets, bool)
            pairs = np.sort(tokens.pairs())
            starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
            n_words = np.bincount(tokens.index, minlength=len(tokens.word))
            for gram, n in ((tokens.word[n_words > 0], n_words[n_words > 0]), (pairs[starts], np.diff(np.append(starts, len(pairs))))):
                edges = _edges(gram, buckets)
                columns += [_cut(gram, edges), _cut(n.astype(np.uint32), edges)]
                some |= np.diff(edges) > 0
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "words", "word_n", "pairs", "pair_n"]).filter(pa.array(some))

    return docs.select(whole_text().alias("text")).mapInArrow(run, "bucket int, words binary, word_n binary, pairs binary, pair_n binary")


class Model:
    """The filters and the exact word counts, a row for each bucket, and the training totals."""

    def __init__(self, table: DataFrame, buckets: int, n: int, v: int):
        self.table, self.buckets, self.n, self.v = table, buckets, n, v


def fit(docs: DataFrame) -> Model:
    """Count the words and pairs of all documents given, and make the filter."""
    buckets = _bucket_count(docs)

    def summed(group: pa.Table, grams: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
        gram, n = _joined(group.column(grams), np.uint64), _joined(group.column(counts), np.uint32)
        if not len(gram):
            return gram, n.astype(np.int64)
        order = np.argsort(gram)
        gram = gram[order]
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        return gram[starts], np.add.reduceat(n[order].astype(np.int64), starts)

    def make(group: pa.Table) -> pa.Table:
        parts = [summed(group, "words", "word_n"), summed(group, "pairs", "pair_n")]
        levels = sum(int(levels_of(n).sum()) for _, n in parts)
        size = SEGMENT_BITS * -(-LEVEL_BITS * levels // SEGMENT_BITS)
        made, data, width = Segments(size), np.zeros(size // 8, np.uint8), SEGMENT_BITS // 8
        for gram, n in parts:
            made.add(gram, n)
        for segment, bits in zip(*made.rows(), strict=True):
            data[segment * width : (segment + 1) * width] = np.frombuffer(bits, np.uint8)
        words, n = parts[0]
        return pa.table({"bucket": group.column("bucket")[:1], "bits": [data.tobytes()], "words": [words.tobytes()], "word_n": [n.tobytes()], "total": [int(n.sum())], "distinct": [len(words)]})

    counts = deal(ngram_counts(docs, buckets), "bucket", buckets)
    table = materialise(counts.groupBy("part", "bucket").applyInArrow(make, "bucket int, bits binary, words binary, word_n binary, total long, distinct long"), "ngrams")
    n, v = table.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    return Model(table.drop("total", "distinct"), buckets, int(n), int(v))


def _tokens(texts: list[str]) -> tuple[list[Tokens], np.ndarray, np.ndarray]:
    """The tokens of texts, slice by slice, and the sorted distinct words and pairs of all."""
    tokens = [Tokens(own) for own in _slices(texts)]
    none = np.zeros(0, np.uint64)
    return tokens, distinct(np.concatenate([none, *(t.word for t in tokens if len(t.count))])), distinct(np.concatenate([none, *(distinct(t.pairs()) for t in tokens)]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    ``score`` is the sum over tokens of log10 of ``(1 - w) * (c + 1) / (N + V + 1)`` plus ``w`` times
    the pair's count over the count of the token before, counts from the filter, and no probability
    above 1; where the token before was never seen, w is 0. Null texts are empty: one token, the end. Rows are kept as they come; only doc_id and
    text are read.
    """
    n_chunks = chunk_count(docs, CHUNK_BYTES)
    dealt = deal(docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), "chunk", n_chunks)
    buckets, total, rows = model.buckets, model.n, model.n + model.v + 1

    def wanted(group: pa.Table) -> pa.Table:
        _, words, pairs = _tokens(group.column("text").to_pylist())
        at = [_edges(words, buckets), _edges(pairs, buckets)]
        chunk = np.full(buckets, group.column("chunk")[0].as_py(), np.int32)
        found = pa.table({"chunk": chunk, "bucket": np.arange(buckets, dtype=np.int32), "words": _cut(words, at[0]), "pairs": _cut(pairs, at[1])})
        release_memory()
        return found.filter(pa.array((np.diff(at[0]) > 0) | (np.diff(at[1]) > 0)))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        words, pairs = _joined(asked.column("words"), np.uint64), _joined(asked.column("pairs"), np.uint64)
        levels, n = [np.zeros(len(x), np.uint8) for x in (words, pairs)], np.zeros(len(words), np.int64)
        if len(known):
            data = _joined(known.column("bits"), np.uint8)
            bloom = Filter(8 * len(data), data)
            levels = [bloom.levels(x).astype(np.uint8) for x in (words, pairs)]
            gram, count = _joined(known.column("words"), np.uint64), _joined(known.column("word_n"), np.int64)
            if len(gram):
                at = np.minimum(np.searchsorted(gram, words), len(gram) - 1)
                n = np.where(gram[at] == words, count[at], 0)
        ends = [np.cumsum([0, *(len(x) // 8 for x in asked.column(c).to_pylist())]) for c in ("words", "pairs")]
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "word_level": _cut(levels[0], ends[0]), "word_n": _cut(n, ends[0]), "pair_level": _cut(levels[1], ends[1])})

    asked = deal(dealt.groupBy("part", "chunk").applyInArrow(wanted, "chunk int, bucket int, words binary, pairs binary"), "bucket", buckets)
    answered = asked.groupBy("part", "bucket").cogroup(deal(model.table, "bucket", buckets).groupBy("part", "bucket")).applyInArrow(answer, "chunk int, bucket int, word_level binary, word_n binary, pair_level binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")  # the order of the n-grams
        tokens, words, pairs = _tokens(left.column("text").to_pylist())
        seen, exact = count_of(_joined(right.column("word_level"), np.uint8)), _joined(right.column("word_n"), np.int64)
        seen_pair = _joined(right.column("pair_level"), np.uint8)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for own in tokens:
            at = np.searchsorted(words, own.word)  # sorted in sorted
            c, single = exact[at][own.index], seen[at][own.index]
            context = np.concatenate((seen[at[own.end]][None], single[:-1]))
            keys = own.pairs()
            order = np.argsort(keys)
            levels = np.empty(len(keys), np.uint8)
            levels[order] = seen_pair[np.searchsorted(pairs, keys[order])]
            ratio = np.minimum(count_of(levels) / np.maximum(context, 1), 1.0)
            weight = np.where(context > 0, PAIR_WEIGHT, 0.0)  # after an unseen token the word decides alone
            p = np.minimum((1 - weight) * (single + 1) / rows + weight * ratio, 1.0)
            for k, x in enumerate((own.count, np.add.reduceat((c > 0).astype(np.int64), own.first), np.add.reduceat(np.log10((c + 1) / rows), own.first), np.add.reduceat(np.log10(p), own.first))):
                out[k].append(x)
        a, b, base, scores = (np.concatenate(x) if x else np.zeros(0) for x in out)
        release_memory()
        return pa.table({"doc_id": left.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(a, pa.int64()), "n_known": pa.array(b, pa.int64()), "train_tokens": pa.array(np.full(len(a), total), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())})

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("part", "chunk").cogroup(deal(answered, "chunk", n_chunks).groupBy("part", "chunk")).applyInArrow(run, schema)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size < SLICE_BYTES):
            size += len(texts[end])
            end += 1
        yield texts[k:end]
        k = end


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
