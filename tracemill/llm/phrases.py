"""Phrase collocations: three-way quicksort of suffix pointers, with cohesion scores of the frequent phrases.

A phrase that occurs LEAST times is made of words and word pairs that do. Words are counted first, then
pairs of frequent words; what is frequent goes into a bitmap of fixed size, which tells where a suffix
of up to MOST words is to be cut (a bit too many only makes a suffix longer). The suffixes are then
dealt by their leading word over the cluster, or two words where the first is frequent, so that all
suffixes with one opening are in one place, and sorted there word by word with multikey quicksort: each round splits a run of pointers into
less, equal and greater at one word, the equal part's size is the count of the phrase up to that word,
and a part that is too small is left. Openings too frequent for one place are dealt by all their words;
the counts of their shorter phrases are then sums over the places.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, portions, releasing
from tracemill.llm.words import SEED, bitmap, in_bitmap, mix, text_portions, word_hashes

#: Occurrences of a candidate, its most words, the phrases returned for each language.
LEAST, MOST, TOP = 100, 5, 2000
#: A phrase goes where a longer one has this percentage of its occurrences.
CONTAINED = 100
#: Occurrences of a word from which its suffixes are dealt by two words, those of a pair from which they are dealt by all
#: words in HOT_PARTS, and the most such words and pairs.
HOT_WORD, HOT, MOST_HOT, HOT_PARTS = 500_000, 50_000, 2_000, 64
#: Text and suffixes that are at hand at once.
TEXT_BYTES, SUFFIXES = 4 << 20, 250_000
#: Suffixes that a task gathers before it combines equal ones, and those different ones beyond which it passes them on.
HELD, MOST_HELD = 600_000, 500_000
#: Partial tops for each language before the last ranking.
SALTS = 64

_U = np.uint64
_GAP = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _tokens(texts: list[bytes]) -> list[bytes]:
    """The words of some texts, ASCII letters lower-cased, with a gap between pieces."""
    return (_GAP.join([*texts, b""])).translate(_TABLE).replace(_GAP, b" \xff ").split()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for part in text_portions(batches, "text", TEXT_BYTES):
        own: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            own.setdefault(lang, []).append(text)
        for lang, texts in own.items():
            yield lang, _tokens(texts)


def _lang_hash(lang: str) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), SEED + 1))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, tokens in _by_lang(batches):
        counts = Counter(tokens)
        counts.pop(_GAP, None)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def word_keys(words: np.ndarray, lang: str) -> np.ndarray:
    return words ^ _lang_hash(lang)


def pair_keys(a: np.ndarray, b: np.ndarray, lang: str) -> np.ndarray:
    return mix(mix(a ^ _lang_hash(lang)) * _U(3) + b)


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, h, key, f)``: frequent words with their hash and their key for the bitmap."""
    for batch in batches:
        langs, h = batch.column(0).to_pylist(), _word_ids(batch.column(1).to_pylist())
        keys = h ^ np.array([_lang_hash(x) for x in langs], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h.view(np.int64)), pa.array(keys.view(np.int64)), batch.column(2)], ["lang", "word", "h", "key", "f"])


def _word_ids(tokens: list[bytes]) -> np.ndarray:
    """Hashes of words, none of them zero: zero is what comes after a suffix."""
    return np.maximum(word_hashes(tokens), _U(1))


def _frequent(lang: str, tokens: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' hashes, and which are frequent words."""
    h = _word_ids(tokens)
    gap = _word_ids([_GAP])[0]
    return h, (h != gap) & in_bitmap(words, word_keys(h, lang))


def _count_pairs(batches: Iterator[pa.RecordBatch], words: object) -> Iterator[pa.RecordBatch]:
    for lang, tokens in _by_lang(batches):
        h, ok = _frequent(lang, tokens, words.value)
        at = np.flatnonzero(ok[:-1] & ok[1:])
        key, n = np.unique(pair_keys(h[at], h[at + 1], lang), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def _mixed(rows: np.ndarray) -> np.ndarray:
    mixed = rows[:, 0]
    for k in range(1, MOST):
        mixed = mix(mixed * _U(3) + rows[:, k])
    return mixed


def _combined(rows: np.ndarray, n: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes as one row with their summed counts."""
    order = np.argsort(_mixed(rows))
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(n[order], first) if len(first) else n, whole[order][first]


def _packed(values: np.ndarray, border: np.ndarray) -> pa.Array:
    """The bytes of an array's rows in pieces."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(border) - 1, [None, pa.py_buffer((border * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _of_portion(lang: str, tokens: list[bytes], words: np.ndarray, pairs: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, ok = _frequent(lang, tokens, words)
    both = np.flatnonzero(ok[:-1] & ok[1:])
    key = pair_keys(h[both], h[both + 1], lang)
    goes_on = np.zeros(len(h) + MOST, bool)
    goes_on[both] = in_bitmap(pairs, key)
    padded = np.concatenate((h, np.zeros(MOST, np.uint64)))
    key, at = key[goes_on[both]], both[goes_on[both]]
    rows = np.zeros((len(at), MOST), np.uint64)
    rows[:, 0] = h[at]
    alive = np.ones(len(at), bool)
    for k in range(1, MOST):
        alive &= goes_on[at + k - 1]
        rows[:, k] = np.where(alive, padded[at + k], _U(0))
    return _combined(rows, np.ones(len(rows), np.int64), np.where(np.isin(key, hot), MOST, 2).astype(np.int32))


def _suffixes(batches: Iterator[pa.RecordBatch], words: object, pairs: object, hot: np.ndarray, hot_words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(lang, w1, part, rest, n, whole)``: for each leading word the different suffixes of a task's texts, packed.

    ``rest`` has the further words of each suffix, 0 after the last one, ``n`` how often it occurs. A word in
    ``hot_words`` comes in parts by the second word, a pair in ``hot`` in HOT_PARTS by all words. ``whole`` is the length
    from which phrases are counted in one place: 2, or MOST for pairs in ``hot``.
    """
    held: dict[str, list[tuple[np.ndarray, ...]]] = {}
    count = 0

    def told() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            rows, n, whole = _combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            part = np.where(np.isin(word_keys(rows[:, 0], lang), hot_words), rows[:, 1], _U(0))
            part = np.where(whole > 2, mix(rows[:, 1] + _mixed(rows) % _U(HOT_PARTS)), part).view(np.int64)
            order = np.lexsort((part, rows[:, 0]))
            rows, n, whole, part = rows[order], n[order], whole[order], part[order]
            first = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (part[1:] != part[:-1])]) if len(rows) else np.zeros(0, np.int64)
            for k in range(0, len(first), 5_000):
                own = first[k : k + 5_000]
                lo, hi = own[0], first[k + 5_000] if k + 5_000 < len(first) else len(rows)
                border = np.append(own, hi) - lo
                columns = [pa.array([lang] * len(own), pa.string()), pa.array(rows[own, 0].view(np.int64)), pa.array(part[own]), _packed(rows[lo:hi, 1:], border), _packed(n[lo:hi], border), pa.array(whole[own])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "w1", "part", "rest", "n", "whole"])
        held.clear()

    for lang, tokens in _by_lang(batches):
        held.setdefault(lang, []).append(part := _of_portion(lang, tokens, words.value, pairs.value, hot))
        count += len(part[0])
        del tokens, part
        if count > HELD:
            for own, parts in held.items():
                held[own] = [_combined(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            count = sum(len(p[0]) for parts in held.values() for p in parts)
            if count > MOST_HELD:
                yield from told()
                count = 0
    yield from told()


def multikey_quicksort(words: np.ndarray, weight: np.ndarray, least: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, length, count)`` of the phrases that rows of words begin with; 0 ends a row, ``weight`` is how often it occurs.

    All runs of pointers are split at once, each at its own pivot and depth. A part below ``least`` is
    left, unless it may hold phrases shorter than ``whole`` (of a row: the first length at which this
    place has all occurrences), which are returned whatever their count here.
    """
    pointers = np.arange(len(words))
    begin, size, depth = np.zeros(min(1, len(words)), np.int64), np.full(min(1, len(words)), len(words)), np.zeros(min(1, len(words)), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(begin):
        start = np.cumsum(size) - size
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(run)) - start[run] + begin[run]
        own = pointers[place]
        value = words[own, depth[run]]
        a, b, c = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        middle = pivot[run]
        side = (value >= middle).astype(np.int64) + (value > middle)
        part = 3 * run + side
        count = np.bincount(part, minlength=3 * len(size))
        mass = np.bincount(part, weights=weight[own], minlength=3 * len(size)).astype(np.int64)
        to = np.cumsum(count) - count  # where each part starts, among the places of this round
        target = np.empty(len(run), np.int64)
        for s in (0, 1, 2):
            mine = np.flatnonzero(side == s)
            rank = np.arange(len(mine))
            n = count[s::3]
            target[mine] = to[s::3][run[mine]] + rank - (np.cumsum(n) - n)[run[mine]]
        moved = np.empty_like(own)
        moved[target] = own
        pointers[place] = moved
        first = (begin[:, None] + (to.reshape(-1, 3) - start[:, None])).ravel()
        partial_until = np.maximum.reduceat(whole[own], start)
        length = np.repeat(depth + 1, 3)
        open_ = (mass >= least) | (length < np.repeat(partial_until, 3))
        equal = np.tile([False, True, False], len(size))
        ended = equal & (np.repeat(pivot, 3) == 0)
        going = (count > 0) & open_ & ~ended
        hit = np.flatnonzero(going & equal)
        row = pointers[first[hit]]
        tell = (mass[hit] >= least) | (length[hit] < whole[row])
        found.append((row[tell], length[hit][tell], mass[hit][tell]))
        going &= ~(equal & (length >= words.shape[1]))
        begin, size, depth = first[going], count[going], (length - 1 + equal)[going]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole places, with about SUFFIXES suffixes at a time."""
    for t in portions(batches, ["route"], 1):
        route, size = t.column("route").to_numpy(), pc.binary_length(t.column("n")).to_numpy() // 8
        begins = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
        upto = np.cumsum(size)[np.r_[begins[1:], len(route)] - 1]
        cut = [0, *(begins[np.flatnonzero(np.diff((upto - 1) // SUFFIXES)) + 1]).tolist(), len(route)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b > a:
                yield t.slice(a, b - a)


def _sorted_counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``(lang, words, f)`` of the phrases that places of suffixes hold."""
    for t in _places(batches):
        n = np.frombuffer(b"".join(t.column("n").to_pylist()), np.int64)
        size = pc.binary_length(t.column("n")).to_numpy() // 8
        lang = t.column("lang").combine_chunks().dictionary_encode()
        code = lang.indices.to_numpy().astype(np.uint64) + _U(1)
        opening = np.column_stack((code, t.column("w1").to_numpy().view(np.uint64)))
        words = np.column_stack((np.repeat(opening, size, axis=0), np.frombuffer(b"".join(t.column("rest").to_pylist()), np.uint64).reshape(-1, MOST - 1)))
        row, length, count = multikey_quicksort(words, n, least, np.repeat(t.column("whole").to_numpy(), size) + 1)
        keep = length > 2  # the language is the first word
        row, length, count = row[keep], length[keep] - 1, count[keep]
        flat = words[np.repeat(row, length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + 1]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(flat.view(np.int64)))
        own = np.repeat(np.arange(len(size)), size)[row]
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(lang.indices.take(pa.array(own))), lists, pa.array(count)], ["lang", "words", "f"])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words ``(lang, word, n)``, the frequent ones with their hashes, and the frequent phrases ``(lang, words, f)``, words as hashes."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words = materialise(rows.mapInArrow(releasing(_count_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    frequent = materialise(words.where(F.col("n") >= least).mapInArrow(_hash_words, "lang string, word binary, h long, key long, f long"), "frequent-words")
    word_bits = spark.sparkContext.broadcast(bitmap(frequent.select("key")))
    pairs = rows.mapInArrow(releasing(partial(_count_pairs, words=word_bits)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.where(F.col("n") >= least), "pairs")
    pair_bits = spark.sparkContext.broadcast(bitmap(pairs.select("key")))
    most = lambda df, count, least: np.array([r.key for r in df.where(F.col(count) >= least).orderBy(F.desc(count), "key").limit(MOST_HOT).collect()], np.int64).view(np.uint64)
    hot, hot_words = most(pairs, "n", HOT), most(frequent, "f", HOT_WORD)
    suffixes = rows.mapInArrow(releasing(partial(_suffixes, words=word_bits, pairs=pair_bits, hot=hot, hot_words=hot_words)), "lang string, w1 long, part long, rest binary, n binary, whole int")
    dealt = suffixes.withColumn("route", F.xxhash64("lang", "w1", "part")).repartition("route").sortWithinPartitions("route")
    found = dealt.mapInArrow(releasing(partial(_sorted_counts, least=least)), "lang string, words array<long>, f long")
    return words, frequent, materialise(found.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")


def _scored(words: DataFrame, frequent: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(lang, words, a, l, r, n, score)``: each phrase at its weakest cut, the earliest of equal ones."""
    counts = phrases.unionByName(frequent.select("lang", F.array("h").alias("words"), "f"))
    k, size = F.col("k"), F.size("words")
    cuts = phrases.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), k), "rest": F.slice("words", k + 1, size - k)})
    cuts = cuts.join(counts.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    exact = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c"))
    return best.select("lang", "words", "c.a", "c.l", "c.r", "c.n", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to MOST words.

    Null texts are empty, a null language is ``und``; repeated rows count each time; a text of any
    length is split within its row; other columns are not read; an empty table gives no rows. Of
    phrases with equal score and count the one that comes first as UTF-8 bytes ranks first. Words are
    told apart by 64-bit hashes; counts and scores are exact.
    """
    words, frequent, phrases = phrase_counts(docs, least)
    cuts = [F.slice("words", i, n) for n in range(2, MOST) for i in range(1, MOST - n + 2)]
    parts = F.filter(F.array(*[F.when(F.size("words") > F.size(x), x) for x in cuts]), lambda x: x.isNotNull() & (F.size(x) > 1))
    within = phrases.select("lang", "f", F.explode(F.array_distinct(parts)).alias("words")).groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = phrases.join(within, ["lang", "words"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("f"))).select("lang", "words")
    spelled = kept.select("lang", "words", F.posexplode("words").alias("at", "h")).join(frequent.select("lang", "h", F.col("word").cast("string").alias("word")), ["lang", "h"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = _scored(words, frequent, phrases).join(spelled, ["lang", "words"])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = rows.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS g FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m),
counts AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM counts WHERE m > 1 AND f >= 100),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN total t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
subs AS (
  SELECT lang, g[i:i + s - 1] AS g, max(f) AS longer FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand)) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score
  FROM best b LEFT JOIN subs s ON s.lang = b.lang AND s.g = b.g WHERE longer IS NULL OR 100 * longer < 100 * a)
WHERE rank <= 2000
"""
