"""Byte-level BPE by recursive SQL inside each partition.

Spark deals out the texts. Within a task the distinct pre-tokens ("words") that are not known yet
go to DuckDB as token-position rows; a recursive query joins neighbouring tokens with the merge
table and contracts each word's leftmost pair of least rank until no pair merges. A word that is a
token by itself is that token, as in the tiktoken library. In a long word, pairs further apart than
the longest token can't reach each other, so many are contracted in one turn. Decoding joins
token-position rows with the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from collections.abc import Iterator
from functools import cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import releasing, whole_text

#: Words that a worker remembers; beyond it only those met most often stay, which bounds its memory.
REMEMBERED = 400_000
#: Position rows that one recursive query handles (more only for a single longer word).
ROWS_AT_ONCE = 200_000
#: Words of more bytes are contracted at many places in one turn.
LONG = 64
#: Characters of text, or words of one very long text, that are looked at at once.
CHARS_AT_ONCE, WORDS_AT_ONCE = 2_000_000, 400_000

#: A place is the word's number and the position in it; a choice is the merged token and the position.
#: Neighbours are read off the order of the rows, which is checked: rows out of order are an error.
_ENCODE = """
WITH RECURSIVE step(place, tok, done) AS (
  SELECT place, tok, false FROM fresh
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT q.place, q.tok, q.place >> 32 AS word, (m.merged << 32) + (q.place & 4294967295) AS choice,
       CASE WHEN q.prior >= q.place THEN error('rows out of order') ELSE q.prior END AS prior
     FROM (SELECT place, tok, (tok << 32) + CASE WHEN (lead(place) OVER w) >> 32 = place >> 32 THEN lead(tok) OVER w END AS pair, lag(place) OVER w AS prior
           FROM step WHERE NOT done WINDOW w AS ({order})) q
     LEFT JOIN merges m ON m.pair = q.pair),
   best AS (SELECT word, min(choice) AS choice, (word << 32) + (min(choice) & 4294967295) AS spot FROM pairs GROUP BY word)
   SELECT p.place, CASE WHEN p.place = b.spot THEN b.choice >> 32 ELSE p.tok END, b.choice IS NULL
   FROM pairs p JOIN best b ON b.word = p.word
   WHERE b.choice IS NULL OR p.prior IS NULL OR p.prior <> b.spot)
)
SELECT place, tok FROM step WHERE done ORDER BY place
"""
#: The same for long words. A pair is contracted if its rank is the least within ``reach`` tokens on either
#: side: what lies beyond can only come near by a token longer than any there is. Of equal ranks the
#: leftmost goes; every second one of a row of them, if no pair with the merged token has a lesser rank.
_ENCODE_LONG = """
WITH RECURSIVE step(place, tok, done) AS (
  SELECT place, tok, false FROM fresh
  UNION ALL
  (WITH pairs AS (
     SELECT q.place, q.tok, q.place >> 32 AS word, q.nth, m.merged, m.safe, (m.merged << 32) + (q.place & 4294967295) AS choice
     FROM (SELECT place, tok, row_number() OVER w AS nth, (tok << 32) + CASE WHEN (lead(place) OVER w) >> 32 = place >> 32 THEN lead(tok) OVER w END AS pair
           FROM step WHERE NOT done WINDOW w AS (ORDER BY place)) q
     LEFT JOIN merges m ON m.pair = q.pair),
   runs AS (
     SELECT *, min(choice) OVER (PARTITION BY word ORDER BY place ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least, count(merged) OVER (PARTITION BY word) AS live,
       CASE WHEN merged IS DISTINCT FROM lag(merged) OVER (PARTITION BY word ORDER BY place) THEN nth END AS begins
     FROM pairs),
   taken AS (
     SELECT place, tok, word, merged, live, coalesce(merged = least >> 32
       AND (choice = least OR safe AND (nth - max(begins) OVER (PARTITION BY word ORDER BY place ROWS UNBOUNDED PRECEDING)) % 2 = 0), false) AS take
     FROM runs)
   SELECT place, tok, done FROM (
     SELECT place, CASE WHEN take THEN merged ELSE tok END AS tok, live = 0 AS done, coalesce(lag(take) OVER (PARTITION BY word ORDER BY place), false) AS gone FROM taken)
   WHERE NOT gone)
)
SELECT place, tok FROM step WHERE done ORDER BY place
"""
_DECODE = "SELECT t.word, list(v.bytes ORDER BY t.pos) AS bytes FROM tokens t JOIN vocab v ON v.tok = t.tok GROUP BY t.word ORDER BY t.word"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def narrow_pattern(pattern: str, top: int = 0x250) -> str | None:
    """The pattern with its classes spelled out for texts of characters below ``top``; None if it has others."""
    spelled = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        own = [c for c in range(top) if regex.fullmatch(name, chr(c))]
        edges = [k for k in range(len(own)) if not k or own[k] != own[k - 1] + 1]
        spelled[name] = "".join(f"\\u{own[a]:04x}-\\u{own[b - 1]:04x}" for a, b in zip(edges, [*edges[1:], len(own)], strict=True))
    out, inside, k = [], False, 0
    while k < len(pattern):
        name = next((n for n in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(n, k)), pattern[k])
        if name == "\\" or inside and name == r"\S":
            return None
        if name in spelled:
            out.append(spelled[name] if inside else f"[{spelled[name]}]")
        elif name == r"\S":
            out.append(f"[^{spelled[chr(92) + 's']}]")
        else:
            inside = inside and name != "]" or name == "["
            out.append(name)
        k += len(name)
    return "".join(out)


_WIDE = re.compile("[^\x00-\u024f]").search


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + count]`` one after another."""
    return values[np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)]


class Coder:
    """Encodes words and decodes ids with one vocabulary; remembers what it has encoded."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.wide = regex.compile(pattern)
        narrow = narrow_pattern(pattern)
        self.narrow = re.compile(narrow) if narrow else self.wide
        self.single = np.zeros(256, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, merged = np.array(pairs, np.int64).T
        lowest = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, np.concatenate((a, b)), np.concatenate((merged, merged)))
        self.reach = max(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "160MB", "temp_directory": tempfile.gettempdir()})
        self._table("merges", pa.table({"pair": (a << 32) + b, "merged": merged, "safe": lowest[merged] > merged}))
        self._table("vocab", pa.table({"tok": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())}))
        self._forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[bytes], long: bool) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), n)
        self._table("fresh", pa.table({"place": (word << 32) + np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n), "tok": self.single[raw]}))
        if long:
            found = self.db.sql(_ENCODE_LONG.format(reach=self.reach)).to_arrow_table()
        else:
            try:
                found = self.db.sql(_ENCODE.format(order="")).to_arrow_table()
            except duckdb.InvalidInputException:  # the rows came in another order: sort them in each turn
                found = self.db.sql(_ENCODE.format(order="ORDER BY place")).to_arrow_table()
        return found.column("tok").to_numpy(), np.bincount(found.column("place").to_numpy() >> 32, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has. An empty word has none."""
        own = [self.ranks.get(w, -1) for w in words]
        ids, count = np.array(own, np.int64), np.ones(len(words), np.int64)
        parts, at = [ids], np.arange(len(words))  # where each word's ids begin in the parts
        after = len(words)
        for long in (False, True):
            todo = [k for k, w in enumerate(words) if own[k] < 0 and (len(w) > LONG) == long]
            k = 0
            while k < len(todo):
                end, rows = k, 0
                while end < len(todo) and (end == k or rows + len(words[todo[end]]) <= ROWS_AT_ONCE):
                    rows += len(words[todo[end]])
                    end += 1
                found, n = self._contract([words[j] for j in todo[k:end]], long) if rows else (ids[:0], np.zeros(end - k, np.int64))
                count[todo[k:end]] = n
                at[todo[k:end]] = after + np.cumsum(n) - n
                parts.append(found)
                after += len(found)
                k = end
        return _gather(np.concatenate(parts), at, count), count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of id sequences given one after another, and how many bytes each has."""
        word = np.repeat(np.arange(len(count)), count)
        self._table("tokens", pa.table({"word": word, "pos": np.arange(len(ids)), "tok": ids.astype(np.int64)}))
        found = self.db.sql(_DECODE).to_arrow_table()
        pieces = found.column("bytes").combine_chunks()
        flat = pieces.flatten()
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
        raw = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(flat) else np.zeros(0, np.uint8)
        size = np.zeros(len(count), np.int64)
        size[found.column("word").to_numpy()] = np.diff(ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()])
        return raw, size

    def _forget(self, most: int = 0) -> None:
        """Keep only the ``most`` words met most often."""
        if not most:
            self.number: dict[str, int] = {}
            self.ids, self.raw = np.zeros(0, "<u4"), np.zeros(0, np.uint8)
            self.n_ids, self.n_raw, self.met = (np.zeros(0, np.int64) for _ in range(3))
            return
        stay = np.sort(np.argsort(-self.met, kind="stable")[:most])
        words = list(self.number)
        self.number = {words[k]: j for j, k in enumerate(stay.tolist())}
        self.ids = _gather(self.ids, (np.cumsum(self.n_ids) - self.n_ids)[stay], self.n_ids[stay])
        self.raw = _gather(self.raw, (np.cumsum(self.n_raw) - self.n_raw)[stay], self.n_raw[stay])
        self.n_ids, self.n_raw, self.met = self.n_ids[stay], self.n_raw[stay], self.met[stay] // 2

    def rest(self) -> None:
        """Between tasks only the words met most often are remembered: an idle worker stays small."""
        if len(self.number) > REMEMBERED // 4:
            self._forget(REMEMBERED // 4)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Each word's place among the known ones; those not known yet are encoded and decoded."""
        number = self.number
        found = list(map(number.get, words))
        if None in found:
            unknown = [k for k, x in enumerate(found) if x is None]
            for k in unknown:
                found[k] = number.setdefault(words[k], len(number))
            fresh = [w.encode() for w in islice(number, len(self.n_ids), None)]
            ids, n_ids = self.encode_words(fresh)
            raw, n_raw = self.decode(ids, n_ids)
            self.ids, self.n_ids = np.concatenate((self.ids, ids.astype("<u4"))), np.concatenate((self.n_ids, n_ids))
            self.raw, self.n_raw = np.concatenate((self.raw, raw)), np.concatenate((self.n_raw, n_raw))
            self.met = np.concatenate((self.met, np.zeros(len(fresh), np.int64)))
        codes = np.array(found, np.int64)
        self.met[np.unique(codes)] += 1
        return codes

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and bytes of the words, and where each word's end."""
        if len(self.number) > REMEMBERED:
            self._forget(REMEMBERED // 2)
        codes = self._numbers(words)
        starts = [np.cumsum(n) - n for n in (self.n_ids, self.n_raw)]
        n, m = self.n_ids[codes], self.n_raw[codes]
        return _gather(self.ids, starts[0][codes], n), _gather(self.raw, starts[1][codes], m), np.cumsum(n), np.cumsum(m)

    def both(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes of each text. Few texts at once, so that memory stays bounded."""
        at = 0
        while at < len(texts):
            finder = self.wide if _WIDE(texts[at]) else self.narrow
            if len(texts[at]) > CHARS_AT_ONCE:
                matches, parts = finder.finditer(texts[at]), []
                while words := [m[0] for m in islice(matches, WORDS_AT_ONCE)]:
                    parts.append(self._coded(words)[:2])
                yield np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts])
                at += 1
                continue
            words, ends, chars = [], [0], 0
            while at < len(texts) and chars + len(texts[at]) <= CHARS_AT_ONCE:
                words += (self.wide if _WIDE(texts[at]) else self.narrow).findall(texts[at])
                ends.append(len(words))
                chars += len(texts[at])
                at += 1
            ids, raw, n, m = self._coded(words)
            cut = [np.concatenate(([0], x))[ends].tolist() for x in (n, m)]
            for k in range(len(ends) - 1):
                yield ids[cut[0][k] : cut[0][k + 1]], raw[cut[1][k] : cut[1][k + 1]]


@cache
def coder(path: str, pattern: str) -> Coder:
    """One coder for each worker process."""
    return Coder(path, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with two more columns: the token ids and the bytes that they decode to.

    A null or empty text has no ids. ``path`` is a rank file that every executor can open. Columns of
    ``docs`` with the new names are replaced; rows are neither dropped nor merged.
    """
    path, pattern = _vocabulary(path, pattern)
    docs = docs.drop(ids_col, decoded_col)
    schema = f"row {docs.select(F.struct('*').alias('row')).schema['row'].dataType.simpleString()}, ids array<bigint>, decoded binary"

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            rows = batch.column(0)
            texts = [t or "" for t in rows.field(text_col).to_pylist()]
            k = 0
            while k < len(texts):
                end, chars = k, 0
                while end < len(texts) and (end == k or chars + len(texts[end]) < 4_000_000):
                    chars += len(texts[end])
                    end += 1
                ids, raw = zip(*own.both(texts[k:end]), strict=True)
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.slice(k, end - k), lists, pa.array([r.tobytes() for r in raw], pa.binary())], ["row", "ids", "decoded"])
                k = end
        own.rest()

    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).mapInArrow(run, schema)
    return out.select("row.*", F.col("ids").alias(ids_col), F.col("decoded").alias(decoded_col))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` without sending the ids back to the JVM."""
    path, pattern = _vocabulary(path, pattern)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids, raw in own.both(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.rest()

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents with their token ids; the text is what the ids decode to, so a null text comes out empty."""
    coded = encode(docs)
    return coded.withColumn("text", F.col("decoded").cast("string")).withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")
