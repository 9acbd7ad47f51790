"""Phrase collocations against brute force, and the quicksort against counting."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import phrases

DOCS = "doc_id long, text string, lang string"
UPPER = {k: k + 32 for k in range(65, 91)}


def brute(rows, least, top=2000):
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang != "" else ""
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for k in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[k : k + m])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        inside = {}
        for p, f in cand.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside.get(p[k : k + m], 0), f)
        ranked = []
        for p, a in cand.items():
            if 100 * inside.get(p, -1) >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, j + 1, p.decode(), -a, x, y, n[lang], -s) for j, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def answer(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    vocab = ["The", "of", "a", "New", "york", "é", "ſ", "x" * 300, "\x00", "\x1c", "c-d", "#"]
    p = rng.dirichlet(np.ones(len(vocab)))
    out = []
    for d in range(150):
        w = rng.choice(vocab, int(rng.integers(0, 60)), p=p)
        out.append((d, "".join(x + str(rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b", "! "], p=[0.7, 0.08, 0.08, 0.04, 0.02, 0.02, 0.02, 0.02, 0.02])) for x in w), ["en", "fr", None, ""][d % 4]))
    out += [(500 + d, "terms and conditions apply here always", "en") for d in range(20)] + [(600, None, "en"), (601, "", None), (602, " .,;", "en"), (600, "the of the of " * 20_000, "de")]
    return out


@pytest.mark.parametrize("hot,most,suffixes", [(50_000, 2000, 250_000), (5, 3, 10)])
def test_against_brute_force(spark, monkeypatch, rows, hot, most, suffixes):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "HOT_WORD", 4 * hot)
    monkeypatch.setattr(phrases, "MOST_HOT", most)
    monkeypatch.setattr(phrases, "SUFFIXES", suffixes)
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n", "f", "words", "word", "h", "key", "route", "whole", "w1", "rank", "salt"):
        df = df.withColumn(c, F.lit("x"))
    assert answer(phrases.collocations(df, 10)) == brute(rows, 10)
    assert answer(phrases.collocations(df, 6, 7)) == brute(rows, 6, 7)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    big = 4_000_000_000
    words = spark.createDataFrame([("en", b"x", 3 * big)], "lang string, word binary, n long")
    frequent = spark.createDataFrame([("en", b"a", 1, 1, 2 * big), ("en", b"b", 2, 2, big + 1)], "lang string, word binary, h long, key long, f long")
    found = phrases._scored(words, frequent, spark.createDataFrame([("en", [1, 2], big)], "lang string, words array<long>, f long")).first()
    assert found.score == 1000 * big * 3 * big // (2 * big * (big + 1))


@pytest.mark.parametrize("seed", range(6))
def test_quicksort_against_counting(seed):
    rng = np.random.default_rng(seed)
    n, least = int(rng.integers(0, 400)), int(rng.integers(1, 12))
    length = rng.integers(2, 6, n)
    words = rng.integers(1, int(rng.integers(2, 6)), (n, 5)).astype(np.uint64)
    words[np.arange(5)[None, :] >= length[:, None]] = 0
    weight = rng.integers(1, 5, n)
    want = Counter()
    for row, w in zip(words.tolist(), weight.tolist(), strict=True):
        for m in range(1, 6):
            if row[m - 1]:
                want[tuple(row[:m])] += w
    row, m, count = phrases.multikey_quicksort(words, weight, least, np.full(n, 1, np.int32))
    got = [(tuple(words[r, :k].tolist()), c) for r, k, c in zip(row, m, count, strict=True)]
    assert len(got) == len(dict(got)) and dict(got) == {p: c for p, c in want.items() if c >= least}
    row, m, count = phrases.multikey_quicksort(words, weight, least, np.full(n, 4, np.int32))
    assert dict((tuple(words[r, :k].tolist()), c) for r, k, c in zip(row, m, count, strict=True)) == {p: c for p, c in want.items() if c >= least or len(p) < 4}


def test_places_are_cut_between_openings(monkeypatch):
    """Some suffixes at a time, openings whole: the counts of all at once."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(phrases, "SUFFIXES", 10)
    monkeypatch.setattr(phrases, "HELD", 40)
    monkeypatch.setattr(phrases, "MOST_HELD", 30)
    monkeypatch.setattr(phrases, "TEXT_BYTES", 200)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), 30)) for _ in range(20)]
    full = types.SimpleNamespace(value=np.full(1 << 23, 255, np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array([t.encode() for t in texts])], ["lang", "text"])
    rows = pa.Table.from_batches(phrases._suffixes(iter([batch]), full, full, np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    route = rows.column("w1")
    rows = rows.append_column("route", route).sort_by("route")
    counts = Counter()
    ids = {int(phrases._word_ids([c.encode()])[0].view(np.int64)): c for c in "abcd"}
    for out in phrases._sorted_counts(iter(rows.to_batches(max_chunksize=3)), 2):
        for r in out.to_pylist():
            counts["".join(ids[w] for w in r["words"])] += r["f"]
    want = Counter()
    for t in texts:
        w = t.replace(" ", "")
        want.update(w[k : k + m] for m in range(2, 6) for k in range(len(w) - m + 1))
    assert counts == {p: f for p, f in want.items() if f >= 2}
