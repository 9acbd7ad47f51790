"""MinHash near-duplicates against all pairs of whole shingle sets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import minhash

DOCS = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def brute(rows):
    """All pairs: ``(doc_id, n_shingles, component_id, kept)`` of each row."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocab = [f"W{k}" for k in range(500)]
    out = []
    for g in range(12):
        base = list(rng.choice(vocab, int(rng.integers(30, 200))))
        for c in range(8):  # copies of copies: chains of links
            out.append((100 * g + c, " ".join(base)))
            for _ in range(int(rng.integers(0, 5))):
                base[int(rng.integers(len(base)))] = str(rng.choice(vocab))
    out += [(5000 + k, " ".join(rng.choice(vocab, 60))) for k in range(30)]
    out += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, "One two"), (6004, "one  TWO"), (6005, "one two three"), (6006, "É one two"), (6007, "é one two"), (6008, "x " * 50_000), (6009, "X " * 9), (None, "no id at all here"), (None, None), (3, out[0][1]), (3, out[0][1]), (7, None)]
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_against_all_pairs(spark, monkeypatch, rows, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    for c in ("node", "bucket", "key", "digest", "set", "sig", "class", "component", "n", "a"):
        df = df.withColumn(c, F.lit("x"))
    assert answer(minhash.near_duplicates(df)) == brute(rows)


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(minhash.op11_minhash(spark, small)) == brute(docs)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block", [2, 1000])
def test_links_that_the_first_round_misses(spark, monkeypatch, block):
    """A bucket whose first member is far from two others that are near each other."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(1000)]
    base = list(rng.choice(words, 100, replace=False))
    far = base[:62] + list(rng.choice(words, 38))
    rows = [(0, " ".join(far))]
    for k in range(1, 7):
        own = list(base)
        own[k * 14] = f"z{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    _, nodes = minhash.signed_nodes(df)
    first = nodes.where("least = 0").first().node
    members = nodes.select(F.lit(7).cast("long").alias("bucket"), "node", F.lit(first).alias("first"), F.lit(7).alias("m"))
    monkeypatch.setattr(minhash, "BLOCK", block)
    links = [(r.a, r.b) for r in minhash.links_of(df, nodes, members).collect()]
    of = {r.node: r.least for r in nodes.collect()}
    found = {frozenset((of[a], of[b])) for a, b in links}
    assert {x for pair in found for x in pair} == set(range(1, 7)) and len(found) >= 5  # one tree over the six


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    off = []
    for share in (0.5, 0.7, 0.8, 0.9):
        for _ in range(30):
            n = 400
            common = int(2 * n * share / (1 + share))
            both = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(both[:n]), np.sort(both[n - common :])
            planes, _ = minhash.signatures([a, b])
            x = planes.view(np.uint64)
            off.append(minhash.estimates(x[0], x[1]) - common / (2 * n - common))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_bands_miss_few_pairs():
    rng = np.random.default_rng(9)
    met = []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        _, bands = minhash.signatures([np.sort(both[:90]), np.sort(both[10:])])
        met.append((bands[0] == bands[1]).any())
    assert np.mean(met) == 1
