"""The prefix trie against brute force on small conversations, and its searches against plain loops."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = (*own.get(c - int(np.fmod(c, 5)), [])[:h], *t[h:])
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = {p[:-1] for p in nodes if p}
        ends = ",".join(str(c) for c in sorted(m for m in members if whole[m] == path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), sum(p not in kids for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def answer(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for c in [*range(60), *range(200, 215), 1001, -7, -5]:
        shared = c % 3 != 0
        for k in range(int(rng.integers(1, 14))):
            text = f"é turn {k}" if shared and k < 6 else f"turn {rng.integers(3)}"
            out.append((c, k, "user" if k % 2 == 0 else "assistant", text))
    out += [(300, None, None, None), (300, 0, "", "x"), (300, 0, "", "x"), (300, 0, "a", "y"), (300, 0, "a", "z"), (None, 1, "user", "nobody"), (301, 0, "user", "w" * 100_000)]
    out += [(302, k, "user", "again") for k in range(700)] + [(303, k, "user", "again") for k in range(650)]
    return out


@pytest.mark.parametrize("part,pieces", [(200_000, 4096), (20, 2)])
def test_against_brute_force(spark, monkeypatch, rows, part, pieces):
    monkeypatch.setattr(prefix_trie, "PART_TURNS", part)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", pieces)
    df = spark.createDataFrame(rows, ROWS)
    for c in ("base", "key", "pid", "node", "n", "turns", "sizes", "depth"):
        df = df.withColumn(c, F.lit("x"))
    short = [r for r in rows if r[0] not in (302, 303)]
    assert answer(prefix_trie.prefix_trie(df.where("conv_id IS NULL OR conv_id NOT IN (302, 303)"))) == brute(short)
    assert len(answer(prefix_trie.prefix_trie(df))) > 600


def test_equals_brute_force_on_the_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(prefix_trie.op13_prefix_trie(spark, small)) == brute(rows)


def test_many_conversations_alike(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(5 * c, k, "user", f"{k}") for c in range(300) for k in range(2)]
    assert answer(prefix_trie.prefix_trie(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_empty_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], ROWS)).count() == 0


def test_extents_against_loops():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 100):
        lcp = rng.integers(0, 5, n)
        lcp[0] = -1
        at, depth = rng.integers(0, n, 200), rng.integers(0, 5, 200)
        left, right = prefix_trie.extents(prefix_trie.RangeMinimum(lcp), n, at, depth)
        for a, d, x, y in zip(at, depth, left, right, strict=True):
            lo = hi = a
            while lo > 0 and lcp[lo] >= d:
                lo -= 1
            while hi < n - 1 and lcp[hi + 1] >= d:
                hi += 1
            assert (lo, hi) == (x, y)
