"""The pipeline against its stages by brute force."""

import base64
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_ops import DOCS, classes, docs_of

from tracemill.llm import common, decontamination, quality_rules, simhash


def plain_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    env = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in (0, 1, 2)}), "n_upper": sum(c.isupper() for c in t), "n_lower": sum(c.islower() for c in t),
    }
    return not any(eval(rule.replace(" AND ", " and "), {}, env) for _, rule in quality_rules.RULES)


def plain_wide(t):
    """The 256-bit fingerprint, bit by bit."""
    import xxhash

    top = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & top
        return x ^ x >> 31

    w = (t or "").encode().lower().split()
    size, out = min(5, len(w)), 0
    grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
    hashes = []
    for g in grams:
        h = 0
        for x in g:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(x, 42)) & top
        h = mix(h)
        hashes.append(sum(mix((h + (j + 1) * 0xC2B2AE3D27D4EB4F) & top) << 64 * j for j in range(4)))
    for b in range(256 if hashes else 0):
        out |= (2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b
    return out


def near(docs):
    fps = [plain_wide(t) for _, t in docs]
    return lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 39


def test_split_units_lose_no_link(spark):
    """Pairs at 0.8 to 0.95 among unrelated fingerprints in few units: split units find the classes of whole ones."""
    rng = np.random.default_rng(12)
    fps = [rng.integers(0, 1 << 63, 4, dtype=np.uint64) for _ in range(400)]
    pairs = 0
    for k in range(160):
        flip = np.zeros(256, bool)
        flip[rng.choice(256, int(rng.integers(12, 40)), replace=False)] = True
        fps.append(fps[k] ^ np.packbits(flip, bitorder="little").view(np.uint64))
        pairs += 1
    nodes = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(fps)], "node long, fp binary")

    def classes(part_rows, bits):
        found = common.connected_components(simhash.wide_links(nodes, 39, 60, bits, part_rows)).collect()
        return {r.node: r.component for r in found}

    whole = classes(1500, 3)  # units of 70 fingerprints
    assert classes(12, 3) == whole and sum(whole.get(400 + k) == whole.get(k, -1) for k in range(160)) >= 0.99 * pairs
    assert classes(12, 18) == classes(1500, 18)


def test_table_sizes_keep_the_recall():
    for n in (0, 1, 10_000, 10**8, 10**9, 10**11):
        tables, bits = simhash.table_sizes(n, 39)
        assert 1 - (1 - (1 - 39 / 256) ** bits) ** tables > 0.9 and n / 2**bits <= 1500
    assert simhash.table_sizes(10_000, 39) == (48, 18)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("part_rows", [1500, 12])
def test_near_copies(spark, part_rows, monkeypatch):
    """One row stays of each class: also with null and repeated ids, repeated rows, and a crowd of near copies."""
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(800)]
    fresh = lambda n: list(rng.choice(vocab, n))
    rows, group = [], []
    base = fresh(300)
    for k in range(150):  # a crowd of near copies, all different
        w = list(base)
        for p in rng.integers(0, 300, 2):
            w[p] = str(rng.choice(vocab))
        rows.append((500 + k, " ".join(w)))
        group.append("crowd")
    for k in range(60):
        w = fresh(200)
        rows.append((k, " ".join(w)))
        group.append(k)
        if k % 3 == 0:
            w[100] = "changed"
            rows.append((1000 + k, " ".join(w).upper()))
            group.append(k)
    lone, other = " ".join(fresh(90)), " ".join(fresh(90))
    rows += [(None, lone), (2000, " ".join(fresh(80))), (2000, " ".join(fresh(80))), (2001, rows[200][1]), (2002, other), (2002, other), (None, other), (2003, None), (2004, " \n")]
    group += ["lone", "a", "b", group[200], "other", "other", "other", "empty", "empty"]
    monkeypatch.setattr(simhash.wide_links, "__defaults__", (simhash.TABLES, simhash.TABLE_BITS, part_rows))
    monkeypatch.setattr(simhash, "table_sizes", lambda n, budget: (simhash.TABLES, simhash.TABLE_BITS))
    monkeypatch.setattr(simhash, "WALK_ROWS", 300)
    df = docs_of(spark, rows, extra=True)
    left = simhash.dedup_stage(spark, df, "")
    assert left.columns == df.columns
    want = {}
    for (i, t), g in zip(rows, group, strict=True):
        if g not in want or (i is not None, -(i or 0)) > (want[g][0] is not None, -(want[g][0] or 0)):
            want[g] = (i, t)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want.values())
    assert simhash.dedup_stage(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_near_copies_against_jaccard(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.size(F.split("text", " ")) >= 50).collect()]
    grams = [shingles(t) for _, t in docs]
    holders = {}
    for k, g in enumerate(grams):
        for x in g:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for own in holders.values() if len(own) < 100 for n, a in enumerate(own) for b in own[n + 1 :]}
    alike = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a, b in pairs}
    _, classes_of = simhash.near_copies(docs_of(spark, docs))
    rows, _ = simhash.near_copies(docs_of(spark, docs))
    fps = {r.doc_id: r.fp for r in rows.select("row.doc_id", "fp").collect()}
    component = {bytes(r.fp): r.component for r in classes_of.collect()}
    of = [component[bytes(fps[i])] for i, _ in docs]
    true = [p for p, s in alike.items() if s >= 0.8]
    assert len(true) > 20 and np.mean([of[a] == of[b] for a, b in true]) >= 0.95
    far = [p for p, s in alike.items() if s < 0.6]
    assert np.mean([of[a] == of[b] for a, b in far]) < 0.01


def test_pipeline(spark, small):
    import public_tokenizers as P

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if plain_quality(t)]
    label = classes(len(docs), near(docs))
    least = {}
    for k, (i, _) in enumerate(docs):
        least[label[k]] = min(i, least.get(label[k], i))
    docs = sorted((i, t) for k, (i, t) in enumerate(docs) if least[label[k]] == i)
    seen, cut = set(), []
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        cut.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    bench = [decontamination.word_hashes(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def holds(t):
        w = np.array([decontamination.word_hashes(t)], np.uint64)
        return any(decontamination.edit_distances(np.array([b], np.uint64), w, np.array([w.shape[1]]))[0][0] <= decontamination.allowed(len(b)) for b in bench)

    clean = {i: t for i, t in cut if not holds(t)}
    assert set(got) == set(clean)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in clean.items():
        assert got[i].text == t and got[i].ids == enc.encode_ordinary(t) and got[i].n_tokens == len(got[i].ids)


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
