"""SimHash near-duplicates: a binary-trie self-join over the fingerprints.

Fingerprints that differ in at most ``budget`` bits agree in at least one of ``budget + 1`` bit
blocks, so each distinct fingerprint goes to one unit of work per block. A unit walks its sorted
fingerprints as a binary trie, two nodes at a time, adds up the bits in which the two differ and
drops a node pair as soon as the budget is spent. Units with too many fingerprints are first split
on their most balanced bits into node pairs of their own, as often as it takes. A unit returns a
spanning forest of its links, never all pairs, and the forests meet in connected components.

The pipeline's stage asks for five-word shingles and a similarity of 0.8, at which fingerprints differ
in far more bits than such blocks can bear. It uses wide fingerprints, whose differing bits estimate the
similarity closely, and units of fingerprints that agree in a random sample of bits, TABLES of them;
within a unit the same trie walk finds the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import connected_components, materialise, portions, releasing, whole_text

BUDGET = 2
#: A unit of work with more fingerprints than this is split.
UNIT_ROWS = 1500
#: Bits on which a unit is split at once.
SPLIT_BITS = 6
#: Node pairs that are walked at once, which bounds the memory of a task.
FRONTIER = 400_000
SEED = 42

#: The stage's near copies: word shingles of this size with at least this Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a wide fingerprint.
WORDS = 4
#: Samples of bits, and the bits of each: fingerprints that agree in one sample meet in a unit.
TABLES, TABLE_BITS = 48, 18
#: Fingerprints of a unit beyond which it is walked in blocks, and of a block; rows of units that are walked together.
PART_ROWS, WALK_ROWS = 1500, 50_000


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text; 0 where it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row; fp is the unsigned fingerprint's bits as a long.

    Null and blank texts get fingerprint zero. Repeated ids keep their rows; extra columns are not
    read; an empty table gives no rows.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def _split_points(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First place in each sorted node [lo, hi) at which the bit is set."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1) << np.uint64(bit)
    while (live := lo < hi).any():
        mid = (lo + hi) >> 1
        up = live & ((fp[np.minimum(mid, len(fp) - 1)] & mask) == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)
    return lo


def trie_links(fp: np.ndarray, nodes: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Forest over the fingerprints: for each place its parent's, itself for a root.

    ``nodes`` has rows (lo1, hi1, lo2, hi2): pairs of sorted runs of ``fp`` that are walked against
    each other; both the same for a self-join. A fingerprint is a number or a row of numbers, the
    most significant first. Neighbours within the budget are linked beforehand, and node pairs within
    one tree of the forest are dropped, so a crowd of near copies isn't walked pair by pair.
    """
    parent = np.arange(len(fp))
    fp = fp.reshape(len(fp), -1)
    top = 64 * fp.shape[1] - 1

    def link(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = root(i), root(j)
            differ = i != j
            i, j = i[differ], j[differ]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))

    def root(i: np.ndarray) -> np.ndarray:
        while True:
            up = parent[i]
            if (up == i).all():
                return i
            parent[i] = parent[up]
            i = up

    def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)

    def ends_of_trees() -> tuple[np.ndarray, np.ndarray]:
        """Each place's root, and the next place with another one."""
        tree = root(np.arange(len(fp)))
        change = np.flatnonzero(np.r_[tree[1:] != tree[:-1], True]) + 1
        return tree, np.repeat(change, np.diff(np.r_[0, change]))

    own = nodes[(nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] - nodes[:, 0] > 8)] if len(nodes) else nodes
    if len(own):  # neighbours at several distances, within the runs that are joined with themselves
        begin = np.repeat(own[:, 0], own[:, 1] - own[:, 0])
        place = np.arange(len(begin)) - np.repeat(np.cumsum(own[:, 1] - own[:, 0]) - (own[:, 1] - own[:, 0]), own[:, 1] - own[:, 0])
        size = np.repeat(own[:, 1] - own[:, 0], own[:, 1] - own[:, 0])
        for step in (1, 2, 5, 11):
            i = begin + place
            j = i + step
            i, j = i[place + step < size], j[place + step < size]
            near = apart(i, j) <= budget
            link(i[near], j[near])
    tree, until = ends_of_trees()
    stack = [(top, np.column_stack([nodes, np.full(len(nodes), budget)]))] if len(nodes) else []
    while stack:
        bit, pairs = stack.pop()
        one_tree = (tree[pairs[:, 0]] == tree[pairs[:, 2]]) & (until[pairs[:, 0]] >= pairs[:, 1]) & (until[pairs[:, 2]] >= pairs[:, 3])
        pairs = pairs[~one_tree]
        if not len(pairs):
            continue
        if len(pairs) > FRONTIER:
            stack += [(bit, pairs[: len(pairs) // 2]), (bit, pairs[len(pairs) // 2 :])]
            continue
        l1, h1, l2, h2, left = pairs.T
        same = l1 == l2
        done = ~same & (h1 - l1 == 1) & (h2 - l2 == 1)
        if done.any():
            near = apart(l1[done], l2[done]) <= budget
            link(l1[done][near], l2[done][near])
            if near.any():
                tree, until = ends_of_trees()
        if bit < 0:
            # the same fingerprint more than once
            for a, b, c, d, _ in pairs[~done & ~(same & (h1 - l1 == 1))]:
                link(np.arange(a, b), np.full(b - a, a))
                link(np.arange(c, d), np.full(d - c, a))
            continue
        pairs = pairs[~done & ~(same & (h1 - l1 == 1))]
        if not len(pairs):
            continue
        l1, h1, l2, h2, left = pairs.T
        same = l1 == l2
        column, low = fp[:, (top - bit) // 64], bit % 64
        m1, m2 = _split_points(column, l1, h1, low), _split_points(column, l2, h2, low)
        children = [np.column_stack(x) for x in ((l1, m1, l2, m2, left), (m1, h1, m2, h2, left), (l1, m1, m2, h2, left - 1))]
        children.append(np.column_stack((m1, h1, l2, m2, left - 1))[~same])
        down = np.concatenate(children)
        stack.append((bit - 1, down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] >= 0)]))
    return root(np.arange(len(fp)))


def _units(fps: DataFrame, budget: int, blocks: int) -> DataFrame:
    """A row for each fingerprint and choice of ``blocks - budget`` bit blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen) for chosen in combinations(range(blocks), blocks - budget)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    each = [F.concat_ws(":", F.lit(k), F.hex(F.col("fp").bitwiseAND(F.lit(m)))) for k, m in enumerate(signed)]
    return fps.select("fp", F.explode(F.array(*each)).alias("unit"), F.lit(0).alias("side"), F.lit(False).alias("crossing"))


def _prefix(bits: Column) -> Column:
    return F.aggregate(F.transform(bits, lambda b, k: F.call_function("shiftleft", F.getbit("fp", b).cast("long"), k)), F.lit(0).cast("long"), lambda a, x: a + x)


def _split(rows: DataFrame, hot: DataFrame, budget: int) -> DataFrame:
    """Units in ``hot`` dealt into node pairs of the trie over their most balanced bits, as far apart as the budget lets them be."""
    rows = rows.join(hot, "unit")
    sums = rows.groupBy("unit").agg(F.array(*[F.struct(F.abs(F.sum(F.getbit("fp", F.lit(k))) * 2 - F.count("*")).alias("off"), F.lit(k).alias("bit")) for k in range(64)]).alias("s"))
    bits = sums.select("unit", F.transform(F.slice(F.sort_array("s"), 1, SPLIT_BITS), lambda x: x["bit"]).alias("bits"))
    masks = [sum(1 << k for k in chosen) for n in range(min(budget, SPLIT_BITS) + 1) for chosen in combinations(range(SPLIT_BITS), n)]
    p, q = F.col("p"), F.col("p").bitwiseXOR(F.col("m"))
    out = rows.join(bits, "unit").withColumn("p", _prefix(F.col("bits"))).withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    swap = F.when(F.col("crossing"), F.col("side") == 1).otherwise(p > q)
    return out.select(
        "fp",
        F.concat_ws("/", "unit", F.when(swap, F.concat_ws("-", q, p)).otherwise(F.concat_ws("-", p, q))).alias("unit"),
        F.when(swap, 1).otherwise(0).alias("side"),
        (F.col("crossing") | (F.col("m") != 0)).alias("crossing"),
    )


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Units one after another, some at a time; returns the links of each fingerprint to its root."""
    for table in portions(batches, ["unit"], WALK_ROWS):
        yield from _walked(table, budget)


def _walked(table: pa.Table, budget: int) -> Iterator[pa.RecordBatch]:
    unit = table.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    side = table.column("side").to_numpy()
    order = np.lexsort((fp, side, unit))
    fp, side, unit, cross = fp[order], side[order], unit[order], table.column("crossing").to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[starts[1:], len(fp)]
    own = ~cross[starts] & (ends - starts > 1)
    pairs = [np.column_stack((starts[own], ends[own], starts[own], ends[own]))]
    two = np.flatnonzero(cross[starts[:-1]] & (unit[starts[:-1]] == unit[starts[1:]]))
    pairs.append(np.column_stack((starts[two], ends[two], starts[two + 1], ends[two + 1])))
    root = trie_links(fp, np.concatenate(pairs), budget)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    a, b = fp[linked].view(np.int64), fp[root[linked]].view(np.int64)
    for k in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["a", "b"])


def near_fingerprints(fps: DataFrame, budget: int = BUDGET, unit_rows: int = UNIT_ROWS, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that span every class of the relation
    "differs in at most ``budget`` bits"; ``fps`` has one row per distinct fp.

    ``blocks`` is how many blocks the bits are cut into, ``budget + 1`` or more; with more of them units
    are smaller, but a fingerprint is in more of them. The links are the same.
    """
    blocks = blocks or budget + 1
    rows, links = _units(fps, budget, blocks), []
    for depth in range(64 // SPLIT_BITS + 1):
        hot = materialise(rows.groupBy("unit").count().where(F.col("count") > unit_rows).select("unit"), "hot")
        cold = rows
        if split := depth < 64 // SPLIT_BITS and hot.limit(1).count() > 0:
            cold = rows.join(hot, "unit", "left_anti")
        links.append(cold.select("fp", "unit", "side", "crossing").repartition("unit").sortWithinPartitions("unit").mapInArrow(releasing(partial(_walk, budget=budget)), "a long, b long"))
        if not split:
            break
        rows = materialise(_split(rows, hot, budget), "units")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id that links of near fingerprints reach.

    Equal fingerprints are one node, however many documents share it. Texts without words have
    fingerprint zero and link like any other. An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    classes = connected_components(near_fingerprints(nodes.select("fp"), budget))
    joined = nodes.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_budget(similarity: float = SIMILARITY, words: int = WORDS) -> int:
    """Differing bits up to which wide fingerprints link.

    Sets of a Jaccard similarity s have the cosine 2s / (1 + s), and each bit differs with the angle's
    share of a half turn. The estimate's spread is about 0.03 of the similarity at 256 bits.
    """
    return round(64 * words * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprints(texts: list[str | None], shingle: int = SHINGLE, words: int = WORDS) -> np.ndarray:
    """A row of ``words`` numbers for each text, from its different shingles of lower-cased words.

    A text of fewer words is one shingle; one without words has the fingerprint zero.
    """
    out = np.zeros((len(texts), words), np.uint64)
    seen: dict[bytes, int] = {}
    for k, text in enumerate(texts):
        split = (text or "").encode("utf-8", "replace").lower().split()
        if not split:
            continue
        hashes = np.array([seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in split], np.uint64)
        size = min(shingle, len(split))
        h = hashes[: len(hashes) - size + 1].copy()
        for j in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - size + 1 + j]
        h = np.unique(_mix(h))
        counts = np.zeros(64 * words, np.int64)
        for a in range(0, len(h), 1 << 14):
            bits = np.stack([_mix(h[a : a + (1 << 14)] + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))) for j in range(words)], axis=1)
            counts += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)
        if len(seen) > 200_000:
            seen.clear()
    return out


def _samples(fp: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables): the unit of each fingerprint in each table; sampled places are fixed by the table."""
    flat = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    rng = np.random.default_rng(SEED)
    weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return np.stack([(flat[:, rng.choice(flat.shape[1], bits, replace=False)] * weight).sum(axis=1, dtype=np.uint64) + np.uint64(t << 40) for t in range(tables)], axis=1)


_UNIT = "unit long, node long, fp binary"


def _sampled_units(batches: Iterator[pa.RecordBatch], tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 2000):
            part = batch.slice(k, 2000)
            units = _samples(_wide(part.column(1)), tables, bits).view(np.int64)
            again = pa.array(np.repeat(np.arange(len(part)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(units.ravel()), part.column(0).take(again), part.column(1).take(again)], ["unit", "node", "fp"])


def _wide(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _walk_units(batches: Iterator[pa.RecordBatch], budget: int, keys: tuple[str, ...] = ("unit",)) -> Iterator[pa.RecordBatch]:
    """Links of each unit to the roots of its forest. Units come one after another; few are held at once.

    Rows with a ``side`` make a pair of trie nodes: those of side 0 are walked against those of side 1.
    """

    def walk(rows: pa.Table) -> pa.RecordBatch:
        key = np.column_stack([rows.column(c).to_numpy() for c in keys])
        border = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[border, len(key)])
        many = np.flatnonzero(np.repeat(size, size) > 1)  # most fingerprints are alone in their units
        if not len(many):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        node, fp = rows.column("node").to_numpy()[many], _wide(rows.column("fp").take(pa.array(many)))
        side = rows.column("side").to_numpy()[many] if "side" in rows.column_names else np.zeros(len(many), np.int32)
        number = np.repeat(np.arange(len(size)), size)[many]
        order = np.lexsort((*fp.T[::-1], side, number))
        fp, node, number, side = fp[order], node[order], number[order], side[order]
        starts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (side[1:] != side[:-1])])
        ends = np.r_[starts[1:], len(number)]
        runs = np.column_stack((starts, ends, starts, ends))
        if "side" in rows.column_names:
            two = np.flatnonzero(number[starts[1:]] == number[starts[:-1]])
            runs = np.column_stack((starts[two], ends[two], starts[two + 1], ends[two + 1]))
        root = trie_links(fp, runs, budget)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

    yield from map(walk, portions(batches, list(keys), WALK_ROWS))


def _near_the_least(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            apart = np.bitwise_count(_wide(batch.column(1)) ^ _wide(batch.column(3))).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 2]).rename_columns(["a", "b"]).filter(pa.array(apart <= budget))


def table_sizes(n: int, budget: int, least_bits: int = TABLE_BITS, tables: int = TABLES, words: int = WORDS) -> tuple[int, int]:
    """Tables and bits of their samples for ``n`` fingerprints: bits so that evenly spread ones are some hundred
    to a unit, and as many tables as keep the chance that a pair at the budget meets."""
    bits = max(least_bits, math.ceil(math.log2(max(n, 1) / (PART_ROWS / 2))))
    stay = 1 - budget / (64 * words)
    missed = (1 - stay**least_bits) ** tables
    return (tables if bits == least_bits else math.ceil(math.log(missed) / math.log(1 - stay**bits))), bits


def wide_links(nodes: DataFrame, budget: int, tables: int = TABLES, bits: int = TABLE_BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """Links ``(a, b)`` between the ``nodes(node, fp)``, one row for each different wide fingerprint.

    Two fingerprints meet where they agree in one of ``tables`` samples of ``bits`` bits. In a unit of more
    than ``part_rows`` of them each is first compared with the least; where that and the other units leave
    more than one class, the fingerprints outside the largest class are walked against all, block by
    block. So every pair that meets is linked or in one class already, whatever the size of the unit. A
    unit gives a forest, never all pairs.
    """
    units = nodes.select("node", "fp").mapInArrow(releasing(partial(_sampled_units, tables=tables, bits=bits)), _UNIT)
    counted = units.groupBy("unit").agg(F.count("*").alias("n"), F.min(F.struct("node", "fp")).alias("least")).where(F.col("n") > part_rows)
    hot = materialise(counted.select("unit", "least.node", "least.fp"), "hot-units")
    walk = "a long, b long"
    if not hot.limit(1).count():
        return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(releasing(partial(_walk_units, budget=budget)), walk)
    cold = units.join(hot.select("unit"), "unit", "left_anti").repartition("unit").sortWithinPartitions("unit").mapInArrow(releasing(partial(_walk_units, budget=budget)), walk)
    crowd = materialise(units.join(hot.select("unit", F.col("node").alias("least"), F.col("fp").alias("least_fp")), "unit").where("node <> least"), "hot-rows")
    stars = crowd.select("node", "fp", "least", "least_fp").mapInArrow(partial(_near_the_least, budget=budget), walk)
    links = materialise(cold.unionByName(stars), "links")
    labelled = materialise(crowd.join(connected_components(links), "node", "left").select("unit", "node", "fp", F.coalesce("component", "node").alias("class")), "labelled")
    sizes = labelled.groupBy("unit", "class").agg(F.count("*").alias("m"))
    main = sizes.groupBy("unit").agg(F.max_by("class", F.struct("m", "class")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count("*").alias("k"))
    rows = labelled.join(main.where("k > 1"), "unit")
    np_, nq = F.ceil((F.col("all") - F.col("most")) / part_rows).cast("int"), F.ceil(F.col("all") / part_rows).cast("int")
    block = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), n).cast("int")
    few = rows.where(F.col("class") != F.col("main")).select("unit", block(0, np_).alias("p"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("q"), F.lit(0).alias("side"), "node", "fp")
    many = rows.select("unit", F.explode(F.sequence(F.lit(0), np_ - 1)).alias("p"), block(1, nq).alias("q"), F.lit(1).alias("side"), "node", "fp")
    keys = ("unit", "p", "q")
    left = few.unionByName(many).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(partial(_walk_units, budget=budget, keys=keys)), walk)
    return links.unionByName(left)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Near copies by wide fingerprints: ``(row, fp, uid)``, and ``(fp, component, first)`` for each different fp.

    The documents are stored once with their fingerprints and a number of their own, so that repeated
    rows, repeated ids and null ids stay apart. ``first`` is the first document of a fingerprint, a struct
    with its uid: least doc_id, nulls last, of equal ids the one stored first; the least ``first`` of a
    component is that of the class. Null and blank texts are alike. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = wide_fingerprints(batch.column(0).field("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in fps], pa.binary())], ["row", "fp"])

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    marked = whole.mapInArrow(releasing(run), f"row {whole.schema['row'].dataType.simpleString()}, fp binary")
    rows = materialise(marked.withColumn("uid", F.monotonically_increasing_id()), "fingerprinted")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), "uid")
    nodes = materialise(rows.groupBy("fp").agg(F.min(order).alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    budget = wide_budget(similarity)
    classes = connected_components(wide_links(nodes, budget, *table_sizes(nodes.count(), budget)))
    return rows, nodes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component"), "first")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies (five-word shingles, similarity 0.8) the first document stays.

    A document with a null id is kept like any other unless it is a copy; see ``near_copies`` for ties.
    """
    rows, classes = near_copies(docs)
    firsts = classes.groupBy("component").agg(F.min("first").alias("first")).select("first.uid")
    return rows.join(firsts, "uid", "left_semi").select("row.*")
