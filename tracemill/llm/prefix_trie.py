"""Prefix trie of conversations: range minima over the sorted conversations' common prefixes.

Each conversation is rebuilt as the sequence of its turns' digests. The different sequences are dealt
by range, so a partition has a stretch of their sorted order. Within it the number of turns that
neighbours have in common is put into a sparse table of range minima; each prefix that begins anew at
some sequence then finds the first and the last sequence that has it by two binary searches of its own,
with no stack and in no order. What a node needs of its subtree are sums over that interval. Prefixes
that reach over the border of a partition, at most as many as its first and last sequence have turns,
are merged by one small aggregation and brought back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, releasing

#: Conversations of a family, of which the first lends its opening, and the openings' lengths below this.
FAMILY, OPENINGS = 5, 9
#: Turns of a partition of sequences, and ids of one piece of a list of ids.
PART_TURNS, PIECE_IDS = 200_000, 4096
#: Bytes of a turn's digest.
WIDE = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, key, sizes)``: each conversation's turn digests joined, and the UTF-8 bytes of the turns' texts.

    Conversation c has the first h turns of conversation ``c - c % FAMILY`` and then its own turns after
    its first h, h being ``crc32(c) % OPENINGS``. Texts don't travel, only digests do.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDE)
    c = F.col("conv_id")
    turns = conversations.where("conv_id IS NOT NULL").select(
        (c - c % FAMILY).alias("base"), c.cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t")
    )
    each = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = F.struct("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))
    family = each.groupBy("base").agg(F.collect_list(own).alias("all"))  # FAMILY members at most, partitioned by base already
    head = F.coalesce(F.get(F.filter("all", lambda m: m["conv_id"] == F.col("base")), F.lit(0))["turns"], F.array().cast("array<struct<digest:string,size:bigint>>"))
    rows = family.select(head.alias("head"), F.explode("all").alias("m")).select("head", "m.conv_id", "m.turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(OPENINGS)).cast("int")
    whole = F.concat(F.slice("head", F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    rows = rows.select("conv_id", whole.alias("w"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("w", lambda t: t["digest"]), "")).alias("key"), F.transform("w", lambda t: t["size"]).alias("sizes"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, sequence after sequence and in order, to a row for each sequence; pieces are hashed as they come."""
    names = ["key", "sizes", "n", "least", "ends"]
    now, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, sizes, n, least, ids in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if now is not None and now[0] == key:
                now[2] += n
                now[3] = min(now[3], least)
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = [key, sizes, n, least], hashlib.sha256()
            state.update(ids.encode())
        yield _table(done, names)
    if now is not None:
        yield _table([(*now, state.hexdigest())], names)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def sequences(conversations: DataFrame) -> DataFrame:
    """``(key, sizes, n, least, ends)``: the different sequences, how many conversations have them, the least id, and
    the SHA-256 of their ids. A sequence that many conversations have is counted in pieces of id ranges first."""
    piece = F.floor(F.col("conv_id") / PIECE_IDS)
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")))
    pieces = rebuilt(conversations).groupBy("key", piece.alias("piece")).agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "sizes", "n", "least", "ids")
    return ordered.mapInArrow(releasing(_hashed), "key binary, sizes array<long>, n long, least long, ends string")


class RangeMinimum:
    """Minima of any stretch of an array in one step, from those of all stretches of 1, 2, 4, ... elements."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.table = np.zeros((len(self.rows), len(values)), values.dtype)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row
        del self.rows

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of ``values[first..last]``, both included; first must not be above last."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, first], self.table[k, last + 1 - (1 << k)])


def extents(minima: RangeMinimum, size: int, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the sorted sequences that have the first ``depth`` turns of sequence ``at``.

    ``minima`` are of the turns that each sequence has in common with the one before it. Each search
    is by itself: the interval goes on while no minimum falls below the depth.
    """
    lo, hi = np.zeros(len(at), np.int64), at.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) >> 1
        same = minima.of(mid + 1, at[live]) >= depth[live]
        hi[live] = np.where(same, mid, hi[live])
        lo[live] = np.where(same, lo[live], mid + 1)
    left = lo
    lo, hi = at.copy(), np.full(len(at), size - 1, np.int64)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live] + 1) >> 1
        same = minima.of(at[live] + 1, mid) >= depth[live]
        lo[live] = np.where(same, mid, lo[live])
        hi[live] = np.where(same, hi[live], mid - 1)
    return left, lo


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // WIDE
    x, y = (np.frombuffer(k, np.uint64, 2 * n).reshape(n, 2) for k in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


class Stretch:
    """The nodes that a partition of sorted sequences has, each with its sums over the partition.

    ``before`` and ``after`` are the turns in common with the last sequence of the partition before
    and the first of the one after it, -1 where there is none.
    """

    def __init__(self, t: pa.Table):
        t = t.sort_by("key")
        self.size = n = len(t)
        self.keys = t.column("key").to_pylist()
        self.before, self.after = t.column("before")[0].as_py(), t.column("after")[0].as_py()
        self.ends = np.array(t.column("ends").to_pylist(), object)
        weight, least = t.column("n").to_numpy(), t.column("least").to_numpy()
        self.length = length = np.array([len(k) // WIDE for k in self.keys])
        offset = np.cumsum(length) - length
        turns = np.frombuffer(b"".join(self.keys), np.uint64).reshape(-1, 2)
        sizes = t.column("sizes").combine_chunks().flatten().to_numpy()
        upto = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = lambda i, d: upto[offset[i] + d] - upto[offset[i]]
        lcp = np.full(n, -1, np.int64)
        both = np.minimum(length[1:], length[:-1])
        step = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differ = (turns[np.repeat(offset[:-1], both) + step] != turns[np.repeat(offset[1:], both) + step]).any(axis=1)
        lcp[1:] = both
        np.minimum.at(lcp, np.repeat(np.arange(1, n), both)[differ], step[differ])
        self.minima = RangeMinimum(lcp)
        true_lcp = lcp.copy()
        true_lcp[0] = self.before
        self.true_lcp = true_lcp
        # each prefix is a candidate where it begins
        count = length - lcp
        self.at = np.repeat(np.arange(n), count)
        self.depth = np.arange(len(self.at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lcp + 1, count)
        self.left, self.right = extents(self.minima, n, self.at, self.depth)
        l, r, d = self.left, self.right, self.depth
        total = self.bytes(np.arange(n), length)
        fresh = total - self.bytes(np.arange(n), np.maximum(true_lcp, 0))
        leaf = np.ones(n, bool)
        leaf[:-1] = lcp[1:] < length[:-1]
        leaf[-1] = self.after < length[-1]
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        w, leaves, moved, news = sums(weight), sums(leaf), sums(weight * total), sums(fresh)
        self.n_convs = w[r + 1] - w[l]
        self.leasts = RangeMinimum(least)
        self.conv_id = self.leasts.of(l, r)
        self.n_leaves = leaves[r + 1] - leaves[l]
        up = np.maximum(d - 1, 0)
        own = (total[l] - self.bytes(l, np.maximum(up, true_lcp[l]))) + news[r + 1] - news[l + 1]
        self.saved = moved[r + 1] - moved[l] - self.n_convs * self.bytes(l, up) - own
        places = np.sort(lcp * n + np.arange(n))
        branches = np.searchsorted(places, d * n + r, "right") - np.searchsorted(places, d * n + l, "right")
        self.n_children = branches + ((length[l] > d) & (true_lcp[l] <= d))
        self.shared = ((l == 0) & (self.before >= d)) | ((r == n - 1) & (self.after >= d))

    def code(self, left: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """A number for each node: no two have the same first sequence and depth."""
        return left * (int(self.length.max()) + 1) + depth

    def border_nodes(self) -> tuple[np.ndarray, list[bytes]]:
        """The shared nodes' places, and a digest of each one's prefix that all partitions agree on."""
        own = np.flatnonzero(self.shared)
        found: dict[tuple[int, int], bytes] = {}
        for row, until in {0: self.before, self.size - 1: max(self.after, self.before if self.size == 1 else -1)}.items():
            state = hashlib.blake2b(digest_size=WIDE)
            for d in range(min(until, int(self.length[row])) + 1):
                found[row, d] = state.copy().digest()
                state.update(self.keys[row][d * WIDE : (d + 1) * WIDE])
        last = self.size - 1
        return own, [found[(0, d) if first == 0 and self.before >= d else (last, d)] for first, d in zip(self.left[own].tolist(), self.depth[own].tolist(), strict=True)]


_PARTIAL = "pid int, code long, node binary, n_convs long, conv_id long, n_leaves long, saved long, n_children long"
_SUMS = ("n_convs", "conv_id", "n_leaves", "saved", "n_children")
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _borders(dealt: DataFrame) -> DataFrame:
    """``(pid, before, after)`` of each partition that has rows; a row for each of them is all that is ordered here."""
    ends = dealt.groupBy("pid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("pid")
    beside = ends.select("pid", "first", "last", F.lag("last").over(order).alias("previous"), F.lead("first").over(order).alias("following"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            before = [-1 if r["previous"] is None else common_turns(r["previous"], r["first"]) for r in rows]
            after = [-1 if r["following"] is None else common_turns(r["last"], r["following"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["pid", "before", "after"])

    return beside.mapInArrow(run, "pid int, before int, after int")


def _partials(t: pa.Table) -> pa.Table:
    s = Stretch(t)
    own, digests = s.border_nodes()
    columns = [np.full(len(own), t.column("pid")[0].as_py(), np.int32), s.code(s.left[own], s.depth[own])]
    values = [s.n_convs[own], s.conv_id[own], s.n_leaves[own], s.saved[own], s.n_children[own]]
    return pa.table([*map(pa.array, columns), pa.array(digests, pa.binary()), *map(pa.array, values)], names=[x.split()[0] for x in _PARTIAL.split(", ")])


def _nodes(rows: pa.Table, merged: pa.Table) -> pa.Table:
    if not len(rows):
        return pa.table([pa.array([], k) for k in [pa.int64()] * 7 + [pa.string()]], names=[x.split()[0] for x in _NODE.split(", ")])
    s = Stretch(rows)
    merged = merged.sort_by("code")
    code = merged.column("code").to_numpy()

    def whole(name: str, values: np.ndarray, left: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Values of nodes, those of shared ones over all partitions."""
        if not len(code):
            return values
        mine = s.code(left, depth)
        at = np.minimum(np.searchsorted(code, mine), len(code) - 1)
        return np.where(code[at] == mine, merged.column(name).to_numpy()[at], values)

    own = np.flatnonzero(~((s.left == 0) & (s.before >= s.depth)))  # nodes that an earlier partition has are written there
    left, depth = s.left[own], s.depth[own]
    values = {name: whole(name, getattr(s, name)[own], left, depth) for name in _SUMS}
    up = np.maximum(depth - 1, 0)
    l, r = extents(s.minima, s.size, s.at[own], up)
    parent = whole("conv_id", s.leasts.of(l, r), l, up)
    ended = s.length[left] == depth
    return pa.table({
        "conv_id": values["conv_id"], "depth": depth, "parent_conv_id": pa.array(parent, mask=depth == 0), "n_convs": values["n_convs"], "n_children": values["n_children"],
        "n_leaves": values["n_leaves"], "saved_tokens": values["saved"], "ends_sha256": pa.array(np.where(ended, s.ends[left], NO_ENDS), pa.string()),
    })


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` for each node.

    Turns are ordered by turn (null first), equal ones by role and then by the turn's digest; null role
    and text are empty. Rows with a null conv_id belong to no conversation and are left out; repeated
    rows are turns like any other. Extra columns are not read; a table without conversations gives no
    node, not even the root. Turns are told apart by 128 bits of SHA-256. A conversation is one row of
    24 bytes for each turn, whatever its texts are; a list of ids is hashed as a stream.
    """
    spark = conversations.sparkSession
    distinct = materialise(sequences(conversations), "sequences")
    turns = distinct.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-turns // PART_TURNS))
    dealt = materialise(distinct.repartitionByRange(parts, "key").withColumn("pid", F.spark_partition_id()), "dealt")
    rows = dealt.join(materialise(_borders(dealt), "borders"), "pid")
    partial = materialise(rows.groupBy("pid").applyInArrow(_partials, _PARTIAL), "border-nodes")
    sums = partial.groupBy("node").agg(*[F.min(c).alias(c) if c == "conv_id" else F.sum(c).alias(c) for c in _SUMS])
    merged = partial.select("pid", "code", "node").join(sums, "node").drop("node")
    return rows.groupBy("pid").cogroup(merged.groupBy("pid")).applyInArrow(_nodes, _NODE)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 bit by bit over the digits of the id
ORACLE_SQL = """
WITH o AS (
  SELECT conv_id, r, x, sha256(strlen(r) || ':' || r || x) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(strlen(r) || ':' || r || x)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)) + z)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d, g, CAST(strlen(x) AS BIGINT) AS b
  FROM (SELECT c.conv_id, 0 AS own, k, g, x FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h UNION ALL
        SELECT c.conv_id, 1, k, g, x FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h)),
paths AS (
  SELECT conv_id, d, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS p, b FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM c),
sized AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = last) AS ids FROM sized GROUP BY p, d),
up AS (SELECT n.*, q.p AS parent FROM nodes n LEFT JOIN paths q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT parent, count(*) AS n_children FROM up WHERE d > 0 GROUP BY parent),
sums AS (
  SELECT q.p, q.d, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (WHERE k.parent IS NULL) AS leaves
  FROM up u LEFT JOIN kids k ON k.parent = u.p JOIN paths q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY q.p, q.d)
SELECT CAST(u.conv_id AS BIGINT) AS conv_id, CAST(u.d AS BIGINT) AS depth, CAST(v.conv_id AS BIGINT) AS parent_conv_id, u.n AS n_convs, coalesce(k.n_children, 0) AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(u.ids, '')) AS ends_sha256
FROM up u JOIN sums s ON s.p = u.p AND s.d = u.d LEFT JOIN kids k ON k.parent = u.p LEFT JOIN nodes v ON v.p = u.parent AND v.d = u.d - 1
"""
