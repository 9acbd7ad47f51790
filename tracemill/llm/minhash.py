"""MinHash near-duplicates: b-bit signatures, bands, and links confirmed on whole shingle sets.

Each different shingle set is a node. Of its minima under PERMUTATIONS hash functions the low two bits
are kept, packed as two bit planes; bands of ROWS full minima give its buckets. Two nodes of one bucket
are candidates; their similarity is estimated by counting the bits in which the planes agree, less the
quarter that agrees by chance, and what is not clearly below the threshold is confirmed on whole sets.

A bucket may hold a crowd of near copies, so its pairs are never written out. First every member is
linked with the bucket's first one. Where that leaves more than one class, the members outside the
largest class are compared with all members by their signatures, in blocks; the sets of those that have
a candidate travel to the block once, and what is confirmed there comes back as a forest. So every pair
of a bucket that is not in one class by then is looked at, and no bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import connected_components, materialise, portions, releasing, whole_text
from tracemill.llm.words import bitmap, in_bitmap, mix, text_portions, word_hashes

#: Words of a shingle, and the least similarity of a link in per cent.
SHINGLE, SHARE = 4, 80
#: Bands and the minima of each. A pair at 0.8 shares no bucket with a chance of 1.3e-7.
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS
#: Estimates below this are no candidates: five standard deviations (0.034 each) under the threshold.
LEAST_ESTIMATE = 0.63
#: Bytes of a bit plane, padded to whole 64-bit words.
PLANE = -(-PERMUTATIONS // 64) * 8
#: Members of a block, of which a large bucket is made; rows of buckets that are compared together.
BLOCK, TOGETHER = 500, 20_000

_U = np.uint64
_FACTOR = np.random.default_rng(1109).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for a text without words."""
    words, count = [], []
    for text in texts:
        own = text.lower().split()
        words += own
        count.append(len(own))
    h = word_hashes(words)
    rolled = mix(h[: max(0, len(h) - shingle + 1)])
    for k in range(1, shingle):
        rolled = mix(rolled * _U(3) + h[k : len(h) - shingle + 1 + k])
    out, at = [], 0
    for n in count:
        if n >= shingle:
            own = np.sort(rolled[at : at + n - shingle + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:  # the whole sequence is one shingle, told from longer ones by its length
            one = np.full(min(n, 1), n, np.uint64)
            for k in range(at, at + n):
                one = mix(one * _U(5) + h[k])
            out.append(one)
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two bit planes of the low bits of each set's minima, and the bucket of each band; sets must not be empty."""
    joined = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    minima = np.empty((len(sets), PERMUTATIONS), np.uint64)
    for k, factor in enumerate(_FACTOR):
        minima[:, k] = np.minimum.reduceat(joined * factor, begin)
    low = minima >> _U(32)  # bits from the middle: the lowest of a product are those of the element
    planes = np.zeros((len(sets), 2, PLANE), np.uint8)
    for p in (0, 1):
        bits = np.packbits(((low >> _U(p)) & _U(1)).astype(bool), axis=1, bitorder="little")
        planes[:, p, : bits.shape[1]] = bits
    bands = minima.reshape(len(sets), BANDS, ROWS)
    bucket = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
    for k in range(ROWS):
        bucket = mix(bucket * _U(3) + bands[:, :, k])
    return planes.reshape(len(sets), 2 * PLANE), bucket


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of signatures, rows of 64-bit words: the share of minima whose two bits agree, corrected for chance."""
    half = PLANE // 8
    apart = np.bitwise_count((a[..., :half] ^ b[..., :half]) | (a[..., half:] ^ b[..., half:])).sum(axis=-1, dtype=np.int64)
    return ((1 - apart / PERMUTATIONS) - 0.25) / 0.75


def _words64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for part in text_portions(batches, "text"):
        sets = shingle_sets(part.column("text").to_pylist(), shingle)
        full = [k for k, x in enumerate(sets) if len(x)]
        planes, buckets = signatures([sets[k] for k in full]) if full else (np.zeros((0, 2 * PLANE), np.uint8), np.zeros((0, BANDS), np.uint64))
        sig, bands = [None] * len(sets), [None] * len(sets)
        for j, k in enumerate(full):
            sig[k], bands[k] = planes[j].tobytes(), buckets[j].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").combine_chunks(), part.column("key").combine_chunks(), pa.array([_digest(x) for x in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "key", "digest", "n", "sig", "bands"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, bits: object) -> Iterator[pa.RecordBatch]:
    def wanted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    for part in text_portions(wanted(), "text"):
        sets = shingle_sets(part.column("text").to_pylist(), shingle)
        yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "set"])


def _agreeing(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((a, b)), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= share * (len(a) + len(b) - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def sets_of(docs: DataFrame, nodes: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """``(node, set)`` of the ``needed(node)``.

    Only the texts of those nodes are read again for their sets: a bitmap of fixed size lets through a
    few more, which the join drops.
    """
    known = materialise(needed.distinct().join(nodes.select("node", "key", "digest"), "node"), "needed")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(known.select("key")))
    found = _keyed(docs).select("key", "text").mapInArrow(releasing(partial(_sets, shingle=shingle, bits=bits)), "digest binary, set binary")
    return materialise(found.join(known.select("node", "digest"), "digest").groupBy("node").agg(F.first("set").alias("set")), "sets")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, share: int) -> DataFrame:
    """The ``pairs(a, b)`` of nodes whose whole sets are alike enough."""
    sets = sets_of(docs, nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), shingle)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return materialise(both.select("a", "b", "sa", "sb").mapInArrow(releasing(partial(_agreeing, share=share)), "a long, b long"), "links")


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield batch.select([0, 1]).filter(pa.array(estimates(_words64(batch.column(2)), _words64(batch.column(3))) >= least))


_UNIT = ["bucket", "p", "q"]


def _compared(batches: Iterator[pa.RecordBatch], least: float, share: int) -> Iterator[pa.RecordBatch]:
    """Members of units that have a candidate: some of one block outside the main class, some of a block of all members."""
    for table in portions(batches, _UNIT, TOGETHER):
        unit = np.column_stack([table.column(c).to_numpy() for c in _UNIT])
        border = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1)])
        cls, n, few = (table.column(c).to_numpy(zero_copy_only=False) for c in ("class", "n", "few"))
        sig, met = _words64(table.column("sig")), np.zeros(len(unit), bool)
        for lo, hi in zip(border, np.r_[border[1:], len(unit)], strict=True):
            own, all_ = lo + np.flatnonzero(few[lo:hi]), lo + np.flatnonzero(~few[lo:hi])
            for k in range(0, len(own), 64):
                x = own[k : k + 64]
                small, large = np.minimum(n[x][:, None], n[all_][None]), np.maximum(n[x][:, None], n[all_][None])
                near = (estimates(sig[x][:, None], sig[all_][None]) >= least) & (cls[x][:, None] != cls[all_][None]) & (100 * small >= share * large)
                met[x] |= near.any(axis=1)
                met[all_] |= near.any(axis=0)
        yield from table.select([*_UNIT, "few", "node", "class"]).filter(pa.array(met)).to_batches()


def common_counts(index: tuple[np.ndarray, np.ndarray, int], own: np.ndarray) -> np.ndarray:
    """How many elements ``own`` has in common with each of some sets, given as the sorted elements of all, whose each is, and their number."""
    values, owner, n = index
    first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
    size = last - first
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    return np.bincount(owner[at], minlength=n)


def _confirmed_within(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of units, a forest over each one's classes."""
    for table in portions(batches, _UNIT, 1):
        unit = np.column_stack([table.column(c).to_numpy() for c in _UNIT])
        border = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1)])
        few, node, cls = (table.column(c).to_numpy(zero_copy_only=False) for c in ("few", "node", "class"))
        out = []
        for lo, hi in zip(border, np.r_[border[1:], len(unit)], strict=True):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").slice(lo, hi - lo)]
            own, all_ = np.flatnonzero(few[lo:hi]), np.flatnonzero(~few[lo:hi])
            if not len(own) or not len(all_):
                continue
            size = np.array([len(sets[j]) for j in all_])
            values, owner = np.concatenate([sets[j] for j in all_]), np.repeat(np.arange(len(all_)), size)
            order = np.argsort(values)
            index = (values[order], owner[order], len(all_))
            root = {c: c for c in cls[lo:hi].tolist()}

            def top(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i in own:
                common = common_counts(index, sets[i])
                for j in np.flatnonzero(100 * common >= share * (len(sets[i]) + size - common)):
                    a, b = top(int(cls[lo + i])), top(int(cls[lo + all_[j]]))
                    if a != b:
                        root[a] = b
                        out.append((node[lo + i], node[lo + all_[j]]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def links_left(docs: DataFrame, members: DataFrame, nodes: DataFrame, links: DataFrame, shingle: int, share: int) -> DataFrame:
    """Confirmed links within buckets whose members are not yet of one class; the first member has been compared with all."""
    classes = connected_components(links)
    labelled = materialise(members.join(classes, "node", "left").select("bucket", "first", "node", F.coalesce("component", "node").alias("class")), "labelled")
    sizes = labelled.groupBy("bucket", "class").agg(F.count("*").alias("m"))
    main = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("m", "class")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count("*").alias("k"))
    open_ = main.where("k > 1").select("bucket", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("nq"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("np"))
    rows = labelled.join(open_, "bucket").where("node <> first").join(nodes.select("node", "sig", "n"), "node")
    p, q = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("np", "nq")))
    few = rows.where(F.col("class") != F.col("main")).select("bucket", p.alias("p"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.lit(True).alias("few"), "node", "class", "n", "sig")
    many = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("p"), q.alias("q"), F.lit(False).alias("few"), "node", "class", "n", "sig")
    units = few.unionByName(many).repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    met = materialise(units.mapInArrow(releasing(partial(_compared, least=LEAST_ESTIMATE, share=share)), "bucket long, p int, q int, few boolean, node long, class long"), "candidates")
    if not met.limit(1).count():
        return links
    whole = met.join(sets_of(docs, nodes, met.select("node"), shingle), "node").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    found = whole.select(*_UNIT, "few", "node", "class", "set").mapInArrow(releasing(partial(_confirmed_within, share=share)), "a long, b long")
    return links.unionByName(materialise(found, "links"))


def signed_nodes(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its set's digest and size, and a row for each different set."""
    schema = "doc_id long, key long, digest binary, n long, sig binary, bands array<long>"
    rows = materialise(_keyed(docs).mapInArrow(releasing(partial(_signed, shingle=shingle)), schema), "signatures")
    nodes = rows.where("n > 0").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("key", "n", "sig", "bands")], F.min("doc_id").alias("least"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return rows, nodes


def buckets_of(nodes: DataFrame) -> DataFrame:
    """``(bucket, node, first, m)``: the members of each bucket of two or more, its first member and their number."""
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1")
    return materialise(dealt.join(shared, "bucket"), "members")


def links_of(docs: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Confirmed links ``(a, b)`` that span every class of nodes which meet in the buckets of ``members``."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    alike = stars.where(100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
    pairs = materialise(alike.mapInArrow(releasing(partial(_estimated, least=LEAST_ESTIMATE)), "a long, b long"), "candidates")
    links = confirmed(docs, nodes, pairs, shingle, share)
    return links_left(docs, members.where("m > 2"), nodes, links, shingle, share)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Documents are linked where ``100 * intersection >= share * union`` of their shingle sets;
    component_id is the smallest doc_id that links reach. A text with fewer words than a shingle has
    its whole sequence as the only one; null and blank texts have none and are linked with nothing.
    Equal sets are one node, however many rows have them. Repeated ids keep their rows; a null id
    stands for no id in a class of others, and a class of null ids only has a null component whose
    rows are kept. Other columns are not read; an empty table gives no rows. Shingles are told apart
    by 64-bit hashes.
    """
    rows, nodes = signed_nodes(docs, shingle)
    links = links_of(docs, nodes, buckets_of(nodes), shingle, share)
    joined = nodes.select("node", "digest", "least").join(connected_components(links), "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    known = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", "component_id")
    out = rows.select("doc_id", "digest", "n").join(known, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
