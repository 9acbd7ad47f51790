"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"


def whole_text(name: str = "text") -> Column:
    """The text column, null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    The cluster names the place in ``spark.checkpoint.dir``; only where that is unset
    (a local session in a test) a temporary folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracemill-", dir=os.environ.get("TMPDIR") or "/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release_memory() -> None:
    """Give freed memory back to the machine: an idle Python worker lives on beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which releases memory when its task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released


def portions(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by ``keys``, some at a time: at least ``rows`` rows, and all rows of a key together."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = 0
            for key in keys:
                column = table.column(key).combine_chunks()
                change = pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, count - 1)))
                last = max(last, change[-1].as_py() + 1 if len(change) else 0)
            if last:
                yield table.slice(0, last)
                held, count = table.slice(last).combine_chunks().to_batches(), count - last
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunk_count(docs: DataFrame, chunk_bytes: int) -> int:
    """How many chunks to deal documents into: one for about ``chunk_bytes`` of text, and some for each core."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-text_bytes // chunk_bytes))


#: Partitions into which chunks or buckets are dealt at most; beyond it a partition holds several of them.
MOST_PARTS = 4_000


def deal(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with its ``n`` chunks or buckets (numbers in ``key``) dealt evenly, those of a partition in the column part.

    Grouping by part and ``key`` needs no further exchange. The partitions are bounded, so the blocks of the
    shuffle grow with the text and not with its square.
    """
    parts = min(n, MOST_PARTS)
    return df.withColumn("part", (F.col(key) % parts).cast("int")).repartitionById(parts, F.col("part"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds. Minima are aggregated with partial sums and
    joined back, so that a node of very high degree is never gathered in one task: Spark splits
    the skewed join. Each round is written to the shared folder. Self loops are ignored; an empty
    input gives an empty result.
    """
    spark = edges.sparkSession
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(down, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = materialise(small, "cc")
        # settled when every node has one edge and no parent has a parent
        parents = after.select(F.col("b").alias("p")).distinct()
        loose = after.join(parents, F.col("a") == F.col("p"), "left_semi").limit(1).count()
        double = 0 if loose else after.groupBy("a").count().where("count > 1").limit(1).count()
        current = after
        if not loose and not double:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
