"""A sharded document store with size-tiered compaction, in DataFrame operations only.

Arrivals are appended as runs of small immutable Parquet shards; a run is a folder. Compaction takes
the runs of one size tier, when there are enough of them, and rewrites them as one run of files of the
target size without a shuffle. Every change is a new manifest version: a table of runs that is written
aside and becomes visible by one rename that fails if the version exists, so a reader sees a version
whole or not at all and of two writers one has to try again. A job that dies leaves files that no
manifest names. What the driver holds grows with the runs, a handful for each tier, not with the files.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import shared_dir

TARGET_BYTES = 32 << 20
#: Runs of a tier differ in size by less than this factor.
TIER_FACTOR = 4
#: A tier is merged from so many runs on.
MIN_MERGE = 4
#: The tier of runs whose files have at least half the target size on average: they are never merged again.
FINISHED = 100
ARRIVALS = 8

MANIFEST = "path string, files long, bytes long, rows long, tier int, since int"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Documents under ``root``, which driver and executors share; ``kind`` is the row's struct type."""

    def __init__(self, spark: SparkSession, root: str, kind: T.StructType, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self.schema = T.StructType([T.StructField("arrival", T.IntegerType()), T.StructField("row", kind)])
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max([0, *(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The runs of a version: path, files, bytes, rows, tier, and the version that brought them."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version:09d}")

    def commit(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` the given version; raises Conflict if there is one already."""
        aside = f"{self.root}/manifests/.new-{uuid.uuid4().hex}"
        rows.select("path", "files", "bytes", "rows", "tier", "since").coalesce(1).write.parquet(aside)
        try:
            self._files.rename(self._path(aside), self._path(f"{self.root}/manifests/v{version:09d}"), self._no_overwrite)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), True)
            raise Conflict(f"version {version} is there already") from e

    def _run(self, folder: str, version: int) -> DataFrame:
        """The manifest row of a folder. A tier is a range of sizes; the top one is finished."""
        files = self.spark.read.schema(self.schema).parquet(folder)
        each = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count("*").alias("n"))
        run = each.select(_folder("file").alias("path"), "bytes", "n").groupBy("path").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"))
        done = F.col("bytes") * 2 >= F.col("files") * self.target
        tier = F.when(done, FINISHED).otherwise(F.least(F.lit(FINISHED - 1), F.floor(F.log(float(TIER_FACTOR), F.col("bytes"))))).cast("int")
        return run.select("path", "files", "bytes", "rows", tier.alias("tier"), F.lit(version).alias("since"))

    def append(self, docs: DataFrame, arrival: int) -> int:
        """One arrival as a run of its own, committed as the next version, which is returned."""
        return self.append_all(docs, F.lit(arrival), [arrival])

    def append_all(self, docs: DataFrame, arrival, arrivals: list[int]) -> int:
        """Several arrivals in one pass over ``docs``, each committed as a version of its own, in order.

        ``arrival`` is a column; rows whose value isn't in ``arrivals`` are refused by the count.
        """
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows = docs.select(arrival.cast("int").alias("arrival"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        rows.withColumn("a", F.col("arrival")).write.partitionBy("a").option("compression", "zstd").parquet(folder)
        version = self.version()
        for a in arrivals:
            at = f"{folder}/a={a}"
            new = self._run(at, version + 1) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], MANIFEST)
            self.commit(self.manifest(version).unionByName(new), version + 1)
            version += 1
        return version

    def compact(self) -> int:
        """Merge every tier that has enough runs, until none has; returns the latest version.

        The runs of a tier are replaced by one in one commit; the old ones stay, for readers of older
        versions, until ``vacuum``.
        """
        while True:
            version = self.version()
            now = self.manifest(version)
            tiers = now.where(F.col("tier") < FINISHED).groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_MERGE).orderBy("tier").select("tier").limit(1).collect()
            if not tiers:
                return version
            chosen = now.where(F.col("tier") == tiers[0].tier).select("path", "bytes").collect()
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            paths = [r.path for r in chosen]
            files = max(1, -(-sum(r.bytes for r in chosen) // self.target))
            self.spark.read.schema(self.schema).parquet(*paths).coalesce(files).write.option("compression", "zstd").parquet(folder)
            self.commit(now.where(~F.col("path").isin(paths)).unionByName(self._run(folder, version + 1)), version + 1)

    def _rows(self, runs: DataFrame) -> DataFrame:
        paths = [r.path for r in runs.select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """``(arrival, row)`` of all documents of a version."""
        return self._rows(self.manifest(version))

    def history(self) -> DataFrame:
        """``(row, since)`` of every run that a version, as far as they are kept, has brought."""
        runs = None
        for v in range(1, self.version() + 1):
            if self._fs.exists(self._path(f"{self.root}/manifests/v{v:09d}")):
                new = self.manifest(v).where(F.col("since") == v)
                runs = new if runs is None else runs.unionByName(new)
        if runs is None:
            return self.spark.createDataFrame([], T.StructType([self.schema["row"], T.StructField("since", T.IntegerType())]))
        rows = self._rows(runs)
        placed = rows.select("row", _folder("_metadata.file_path").alias("path")) if runs.limit(1).count() else rows.select("row", F.lit("").alias("path"))
        return placed.join(F.broadcast(runs.select("path", "since")), "path").select("row", "since")  # a row for each version

    def vacuum(self, keep: int = 1) -> None:
        """Delete runs that none of the last ``keep`` versions names, and older manifests."""
        last = self.version()
        kept = {self._path(r.path).toUri().getPath() for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v).select("path").collect()}
        of = lambda x: x.getPath().toUri().getPath()
        for x in self._fs.listStatus(self._path(f"{self.root}/shards")):
            inner = [y for y in self._fs.listStatus(x.getPath()) if y.isDirectory()]
            for run in inner or [x]:
                if of(run) not in kept:
                    self._fs.delete(run.getPath(), True)
        for v in range(1, max(1, last - keep + 1)):
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:09d}"), True)


def _folder(file: str) -> Column:
    return F.regexp_replace(file, "/[^/]*$", "")


def store_documents(docs: DataFrame, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Documents appended in ``arrivals`` turns by their id's remainder (null: the first), then compacted.

    Repeated rows stay repeated, nulls and extra columns are stored as they are; an empty table gives
    a store whose versions have no shards.
    """
    kind = T.StructType(docs.schema.fields)
    store = ShardStore(docs.sparkSession, shared_dir(docs.sparkSession, "store"), kind, target_bytes)
    turn = F.coalesce(F.pmod(F.col("doc_id"), F.lit(arrivals)), F.lit(0))
    store.append_all(docs, turn, list(range(arrivals)))
    store.compact()
    return store


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the latest version of the store has it, with the version that brought it first.

    That version is looked up in the manifests' history, by the whole row; compaction must not change it.
    """
    store = store_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = store.history().groupBy(F.xxhash64("row").alias("key")).agg(F.min("since").alias("arrived_in_version"))
    stored = store.read().withColumn("key", F.xxhash64("row")).join(first, "key", "left")
    return stored.select(
        "row.doc_id", "arrived_in_version", "row.lang", "row.source", "row.n_chars",
        F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id, CAST(coalesce(doc_id % 8, 0) + 1 AS INTEGER) AS arrived_in_version, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
