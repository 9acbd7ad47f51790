"""Structured Streaming jobs: segmentation, rolling parameters and running counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracemill.operators import segment
from tracemill.sources import sinks


def stream_segment(reads: DataFrame, model: DataFrame, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Segment a stream of ``(readid, seq, x)``; segments are appended to ``out``, failures to ``out.errors``.

    Each micro-batch is prepared with the static model. A batch that runs again overwrites its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = segment.segment_reads(segment.prepare_reads(batch, model, k), k)
        found.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{out}/batch={number}")
        sinks.write_errors(found.select("readid", "error"), out, f"batch={number}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Numbers of a parameter that are one group of the rolling job.
BLOCK = 10_000
_ROWS = np.dtype([("seq_no", np.int64), ("value", float)])


class _Rolling(StatefulProcessor):
    """Keeps of each block of a parameter's numbers the number it expects next, its last values, and the rows that came too early.

    A key is a parameter and the first number of the block, which takes the ``n - 1`` numbers before it along and doesn't give them.
    """

    def __init__(self, n: int, consecutive: bool, first: int):
        self.n, self.consecutive, self.first = n, consecutive, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "next long, last binary, early binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        param, begin = key
        expected, *held = self.kept.get() or (max(self.first, begin - self.n + 1), b"", b"")
        last, early = np.frombuffer(held[0]), np.frombuffer(held[1], _ROWS)
        if self.consecutive:
            new = np.empty(0, _ROWS)
            for frame in rows:
                new = _ordered(np.concatenate((new, _array(frame))))
                new = new[np.r_[True, np.diff(new["seq_no"]) > 0][: len(new)]]
            again = (new["seq_no"] < expected) | np.isin(new["seq_no"], early["seq_no"])
            waiting = _ordered(np.concatenate((early, new[~again])))
            ready = int(np.searchsorted(waiting["seq_no"] - np.arange(len(waiting)), expected, "right"))
            told, early = waiting[:ready], waiting[ready:]
            expected += ready
        else:
            told = _ordered(np.concatenate([_array(frame) for frame in rows]))
        if len(told):
            values = np.concatenate((last, told["value"]))
            out = pd.DataFrame({"param": param, "seq_no": told["seq_no"], "value": told["value"], "mean": _means(values, self.n)[len(last) :]})
            last = values[-self.n :]
            yield out[out["seq_no"] >= begin] if self.consecutive else out
        self.kept.update((int(expected), last.tobytes(), early.tobytes()))

    def close(self) -> None:
        pass


def _array(frame: pd.DataFrame) -> np.ndarray:
    rows = np.empty(len(frame), _ROWS)
    rows["seq_no"], rows["value"] = frame["seq_no"], frame["value"]
    return rows


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["value"], rows["seq_no"]))]


def _means(values: np.ndarray, n: int) -> np.ndarray:
    """Means of up to ``n`` values; nulls, which pandas holds as NaN, don't count."""
    known, window = ~np.isnan(values), np.ones(min(n, len(values)))
    with np.errstate(invalid="ignore"):
        return np.convolve(np.where(known, values, 0.0), window)[: len(values)] / np.convolve(known, window)[: len(values)]


def stream_rolling_param(observations: DataFrame, n: int = 100, consecutive: bool = True, first: int = 1, block: int = BLOCK) -> DataFrame:
    """Mean of the last ``n`` values of each parameter after each of ``(param, seq_no, value)``.

    Numbers that go up by one from ``first`` on give every row once with the mean of the batch window, in
    whatever order and batches the rows arrive. They are dealt to groups by blocks of ``block`` numbers (at
    least ``n``), each of which gets the ``n - 1`` numbers before it as well, so a hot parameter is many
    tasks' work and a group holds no more than these numbers. Within a block rows are given in order: one
    that comes before its turn waits in the state, one that comes again is passed over, as is one without a
    number or with one before ``first``; blocks don't wait for each other. Of different values that come
    with one number in a micro-batch the least counts. A block that is done keeps its last values and number.

    Where numbers have gaps (``consecutive`` false) each micro-batch is taken in order after those before
    it: a parameter is then one group, which holds its rows of a micro-batch. Sets the session's state
    store to RocksDB, which this kind of state needs.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, size = observations.select("param", "seq_no", "value"), max(block, n)
    if consecutive:
        own = F.col("seq_no").cast("long") - first
        begins = [at - at % size + first for at in (own, own + (n - 1))]
        rows = rows.where(F.col("seq_no") >= first).withColumn("begin", F.explode(F.sequence(*begins, F.lit(size).cast("long"))))
    else:
        rows = rows.withColumn("begin", F.lit(first).cast("long"))
    return rows.groupBy("param", "begin").transformWithStateInPandas(_Rolling(n, consecutive, first), "param string, seq_no long, value double, mean double", "Append", "None")


def stream_counters(rows: DataFrame, q: float = 10.0) -> DataFrame:
    """Running totals of ok, skipped and failed reads, for update or complete mode."""
    status = F.when(F.col("qs") < q, "skipped").when(F.col("error").isNotNull(), "error").otherwise("ok")
    return rows.groupBy(status.alias("status")).count()
