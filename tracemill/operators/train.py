"""Re-estimation of the level model and of the transitions from expected counts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import aggs, joins, segment, windows
from tracemill.sources.scratch import scratch

#: Reads of a batch, the observations that a rolling mean looks back on, and the least mean of a plausible tail.
BATCH, HISTORY, LEAST_TAIL = 24, 100, 0.5


def plausible(counts: DataFrame, least: float = LEAST_TAIL) -> DataFrame:
    """Expected counts without the emissions of reads whose new tail mean is below ``least``."""
    return counts.where(F.col("tail").isNull() | (F.col("tail") >= least))


def train_pooled(prepared: DataFrame, model: DataFrame, k: int = 5, params: dict[str, float] = segment.PARAMS) -> DataFrame:
    """One step from the pooled statistics of all reads; unseen k-mers keep their levels."""
    return aggs.emission_update(plausible(segment.expected_counts(prepared, k, params)), model)


def observations(counts: DataFrame) -> DataFrame:
    """Levels of each k-mer from each read by itself: ``(param, seq_no, level_mean, level_stdv)``, in order of readid."""
    w = F.sum("w")
    mean = F.sum("wx") / w
    rows = plausible(counts).groupBy("readid", "kmer").agg(w.alias("w"), mean.alias("level_mean"), F.sqrt(F.greatest(F.sum("wxx") / w - mean * mean, F.lit(1e-12))).alias("level_stdv"))
    # the model's own levels come before any read
    return rows.where("w > 0").select(F.col("kmer").alias("param"), F.struct(F.lit(1).alias("after"), F.col("readid").cast("string").alias("readid")).alias("seq_no"), "level_mean", "level_stdv")


def rolling_model(seen: DataFrame, model: DataFrame, n: int = HISTORY) -> DataFrame:
    """Mean of the last ``n`` observations of each k-mer, its levels in ``model`` the first of them."""
    start = model.select(F.col("kmer").alias("param"), F.struct(F.lit(0).alias("after"), F.lit(None).cast("string").alias("readid")).alias("seq_no"), "level_mean", "level_stdv")
    both = start.unionByName(seen)
    out = None
    for level in ("level_mean", "level_stdv"):
        own = windows.rolling(both.select("param", "seq_no", F.col(level).alias("value")), n).groupBy("param").agg(F.max_by("mean", "seq_no").alias(level))
        out = own if out is None else out.join(own, "param")
    return out.withColumnRenamed("param", "kmer")


def train_rolling(prepared: DataFrame, model: DataFrame, k: int = 5, n: int = HISTORY, params: dict[str, float] = segment.PARAMS) -> DataFrame:
    """Levels of each read by itself, then the mean of each k-mer's last ``n`` observations in order of readid."""
    return rolling_model(observations(segment.expected_counts(prepared, k, params)), model, n)


def new_transitions(counts: DataFrame, params: dict[str, float]) -> dict[str, float]:
    """Transition logs from the expected counts of all reads; the first extension stays as it is."""
    per_read = counts.groupBy("readid").agg(F.first("m1").alias("m1"), F.first("e2").alias("e2"))
    found = {r.param: r.value for r in aggs.transition_update(per_read).collect()}  # two rows
    return params | {name: math.log(v) for name, v in found.items() if v and v > 0}


def history(model: DataFrame) -> DataFrame:
    """``(param, seen)``: the state that batches are merged into, each k-mer's own levels as its first observation."""
    return model.select(F.col("kmer").alias("param"), F.array(F.struct("level_mean", "level_stdv")).alias("seen"))


def merge_history(state: DataFrame, new: DataFrame, n: int = HISTORY) -> DataFrame:
    """``(param, seen)`` with a batch's observations ``(param, seq_no, level_mean, level_stdv)`` behind those seen so far.

    Only the last ``n`` stay, so the state is bounded however many batches there were; a batch adds one
    observation a read at most. Parameters that are new begin with the batch.
    """
    own = new.groupBy("param").agg(F.array_sort(F.collect_list(F.struct("seq_no", "level_mean", "level_stdv"))).alias("new"))
    fresh = F.transform(F.coalesce("new", F.array().cast(own.schema["new"].dataType)), lambda o: F.struct(o["level_mean"].alias("level_mean"), o["level_stdv"].alias("level_stdv")))
    both = F.concat(F.coalesce("seen", F.array().cast(state.schema["seen"].dataType)), fresh)
    return state.join(own, "param", "full").select("param", F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n)).alias("seen"))


def model_of(state: DataFrame) -> DataFrame:
    """``(kmer, level_mean, level_stdv)``: means of what the state has seen."""
    mean = lambda c: F.aggregate("seen", F.lit(0.0), lambda s, o: s + o[c]) / F.size("seen")
    return state.select(F.col("param").alias("kmer"), mean("level_mean").alias("level_mean"), mean("level_stdv").alias("level_stdv"))


def _kept(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Written to ``path`` and read back, which cuts the lineage: executors may be lost."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit(
    prepare: Callable[[DataFrame], DataFrame], model: DataFrame, epochs: int = 1, k: int = 5, checkpoint: str | None = None, params: dict[str, float] = segment.PARAMS,
    batch_size: int | None = None, max_batches: int | None = None, log: str | None = None, is_rna: bool = False,
) -> tuple[DataFrame, dict[str, float], list[float]]:
    """Train for some epochs; ``prepare(model)`` gives the prepared reads. Returns the model, the transitions and the mean score change of each step.

    Without a ``batch_size`` each epoch is one step over the pooled counts of all reads. With one, reads are
    prepared once, and taken in batches in order of readid, the last partial batch left out: they are stored
    by batch, so a step reads its own reads only, joins them to the current levels and merges what they tell
    into the last HISTORY observations of each k-mer; the levels are the means of those. So the work is in
    proportion to the batches. Each step's model goes to ``checkpoint`` (in batches a shared scratch folder
    where there is none), and a row with its step, transitions and score change to ``log``.
    """
    changes: list[float] = []
    spark = model.sparkSession
    if batch_size and not checkpoint:
        checkpoint = scratch(spark, "fit")
    reads, numbers, state = None, range(1), None
    if batch_size:
        prepared = prepare(model)
        ids = windows.batch_no(prepared.where("error IS NULL").select("readid"), ["readid"], batch_size)
        reads = _kept(prepared.join(ids, "readid").repartition("batch"), f"{checkpoint}/reads", "batch")
        count = reads.agg(F.max("batch")).first()[0]
        numbers = range(0 if count is None else min(count + 1, max_batches or count + 1))
        state = _kept(history(model), f"{checkpoint}/state-start")
    for epoch in range(epochs):
        for b in numbers:
            chosen = (lambda m, b=b: segment.with_levels(reads.where(F.col("batch") == b), m, k, is_rna)) if batch_size else prepare
            counts = segment.expected_counts(chosen(model), k, params)
            if checkpoint:
                counts = _kept(counts, f"{checkpoint}/counts-{epoch}-{b}")
            before = counts.groupBy("readid").agg(F.first("zf").alias("z"))
            if batch_size:
                state = _kept(merge_history(state, observations(counts)), f"{checkpoint}/state-{epoch}-{b}")
                new = model_of(state)
            else:
                new = aggs.emission_update(plausible(counts), model)
            params = new_transitions(counts, params)
            if checkpoint:
                new = _kept(new.select(*model.columns), f"{checkpoint}/model-{epoch}-{b}")
            after = segment.log_likelihood(chosen(new), params).where("error IS NULL").select("readid", F.col("zf").alias("z"))
            changes.append(aggs.mean_delta_z(joins.pair_pre_post(before, after)).first()[0])
            if log:
                from tracemill.sources import sinks

                row = (epoch, b, *(params[n] for n in ("m1", "e1", "e2")), changes[-1])
                sinks.write_param_log(spark.createDataFrame([row], "epoch int, batch int, m1 double, e1 double, e2 double, zchange double"), log)
            model = new
    return model, params, changes
