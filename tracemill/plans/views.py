"""The given tables as domain tables: in Spark, and the same in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_WEIGHTS = (7, 13, 29, 17, 5)

SQL = {
    "reads": f"SELECT doc_id AS readid, source AS raw_file, CAST(doc_id % 20 AS DOUBLE) AS qs, n_chars AS n_samples, "
    f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents",
    "points": "SELECT user_id AS readid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x, event_id FROM events",
    "triples": "SELECT readid, pos // 3 AS n, substring('ACGT', CAST(sum(event_id) % 4 AS INTEGER) + 1, 1) AS base FROM points GROUP BY readid, pos // 3",
    "event_reads": "SELECT readid, s.seq, p.x FROM (SELECT readid, string_agg(base, '' ORDER BY n) AS seq FROM triples GROUP BY readid) s "
    "JOIN (SELECT readid, list((x - 50.0) / 50.0 ORDER BY pos) AS x FROM points GROUP BY readid) p USING (readid)",
    "basecalls": "SELECT concat('read-', readid) AS readid, CASE WHEN readid % 2 = 0 THEN concat('signal-', readid) END AS signalid, concat('run', readid % 5) AS raw_file, seq, CAST(readid % 20 AS DOUBLE) AS qs, "
    "CAST(len(x) AS INTEGER) AS ns, CAST(readid % 3 AS INTEGER) AS ts, CASE WHEN readid % 2 = 0 THEN 0 END AS sp, CAST(CASE WHEN readid % 4 = 0 THEN 500 ELSE 50 END AS DOUBLE) AS shift, CAST(50 AS DOUBLE) AS scale, readid AS user_id FROM event_reads",
    "event_kmers": "SELECT readid, i - 1 AS n, substring(seq, CAST(i AS INTEGER), 5) AS kmer FROM (SELECT readid, seq, unnest(range(1, length(seq) - 3)) AS i FROM event_reads)",
    "model": "SELECT DISTINCT kmer, round((" + " + ".join(f"{w} * (instr('ACGT', substring(kmer, {k}, 1)) - 1)" for k, w in enumerate(_WEIGHTS, 1)) + ") / CAST(50 AS DOUBLE) - CAST(2.13 AS DOUBLE), 6) AS level_mean, CAST(0.25 AS DOUBLE) AS level_stdv FROM event_kmers",
    "borders": "SELECT DISTINCT event_type AS tool, user_id AS readid, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600) AS BIGINT) AS border FROM events",
    "tool_segments": "SELECT * FROM (SELECT tool, readid, border AS start, lead(border) OVER (PARTITION BY tool, readid ORDER BY border) AS \"end\" FROM borders) WHERE \"end\" IS NOT NULL",
    "signals": "SELECT vec_id AS readid, [CAST(v AS DOUBLE) FOR v IN embedding] AS signal, label FROM embeddings",
    "lengths": "SELECT lang AS grp, n_chars AS len FROM documents",
    "contigs": "SELECT p_brand AS grp, CAST(p_size AS BIGINT) AS len, CAST(p_partkey % 50 AS DOUBLE) AS coverage FROM part",
    "metrics_wide": "SELECT concat(l_returnflag, l_linestatus) AS tool, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS total_quantity, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT) AS total_price, count(*) AS n_lines, count(DISTINCT l_partkey) AS present, "
    "count(DISTINCT l_suppkey) AS missing, CAST(min(l_quantity) AS BIGINT) AS min_length, CAST(max(l_linenumber) AS BIGINT) AS truncated FROM lineitem GROUP BY 1",
    "metrics": " UNION ALL ".join(f"SELECT tool, '{m}' AS metric, CAST({m} AS VARCHAR) AS value FROM metrics_wide" for m in ("total_quantity", "total_price", "n_lines", "present", "missing", "min_length", "truncated"))
    + " UNION ALL SELECT tool, 'label' AS metric, concat('tool ', tool) AS value FROM metrics_wide",
    "tool_dataset": "SELECT CAST(s_suppkey % 7 AS INTEGER) AS tool, n_regionkey AS dataset, CAST(round(s_acctbal * 100) AS BIGINT) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "pairs": "SELECT readid, seq, CASE WHEN readid % 3 = 0 THEN seq WHEN readid % 3 = 1 THEN concat(substring(seq, 1, CAST(readid % 60 AS INTEGER)), substring(seq, CAST(readid % 60 AS INTEGER) + 2)) "
    "ELSE concat(substring(seq, 1, CAST(readid % 60 AS INTEGER)), 'A', substring(seq, CAST(readid % 60 AS INTEGER) + 2)) END AS segmented_seq, readid % 10 <> 0 AS present FROM reads",
    "probs": "SELECT readid, day, candidate, round(exp(-x / 100) / sum(exp(-x / 100)) OVER (PARTITION BY readid, day), 9) AS p FROM (SELECT user_id AS readid, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 864000) AS BIGINT) AS day, event_id AS candidate, value AS x FROM events)",
    "param_obs": "SELECT event_type AS param, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq_no, value FROM events",
}
_NEEDS = {
    "triples": ["points"], "event_reads": ["triples"], "basecalls": ["event_reads"], "event_kmers": ["event_reads"], "model": ["event_kmers"], "tool_segments": ["borders"], "metrics": ["metrics_wide"], "pairs": ["reads"],
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " "


class Views:
    """The same views as DataFrames over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def reads(self) -> DataFrame:
        letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", "")
        return self.table("documents").select(F.col("doc_id").alias("readid"), F.col("source").alias("raw_file"), (F.col("doc_id") % 20).cast("double").alias("qs"), F.col("n_chars").alias("n_samples"), F.translate(letters, LETTERS, BASES).alias("seq"))

    def points(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("readid"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("value").alias("x"), "event_id")

    def event_reads(self) -> DataFrame:
        base = F.substring(F.lit("ACGT"), (F.sum("event_id") % 4).cast("int") + 1, F.lit(1))
        triple = self.points().groupBy("readid", F.floor(F.col("pos") / 3).alias("n")).agg(base.alias("base"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
        whole = triple.groupBy("readid").agg(F.array_sort(F.collect_list(F.struct("n", "base", "xs"))).alias("t"))
        x = F.transform(F.flatten(F.transform("t", lambda s: s["xs"])), lambda s: (s["x"] - 50.0) / 50.0)
        return whole.select("readid", F.array_join(F.transform("t", lambda s: s["base"]), "").alias("seq"), x.alias("x"))

    def basecalls(self) -> DataFrame:
        """Basecalled reads with their tags: text ids, a signal id for every second one, a start offset, two ways of scaling."""
        i = F.col("readid")
        return self.event_reads().select(
            F.concat(F.lit("read-"), i).alias("readid"), F.when(i % 2 == 0, F.concat(F.lit("signal-"), i)).alias("signalid"), F.concat(F.lit("run"), i % 5).alias("raw_file"), "seq",
            (i % 20).cast("double").alias("qs"), F.size("x").alias("ns"), (i % 3).cast("int").alias("ts"), F.when(i % 2 == 0, 0).alias("sp"),
            F.when(i % 4 == 0, 500.0).otherwise(50.0).alias("shift"), F.lit(50.0).alias("scale"), i.alias("user_id"),
        )

    def raw_signals(self) -> DataFrame:
        """Their signals, calibrated and as readings; those of every eleventh series are missing."""
        i = F.col("readid")
        value = lambda f: F.transform("p", lambda s: f(s["x"]))
        rows = self.points().groupBy("readid").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).where(i % 11 != 0)
        return rows.select(
            F.concat(F.lit("run"), i % 5).alias("raw_file"), F.when(i % 2 == 0, F.concat(F.lit("signal-"), i)).otherwise(F.concat(F.lit("read-"), i)).alias("signalid"),
            value(lambda x: F.floor(x + 450).cast("smallint")).alias("adc"), value(lambda x: x).alias("pa"),
        )

    def all_kmers(self) -> DataFrame:
        """The levels of every 5-mer over the letters that ``event_kmers`` has."""
        letters = self.event_kmers().select(F.explode(F.split("kmer", "")).alias("c")).where("c <> ''").distinct()
        level, rows = F.lit(0), letters.select(F.col("c").alias("kmer"))
        for _ in range(4):
            rows = rows.join(F.broadcast(letters), F.length("kmer") > 0).select(F.concat("kmer", "c").alias("kmer"))  # four letters at most
        for k, w in enumerate(_WEIGHTS, 1):
            level = level + (F.instr(F.lit("ACGT"), F.substring("kmer", k, 1)) - 1) * w
        return rows.select("kmer", F.round(level / F.lit(50.0) - F.lit(2.13), 6).alias("level_mean"), F.lit(0.25).alias("level_stdv"))

    def event_kmers(self) -> DataFrame:
        from tracemill.functions.exprs import kmers

        return self.event_reads().select("readid", F.posexplode(kmers(F.col("seq"), 5)).alias("n", "kmer")).withColumn("n", F.col("n").cast("long"))

    def model(self) -> DataFrame:
        digit = lambda k: F.instr(F.lit("ACGT"), F.substring("kmer", k, 1)) - 1
        level = sum((digit(k) * w for k, w in enumerate(_WEIGHTS, 1)), F.lit(0)) / F.lit(50.0) - F.lit(2.13)
        return self.event_kmers().select("kmer").distinct().select("kmer", F.round(level, 6).alias("level_mean"), F.lit(0.25).alias("level_stdv"))

    def borders(self) -> DataFrame:
        hours = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
        return self.table("events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("readid"), hours.alias("border")).distinct()

    def tool_segments(self) -> DataFrame:
        order = Window.partitionBy("tool", "readid").orderBy("border")
        return self.borders().select("tool", "readid", F.col("border").alias("start"), F.lead("border").over(order).alias("end")).where("end IS NOT NULL")

    def signals(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("readid"), F.col("embedding").cast("array<double>").alias("signal"), "label")

    def lengths(self) -> DataFrame:
        return self.table("documents").select(F.col("lang").alias("grp"), F.col("n_chars").alias("len"))

    def contigs(self) -> DataFrame:
        return self.table("part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("long").alias("len"), (F.col("p_partkey") % 50).cast("double").alias("coverage"))

    def metrics(self) -> DataFrame:
        names = ["total_quantity", "total_price", "n_lines", "present", "missing", "min_length", "truncated"]
        whole = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
        wide = self.table("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("tool")).agg(
            F.round(whole("l_quantity")).cast("long").alias("total_quantity"), F.round(whole("l_extendedprice")).cast("long").alias("total_price"), F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("present"),
            F.count_distinct("l_suppkey").alias("missing"), F.round(F.min("l_quantity")).cast("long").alias("min_length"), F.max("l_linenumber").cast("long").alias("truncated"),
        )
        numbers = wide.unpivot(["tool"], names, "metric", "number").select("tool", "metric", F.col("number").cast("string").alias("value"))
        return numbers.unionByName(wide.select("tool", F.lit("label").alias("metric"), F.concat(F.lit("tool "), "tool").alias("value")))

    def tool_dataset(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        joined = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select((F.col("s_suppkey") % 7).cast("int").alias("tool"), F.col("n_regionkey").alias("dataset"), F.round(F.col("s_acctbal") * 100).cast("long").alias("value"))

    def pairs(self) -> DataFrame:
        at, s = (F.col("readid") % 60).cast("int"), F.col("seq")
        head, tail = F.substring(s, F.lit(1), at), F.substring(s, at + 2, F.length(s))
        changed = F.when(F.col("readid") % 3 == 0, s).when(F.col("readid") % 3 == 1, F.concat(head, tail)).otherwise(F.concat(head, F.lit("A"), tail))
        return self.reads().select("readid", "seq", changed.alias("segmented_seq"), (F.col("readid") % 10 != 0).alias("present"))

    def probs(self) -> DataFrame:
        day = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 864000)
        rows = self.table("events").select(F.col("user_id").alias("readid"), day.alias("day"), F.col("event_id").alias("candidate"), F.exp(-F.col("value") / 100).alias("e"))
        return rows.select("readid", "day", "candidate", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("readid", "day")), 9).alias("p"))

    def param_obs(self) -> DataFrame:
        order = Window.partitionBy("event_type").orderBy("ts", "event_id")
        return self.table("events").select(F.col("event_type").alias("param"), F.row_number().over(order).cast("long").alias("seq_no"), "value")
