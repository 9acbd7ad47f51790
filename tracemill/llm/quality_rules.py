"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures each document once and stores one failure bit per rule. A ``Policy`` is a
version and the set of rules that reject; ``apply_policy`` and ``ablations`` work on the stored
bits alone, so that a new policy never reads the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import BLANKS, materialise, whole_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rules in bit order: a rule never changes its bit, new ones are appended. SQL on the measures.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines > 3 AND 2 * n_dup_lines > n_lines"),
    ("shouting", "n_upper > n_lower"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rejecting rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_words"))
PRODUCTION = Policy("production-1", tuple(BIT))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    Window hashes are sorted with their places inside the row, so equal windows are neighbours:
    n log n in the length of the text, and nothing is shuffled.
    """
    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= 4, F.sort_array(hashed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """One row per document: id, measures (long) and ``failure_bits`` (long).

    With ``whole_row`` the document itself goes along as the struct ``row`` in place of the id.

    A null text counts as empty: no words, every measure zero, ``few_words`` set. Rows are kept
    as they come, also repeated ids; other columns of ``docs`` are not read. An empty table
    gives an empty ledger.
    """
    text = F.col("_text")
    kept = F.struct(*[docs[c] for c in docs.columns]).alias("row") if whole_row else docs[id_col]
    key = "row" if whole_row else id_col
    out = docs.select(kept, whole_text(text_col).alias("_text"))
    out = out.withColumns(
        {
            "_trimmed": F.btrim(text, F.lit(BLANKS)),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
            "n_lower": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Ll}", ""))).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
        }
    )
    out = out.withColumns(
        {
            "_words": F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", r"[\x20\x09-\x0D]+")),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines", "_trimmed", "_text")
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_w": _repeat_words(F.col("_words"))}).drop("_words")
    w = F.col("_w")
    twice = F.filter(w, lambda x, k: F.coalesce(F.get(w, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(w, k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_d", F.transform(twice, lambda x: x["i"])).drop("_w")
    covered = F.array_distinct(F.flatten(F.transform("_d", lambda i: F.array(i, i + 1, i + 2))))
    out = out.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_d")
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    # never negative: a filter on the bits stays above them instead of measuring again for each use
    once = F.when(F.monotonically_increasing_id() < 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(key, *MEASURES, bits.bitwiseOR(once).alias("failure_bits"))


def apply_policy(rows: DataFrame, policy: Policy, out_col: str = "kept") -> DataFrame:
    """Adds a boolean column: true where none of the policy's rules failed."""
    return rows.withColumn(out_col, F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: ``(version, rule, failed, only_this, kept_without)``.

    ``failed``: documents that fail the rule; ``only_this``: those that no other rule of the policy
    rejects; ``kept_without``: documents kept if the rule were left out. Documents with equal bits
    are counted first, so at most 2^rules rows reach the comparison.
    """
    counted = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = sorted(set(policy.rules), key=BIT.get)
    each = counted.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in rules])).alias("r"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return (
        each.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            n(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
            n(F.col("bits") == F.col("r.bit")).alias("only_this"),
            n((F.col("bits") == F.col("r.bit")) | (F.col("bits") == 0)).alias("kept_without"),
        )
    )


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder and read again: policies and ablations read it, not the texts."""
    return materialise(ledger(docs), "ledger")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy does on its own to all documents, from the stored bits."""
    return ablations(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), PRODUCTION)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = apply_policy(apply_policy(rows, PRODUCTION), BASE, "_base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failure_bits")


def rejecting_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the production policy rejects go."""
    return apply_policy(ledger(docs, whole_row=True), PRODUCTION).where("kept").select("row.*")


_RULES_SQL = " | ".join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES)
_MEASURED = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
wi AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM wi),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(t) - length(regexp_replace(t, '\p{{Ll}}', '', 'g')) AS BIGINT) AS n_lower,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST({_RULES_SQL} AS BIGINT) AS failure_bits FROM m)
"""
ORACLE_SQL = _MEASURED + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
"""
ABLATIONS_SQL = _MEASURED + ", r(rule, bit) AS (VALUES " + ", ".join(f"('{name}', {BIT[name]})" for name, _ in RULES) + """)
SELECT 'production-1' AS version, rule, count(*) FILTER (WHERE failure_bits & bit <> 0) AS failed, count(*) FILTER (WHERE failure_bits = bit) AS only_this,
  count(*) FILTER (WHERE failure_bits IN (bit, 0)) AS kept_without FROM b, r GROUP BY rule
"""
