"""Column functions over sequences, signals and levels. All of them are built-in expressions."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nine A in front of a reversed RNA sequence stand for its tail.
TAIL = "A" * 9
LOG_2PI = math.log(2 * math.pi)
MAD_SCALE = 1.4826


def signal_window(signal: Column, sp: Column, ts: Column, ns: Column) -> Column:
    """``signal[sp + ts : sp + ns]``; shorter where the signal ends, empty where it ends before."""
    return F.slice(signal, sp + ts + 1, F.greatest(F.lit(0), ns - ts))


def znorm(signal: Column, shift: Column, scale: Column) -> Column:
    return F.transform(signal, lambda x: (x - shift) / scale)


def orient_sequence(seq: Column, is_rna: bool) -> Column:
    """RNA runs 3' to 5': reversed, with a tail in front unless it begins with one."""
    if not is_rna:
        return seq
    back = F.reverse(seq)
    return F.when(back.startswith(TAIL), back).otherwise(F.concat(F.lit(TAIL), back))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none where the sequence is shorter. Linear in the sequence: a substring at i would count i letters."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def kmer_to_int(kmer: Column) -> Column:
    """Base-4 number of a k-mer over ACGT, first letter most significant."""
    digits = F.transform(F.split(F.translate(kmer, "ACGT", "0123"), ""), lambda c: c.cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: F.when(c.isNull(), a).otherwise(a * 4 + c))


def int_to_kmer(number: Column, k: int) -> Column:
    letters = F.array(*map(F.lit, "ACGT"))
    return F.array_join(F.array(*[F.get(letters, F.shiftright(number, 2 * j).bitwiseAND(F.lit(3).cast("long")).cast("int")) for j in range(k - 1, -1, -1)]), "")


def successors(number: Column, k: int) -> Column:
    """The four k-mers whose first k-1 letters are this one's last."""
    return F.transform(F.array(*[F.lit(b).cast("long") for b in range(4)]), lambda b: (number % 4 ** (k - 1)) * 4 + b)


def predecessors(number: Column, k: int) -> Column:
    return F.transform(F.array(*[F.lit(b).cast("long") for b in range(4)]), lambda b: F.shiftright(number, 2) + b * 4 ** (k - 1))


def hamming_penalty(a: Column, b: Column) -> Column:
    """-2 for each position at which two k-mers differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(-2)), F.lit(0), lambda s, x: s + x)


def log_normal_pdf(x: Column, mean: Column, stdv: Column) -> Column:
    z = (x - mean) / stdv
    return -0.5 * z * z - F.log(stdv) - LOG_2PI / 2


def log_plus(a: Column, b: Column) -> Column:
    """log(exp a + exp b); minus infinity is its zero."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def nt_count(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))).cast("long")


def nt_ratio(seq: Column, base: str) -> Column:
    """Share of a base; null for an empty sequence."""
    return F.try_divide(nt_count(seq, base).cast("double"), F.length(seq).cast("double"))


def motif(seq: Column, pos: Column, k: int) -> Column:
    """Letters pos-k//2 .. pos+k//2, clipped at the ends."""
    start = F.greatest(pos - k // 2, F.lit(0))
    return F.substring(seq, start + 1, F.least(pos + k // 2 + 1, F.length(seq)) - start)


def padded_motif(seq: Column, pos: Column, k: int) -> Column:
    """The same, always 2*(k//2)+1 letters, N beyond the ends."""
    pad = "N" * (k // 2)
    return F.substring(F.concat(F.lit(pad), seq, F.lit(pad)), pos + 1, F.lit(2 * (k // 2) + 1))


def rna_flip(basepos: Column, motif_col: Column, length: Column) -> tuple[Column, Column]:
    return length - basepos - 1, F.reverse(motif_col)


def polish_text(polish: Column) -> Column:
    return F.coalesce(F.nullif(polish, F.lit("")), F.lit("NA"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def array_median(values: Column) -> Column:
    """Exact median: mean of the middle two; null elements are left out; null for an empty array."""
    n = F.size
    middle = lambda s: (F.get(s, ((n(s) - 1) / 2).cast("int")).cast("double") + F.get(s, (n(s) / 2).cast("int")).cast("double")) / 2
    return let(F.sort_array(F.array_compact(values)), lambda s: F.when(n(s) > 0, middle(s)))


def array_mad(values: Column) -> Column:
    """Unscaled median absolute deviation."""
    return let(array_median(values), lambda m: array_median(F.transform(values, lambda x: F.abs(x - m))))


def base_from_motif(motif_col: Column) -> Column:
    dna = F.replace(motif_col, F.lit("U"), F.lit("T"))
    return F.substring(dna, (F.length(dna) / 2).cast("int") + 1, F.lit(1))


def rename_labels(label: Column, names: dict[str, str]) -> Column:
    """Known labels renamed, others lower-cased with spaces for underscores."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, label), F.lower(F.replace(label, F.lit("_"), F.lit(" "))))


def to_numeric(text: Column) -> Column:
    return text.try_cast("double")


def combined_cell(score: Column, value: Column) -> Column:
    """``score_{value}``: the score with two decimals, a decimal-number value with one."""
    shown = F.when(value.rlike(r"^\d+\.\d+$"), F.format_string("%.1f", value.try_cast("double"))).otherwise(value)
    return F.concat(F.format_string("%.2f", score), F.lit("_{"), shown, F.lit("}"))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def linspace_borders(start: Column, end: Column, n: Column) -> Column:
    """``n`` whole numbers from start to end-1 at even distances, cut off; one is the start."""
    step = F.when(n > 1, (end - 1 - start).cast("double") / (n - 1)).otherwise(F.lit(0.0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(start + i * step))).otherwise(F.array().cast("array<bigint>"))


#: Edits up to which two texts are compared along diagonals before a whole table is computed.
FEW_EDITS = 32


def _common(a: str, b: str, i: int, j: int) -> int:
    """How many letters ``a`` from i on and ``b`` from j on have in common: doubled steps, then halved ones."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 16
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    if n >= most:
        return most
    while step > 1:
        step //= 2
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
    return n


def few_edits(a: str, b: str, most: int = FEW_EDITS) -> int | None:
    """The edit distance if it is at most ``most``, else none: how far each diagonal gets with 0, 1, 2, ... edits."""
    goal, far = len(b) - len(a), {}
    if abs(goal) > most:
        return None
    for edits in range(most + 1):
        now = {}
        for k in range(-edits, edits + 1):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -2), far.get(k + 1, -2) + 1) if edits else 0
            i = min(i, len(a), len(b) - k)
            if i < 0 or i + k < 0:
                continue
            now[k] = i + _common(a, b, i, i + k)
        if now.get(goal) == len(a):
            return edits
        far = now
    return None


def edit_count(a: str | None, b: str | None, free_lead: bool = False) -> int | None:
    """Edit distance with unit costs: along diagonals where it is small, else Myers' bit vectors, a whole column of the table as one number.

    What both begin or end with costs nothing; with ``free_lead`` neither does what ``b`` has before it. Spark's levenshtein walks each text from its start for
    every letter, which doesn't end on whole reads.
    """
    if a is None or b is None:
        return None
    k = 0 if free_lead else len(os.path.commonprefix([a, b]))
    a, b = a[k:], b[k:]
    k = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) if free_lead else max(len(a), len(b))
    if not free_lead and (few := few_edits(a, b)) is not None:
        return few
    m = len(a)
    equal = {c: int("".join("1" if x == c else "0" for x in reversed(a)), 2) for c in set(a) & set(b)}
    full, up, down, edits = (1 << m) - 1, (1 << m) - 1, 0, m
    for c in b:
        eq = equal.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(across | up)), up & across
        edits += (more >> (m - 1) & 1) - (less >> (m - 1) & 1)
        more, less = (more << 1 | (not free_lead)) & full, (less << 1) & full
        up, down = less | (full & ~(eq | down | more)), more & (eq | down)
    return edits


def edits(a: Column, b: Column, free_lead: bool = False) -> Column:
    """``edit_count`` of whole texts. Pairs go to Python by the hundred, not by Arrow's ten thousand: a batch of whole reads is large."""
    return F.udf(partial(edit_count, free_lead=free_lead), "long", useArrow=False)(a, b)


# Molecule, k, and the probabilities of entering and of staying in a k-mer, by pore type.
PORES = [
    ("rna002", True, 5, 0.019889650396799997, 0.9801103496029998),
    ("rna004", True, 9, 0.031111753637096777, 0.9688882463622581),
    ("dna_r9", False, 5, 1.0, 1.0),
    ("dna_r10_260", False, 9, 0.031111753637096777, 0.9688882463622581),
    ("dna_r10_400", False, 9, 0.031111753637096777, 0.9688882463622581),
]


def pore(name: str) -> tuple[str, bool, int, dict[str, float]]:
    """Name, whether it reads RNA, k, and the transition logs of a pore type."""
    for own, rna, k, m1, e2 in PORES:
        if own == name:
            return own, rna, k, {"m1": math.log(m1), "e1": 0.0, "e2": math.log(e2)}
    raise ValueError(f"no pore type {name!r}; there are {', '.join(p[0] for p in PORES)}")


def pore_defaults(spark):
    """k, molecule and transition logs of each pore type; a fixed small table for broadcasting."""
    rows = [pore(p[0]) for p in PORES]
    return spark.createDataFrame(rows, "pore string, is_rna boolean, k int, params map<string,double>")
