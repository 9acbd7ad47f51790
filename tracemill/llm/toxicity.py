"""Toxic spans by a linear-chain conditional random field, trained here.

Only documents carry labels, so tokens are labelled first: a token is toxic where its word or one
of its stems occurs in many different contexts of toxic documents and in hardly any of clean ones
(contexts, not documents: copies of one document count once). The field has word and stem weights
and transitions between the two tags. Scoring runs forward-backward over each whole text; the
tokens' marginals give the offending offsets and, through a logistic of their largest values and
their sum, the score of the document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import releasing, whole_text

#: The classifier is fitted on so many labelled documents of each class at most, those with the least
#: hash of their id; of these, documents of more than TRAIN_CHARS characters are left out.
TRAIN_DOCS = 3000
TRAIN_CHARS = 50_000
THRESHOLD = 0.7
#: A feature marks toxic tokens from so many contexts on, and so many times likelier than in clean text.
MIN_CONTEXTS = 8
MIN_RATIO = 20.0
FEATURES = 1 << 18
WINDOW = 48
#: Passes over the tagged windows; more of them where that would be fewer steps than STEPS.
EPOCHS = 5
STEPS = 150
#: Words whose weight a worker remembers.
REMEMBERED = 300_000
#: Token places that one forward-backward handles.
CELLS = 1_000_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|-–—…«»„“”‘’¡¿"


def features(word: str) -> list[str]:
    """A word's features: itself without punctuation, and its stems."""
    w = word.lower().strip(_EDGE) or word
    return [f"w={w}", *[f"p={w[:k]}" for k in (4, 5, 6) if len(w) > k]]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % FEATURES


def label_features(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that mark toxic tokens, from documents as word lists with their labels.

    A word counts once for each pair of neighbours it is seen between, a stem once for each
    different word that it begins.
    """
    number: dict[str, int] = {}
    words: list[str] = []
    counts = {}
    for toxic in (0, 1):
        ids = []
        for text, y in docs:
            if y == toxic:
                ids.append(0)
                for raw in text:
                    w = raw.lower().strip(_EDGE) or raw
                    if w not in number:
                        number[w] = len(number) + 1
                        words.append(w)
                    ids.append(number[w])
        flat = np.array([*ids, 0], np.uint64)
        seen = flat[1:-1] if len(flat) > 2 else flat[:0]
        key = (flat[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (seen * np.uint64(0xC2B2AE3D27D4EB4F)) ^ ((flat[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(3))
        first = np.unique(key, return_index=True)[1]
        counts[toxic] = np.bincount(seen[first].astype(np.int64), minlength=1)
    total = {y: max(1, int(c[1:].sum())) for y, c in counts.items()}
    types = {y: max(1, int((c[1:] > 0).sum())) for y, c in counts.items()}
    stems = {0: Counter(), 1: Counter()}
    marks = set()
    for k, w in enumerate(words, 1):
        n = {y: int(c[k]) if k < len(c) else 0 for y, c in counts.items()}
        if n[1] >= MIN_CONTEXTS and n[1] / total[1] >= MIN_RATIO * (n[0] + 0.5) / total[0]:
            marks.add(f"w={w}")
        for y in (0, 1):
            if n[y]:
                stems[y].update(features(w)[1:])
    return marks | {f for f, n in stems[1].items() if n >= MIN_CONTEXTS and n / types[1] >= MIN_RATIO * (stems[0][f] + 0.5) / types[0]}


class Field:
    """A two-tag linear chain: weights of tag 1 against tag 0, and transition scores."""

    def __init__(self) -> None:
        self.weight = np.zeros(FEATURES)
        self.bias = -2.0
        self.trans = np.zeros((2, 2))
        self.doc = np.zeros(4)
        self.known: dict[str, float] = {}

    def scores(self, words: Iterable[str]) -> np.ndarray:
        """Emission score of tag 1 for each word."""
        known, out = self.known, []
        for w in words:
            s = known.get(w)
            if s is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                s = known[w] = self.bias + float(sum(self.weight[_slot(f)] for f in features(w)))
            out.append(s)
        return np.array(out)

    def marginals(self, emission: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of tag 1 in a padded block (places, lanes), the forward and the backward odds.

        A message is the odds of tag 1; a step is a fractional linear map of the odds, so it neither
        over- nor underflows.
        """
        steps, lanes = emission.shape
        e, t = np.exp(np.clip(emission, -30, 30)), np.exp(self.trans)
        ahead, back = np.empty((steps, lanes)), np.ones((steps, lanes))
        r = e[0]
        ahead[0] = r
        for k in range(1, steps):
            r = e[k] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            ahead[k] = r
        b = np.ones(lanes)
        for k in range(steps - 2, -1, -1):
            x = e[k + 1] * b
            b = np.where(k + 1 < length, (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1.0)
            back[k] = b
        odds = ahead * back
        return odds / (1 + odds), ahead, back

    def each_marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of each sequence; sequences of like length share a block."""
        out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
        order = sorted((k for k in range(len(emissions)) if len(emissions[k])), key=lambda k: len(emissions[k]))
        while order:
            longest = len(emissions[order[-1]])
            lanes = max(1, min(len(order), CELLS // longest, 512))
            own, order = order[-lanes:], order[:-lanes]
            length = np.array([len(emissions[k]) for k in own])
            block = np.zeros((longest, lanes))
            for lane, k in enumerate(own):
                block[: length[lane], lane] = emissions[k]
            p = self.marginals(block, length)[0]
            for lane, k in enumerate(own):
                out[k] = p[: length[lane], lane].copy()
        return out

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int = EPOCHS, batch: int = 512, rate: float = 0.5) -> None:
        """Gradient ascent (AdaGrad) on the conditional likelihood of tagged windows."""
        slots: dict[str, list[int]] = {}
        placed = []
        for words, _ in sequences:
            for w in words:
                if w not in slots:
                    slots[w] = [_slot(f) for f in features(w)]
            n = [len(slots[w]) for w in words]
            placed.append((np.repeat(np.arange(len(words)), n), np.array([s for w in words for s in slots[w]])))
        epochs = max(epochs, -(-STEPS // max(1, -(-len(sequences) // batch))))
        gw, gb, gt = np.full(FEATURES, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                own = [sequences[j] for j in chosen]
                length = np.array([len(w) for w, _ in own])
                t_of = np.concatenate([placed[j][0] for j in chosen])
                slot_of = np.concatenate([placed[j][1] for j in chosen])
                lane_of = np.repeat(np.arange(len(own)), [len(placed[j][0]) for j in chosen])
                emission = np.full((length.max(), len(own)), 0.0)
                np.add.at(emission, (t_of, lane_of), self.weight[slot_of])
                emission += self.bias
                tags = np.zeros(emission.shape, int)
                for lane, (_, y) in enumerate(own):
                    tags[: len(y), lane] = y
                live = np.arange(len(emission))[:, None] < length
                p, ahead, back = self.marginals(emission, length)
                off = np.where(live, tags - p, 0)
                # pairwise marginals from the odds on either side
                e, t = np.exp(np.clip(emission, -30, 30)), np.exp(self.trans)
                pair = np.empty((2, 2, len(emission) - 1, len(own)))
                for i in (0, 1):
                    for j in (0, 1):
                        pair[i, j] = t[i, j] * (ahead[:-1] if i else 1) * (e[1:] * back[1:] if j else 1)
                pair /= pair.sum(axis=(0, 1))
                both = live[1:]
                real = np.array([[((tags[:-1] == i) & (tags[1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)])
                grad_t = (real - (pair * both).sum(axis=(2, 3))) / len(own)
                grad_w = np.bincount(slot_of, off[t_of, lane_of], FEATURES) / len(own) - 1e-6 * self.weight
                grad_b = off.sum() / len(own)
                gw += grad_w**2
                gb += grad_b**2
                gt += grad_t**2
                self.weight += rate * grad_w / np.sqrt(gw)
                self.bias += rate * grad_b / np.sqrt(gb)
                self.trans += rate * grad_t / np.sqrt(gt)
        self.known.clear()

    @staticmethod
    def summary(p: np.ndarray) -> np.ndarray:
        """What the document's score is made from."""
        if not len(p):
            return np.array([1.0, 0.0, 0.0, 0.0])
        top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
        return np.array([1.0, top[1], top[0], np.log1p(p.sum())])

    def document_score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(p) @ self.doc, -30, 30))))

    def fit_documents(self, rows: np.ndarray, toxic: np.ndarray, prior: float) -> None:
        """Newton steps of a logistic, the classes weighted to their share among all labelled rows."""
        share = toxic.mean()
        weight = np.where(toxic == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
        w = np.zeros(rows.shape[1])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            grad = rows.T @ (weight * (toxic - q)) - 0.1 * w
            hess = (rows * (weight * q * (1 - q))[:, None]).T @ rows + 0.1 * np.eye(len(w))
            w = w + np.linalg.solve(hess, grad)
        self.doc = w


def train(rows: list[tuple[str, int]], prior: float) -> Field:
    """Fit a field on labelled texts. With no toxic or no clean text it scores everything alike, by the prior."""
    field = Field()
    docs = [(_WORD.findall(t), y) for t, y in rows]
    toxic = np.array([y for _, y in docs])
    if not len(docs) or toxic.min() == toxic.max():
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        field.doc = np.array([np.log(prior / (1 - prior)), 0.0, 0.0, 0.0])
        return field
    marks = label_features(docs)
    rng = np.random.default_rng(0)
    hit, clean = [], []
    bad: dict[str, int] = {}
    for words, y in docs:
        for k in range(0, len(words), WINDOW):
            part = words[k : k + WINDOW]
            tags = [0] * len(part)
            for t, w in enumerate(part):
                if w not in bad:
                    bad[w] = int(any(f in marks for f in features(w)))
                tags[t] = bad[w] & y
            (hit if any(tags) else clean).append((part, tags))
    # windows without a toxic token, as many again and half, from all over the sample
    keep = rng.permutation(len(clean))[: max(2000, len(hit) * 3 // 2)]
    field.fit([*hit, *[clean[k] for k in keep]])
    found = field.each_marginals([field.scores(w) for w, _ in docs])
    field.fit_documents(np.array([field.summary(p) for p in found]), toxic, prior)
    return field


def _remainder(divisor: int):
    """Of a document's id; a null id is read as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> bytes:
    """A field, pickled, from at most ``train_docs`` labelled documents of each class.

    Rows with a null label or id are left out; a document labelled twice counts with each label, of
    several texts under one id one counts (that with the least hash). The sample is made of the
    smallest id hashes, so it doesn't depend on the partitioning. Spark joins it to the texts in many
    tasks; one task fits the model, and its input is bounded by the two parameters.
    """
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = labelled.agg(F.avg("toxic")).first()[0]
    sample = None
    for y in (0, 1):
        own = labelled.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        sample = own if sample is None else sample.unionByName(own)
    # two rows for each of train_docs at most
    sample = docs.select("doc_id", whole_text().alias("text")).where(F.length("text") <= train_chars).join(F.broadcast(sample.distinct()), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([dump(train(rows, float(share or 0.0)))], pa.binary())], ["model"])

    made = sample.select("text", "toxic").repartition(1).mapInArrow(run, "model binary").first()
    return made[0] if made else dump(train([], 0.0))  # no partition at all


def dump(field: Field) -> bytes:
    at = np.flatnonzero(field.weight)
    return pickle.dumps((at.astype(np.int32), field.weight[at].astype(np.float32), field.bias, field.trans, field.doc))


def load(model: bytes) -> Field:
    field = Field()
    at, weight, field.bias, field.trans, field.doc = pickle.loads(model)
    field.weight[at] = weight
    return field


_LOADED: dict[int, Field] = {}


def score(docs: DataFrame, model: bytes, threshold: float = THRESHOLD, offsets: bool = True) -> DataFrame:
    """``(doc_id, score, predicted, spans)``; spans are code-point offsets of toxic words, end excluded.

    A null or empty text has no spans and the score of a text without toxic words. Rows are kept as
    they come; only doc_id and text are read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most
    key = zlib.crc32(model)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = load(shared.value)
        field = _LOADED[key]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            k = 0
            while k < len(texts):
                end, chars = k, 0
                while end < len(texts) and (end == k or chars < 8_000_000):
                    chars += len(texts[end])
                    end += 1
                found = field.each_marginals([field.scores(_WORD.findall(t)) for t in texts[k:end]])
                scores = [field.document_score(p) for p in found]
                spans = []
                for text, p in zip(texts[k:end], found, strict=True):
                    if offsets and len(p) and p.max() >= 0.5:
                        spans.append([{"start": m.start(), "end": m.end(), "probability": float(q)} for m, q in zip(_WORD.finditer(text), p, strict=True) if q >= 0.5])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(k, end - k), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))],
                    ["doc_id", "score", "predicted", "spans"],
                )
                k = end

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:bigint,end:bigint,probability:double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = _remainder(3) != 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn)
    model = fit(docs.where(learn), labels)
    return score(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted", "spans")
