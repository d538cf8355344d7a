"""Convolutional text classifier trained in numpy: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm import _words
from gradus.llm._memory import tidy
from gradus.llm._words import prefix_hash, slices, span_hash, strings

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 20, 8, 12, (1, 2, 3)
#: Most labelled rows that are learned from (those of the least hash of doc_id).
SAMPLE = 6400
#: One labelled row of so many is never learned from, so thresholds have rows of their own however few are labelled.
KEPT_BACK = 5
#: Width of the steps in which logits are counted for thresholds, and the largest logit that is told apart.
STEP, MOST_LOGIT = 0.01, 30.0
#: A language has a threshold of its own from so many rows of either label on.
LEAST_LABELS = 10
#: Labels that may be broadcast (some 16 bytes each), counted first.
BROADCAST_LABELS = 400_000
#: A bucket has an embedding of its own if so many learned texts hold it.
LEAST_TEXTS = 4
EPOCHS, RATE, BATCH, DECAY = 6, 0.05, 64, 1e-4

#: Frequent words by which a text's language is guessed (fixed values).
FREQUENT = {
    "en": "the of and to in that is was for it with as on be at by this had not are but from or have an they which one you were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec mais ou leur elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me sin".split(),
}

_SEPARATOR = _words.BLANK.copy()
_SEPARATOR[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (between ASCII white space and punctuation, A-Z folded) and each text's first."""
    folded = _FOLD[buf]
    folded[_SEPARATOR[folded]] = 0x20
    start, end, first = _words.words(folded, offsets)
    return span_hash(prefix_hash(folded), start, end), first


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, raw)])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)[0]


_FREQUENT_HASHES = {k: np.sort(_hash_of(v)) for k, v in FREQUENT.items()}
LANGUAGES = [*FREQUENT, "other"]
_ALL_FREQUENT = np.unique(np.concatenate([*_FREQUENT_HASHES.values()]))
_IS_FREQUENT = np.array([np.isin(_ALL_FREQUENT, h) for h in _FREQUENT_HASHES.values()]).T.astype(np.int64)


def guess_language(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number in LANGUAGES of the language whose frequent words a text holds most (first in a tie, other if none)."""
    at = np.minimum(np.searchsorted(_ALL_FREQUENT, h), len(_ALL_FREQUENT) - 1)
    hit = np.flatnonzero(_ALL_FREQUENT[at] == h)
    text = np.searchsorted(first, hit, "right") - 1
    counts = np.zeros((len(first) - 1, len(FREQUENT)), np.int64)
    np.add.at(counts, text, _IS_FREQUENT[at[hit]])
    return np.where(counts.any(1), counts.argmax(1), len(FREQUENT))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    row_of: np.ndarray  # bucket → row of the embedding; row 0 is padding and unknown words
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width, DIM, FILTERS) of each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    offset: np.ndarray  # logit of the threshold, by guessed language
    tables: list | None = None  # each embedding row's response to each position of each filter, once learned

    def rows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of all texts, each followed by padding, and where each text begins."""
        pad = max(WIDTHS)
        rows = np.zeros(len(h) + pad * (len(first) - 1), np.int64)
        rows[np.arange(len(h)) + pad * np.repeat(np.arange(len(first) - 1), np.diff(first))] = self.row_of[_bucket(h)]
        return rows, first[:-1] + pad * np.arange(len(first) - 1)

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        rows, begin = self.rows(h, first)
        pooled = []
        if self.tables is None:
            self.tables = [[self.embedding @ k for k in kernel] for kernel in self.filters]
        for w, parts in zip(WIDTHS, self.tables):
            n = len(rows) - w + 1
            response = parts[0][rows[:n]]
            for j in range(1, w):
                response += parts[j][rows[j : n + j]]
            pooled.append(np.maximum.reduceat(response, begin, axis=0))
        features = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        return features @ self.out + self.out_bias

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        logit = self.logits(h, first) - self.offset[guess_language(h, first)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _step(m: Model, state: dict, rows: np.ndarray, begin: np.ndarray, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    ends = np.append(begin[1:], len(rows))
    x = m.embedding[rows]
    best, place = [], []
    for w, kernel in zip(WIDTHS, m.filters):
        n = len(rows) - w + 1
        response = sum(x[j : n + j] @ kernel[j] for j in range(w))
        at = np.stack([response[lo : min(hi, n)].argmax(0) + lo for lo, hi in zip(begin, ends)])
        place.append(at)
        best.append(np.take_along_axis(response, at, 0))
    raw = np.concatenate(best, 1) + m.bias
    mask = rng.random(raw.shape) < 0.8
    features = np.maximum(raw, 0) * mask / 0.8
    p = 1 / (1 + np.exp(-np.clip(features @ m.out + m.out_bias, -30, 30)))
    g = (p - label) * weight / len(label)
    d_feature = g[:, None] * m.out[None, :] * (raw > 0) * mask / 0.8
    grads = {"out": features.T @ g + DECAY * m.out, "bias": d_feature.sum(0)}
    d_rows, d_values = [], []
    for i, (w, kernel, at) in enumerate(zip(WIDTHS, m.filters, place)):
        d = d_feature[:, i * FILTERS : (i + 1) * FILTERS]
        grads[f"f{i}"] = np.stack([np.einsum("dfk,df->kf", x[at + j], d) for j in range(w)]) + DECAY * kernel
        for j in range(w):
            d_rows.append(rows[at + j].ravel())
            d_values.append((d[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))

    def adagrad(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        seen = state.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        seen += grad**2
        value -= (RATE * grad / np.sqrt(seen)).astype(value.dtype)

    adagrad("out", m.out, grads["out"])
    adagrad("bias", m.bias, grads["bias"])
    for i, kernel in enumerate(m.filters):
        adagrad(f"f{i}", kernel, grads[f"f{i}"])
    m.out_bias -= RATE * float(g.sum())
    touched, back = np.unique(np.concatenate(d_rows), return_inverse=True)
    d_embedding = np.zeros((len(touched), DIM), np.float32)
    np.add.at(d_embedding, back, np.concatenate(d_values).astype(np.float32))
    seen = state.setdefault("embedding", np.full(m.embedding.shape, 1e-6, np.float32))
    seen[touched] += d_embedding**2
    m.embedding[touched] -= RATE * d_embedding / np.sqrt(seen[touched])
    m.embedding[0] = 0


def threshold(counts: np.ndarray) -> float:
    """Logit cut with the fewest errors for counts[label, step]: the middle of its gap (nearest to 0 in a tie)."""
    held = np.flatnonzero(counts.sum(0))
    unit = round(1 / STEP)
    lo, hi = max(held[0] - unit, 0), min(held[-1] + 1 + unit, counts.shape[1])  # a unit beyond the outermost
    below = np.concatenate([[0], np.cumsum(counts[1])])
    above = np.concatenate([np.cumsum(counts[0][::-1])[::-1], [0]])
    errors = (below + above)[lo : hi + 1]
    good = np.flatnonzero(errors == errors.min())
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    cuts = [(lo + (r[0] + r[-1]) / 2) * STEP - MOST_LOGIT for r in runs]
    return float(min(cuts, key=abs))


def thresholds(counts: np.ndarray) -> np.ndarray:
    """Cut of each language for counts[language, label, step]; that of all together where a language has few labels, 0 without both labels."""
    if not counts.sum((0, 2)).all():
        return np.zeros(len(counts))
    every = threshold(counts.sum(0))
    return np.array([threshold(c) if (c.sum(1) >= LEAST_LABELS).all() else every for c in counts])


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on whole texts; thresholds are left at 0.

    An embedding's first part starts as its bucket's shrunk log odds, the rest at random.
    """
    rng = np.random.default_rng(seed)
    n, y, counts, hashes = len(texts), np.array(labels, np.float32), np.zeros(len(texts), np.int64), []
    bucket, text_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        own = word_hashes(raw, np.array([0, len(raw)]))[0]
        hashes.append(own)
        counts[i] = len(own)
        bucket.append(np.unique(_bucket(own)))
        text_of.append(np.full(len(bucket[-1]), i))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    del hashes
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    bucket, text_of = np.concatenate(bucket), np.concatenate(text_of)
    held = np.bincount(bucket, minlength=BUCKETS)
    toxic = np.bincount(bucket, weights=y[text_of], minlength=BUCKETS)
    known = np.flatnonzero(held >= LEAST_TEXTS)
    row_of = np.zeros(BUCKETS, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    embedding = rng.normal(0, 0.05, (len(known) + 1, DIM)).astype(np.float32)
    share = float(y.mean()) if n else 0.5
    share = min(max(share, 0.01), 0.99)
    odds = (toxic[known] + 4 * share) / (held[known] - toxic[known] + 4 * (1 - share))
    embedding[1:, 0] = np.clip(np.log(odds * (1 - share) / share), -3, 3)
    embedding[0] = 0
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    m = Model(row_of, embedding, kernels, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), float(np.log(share / (1 - share))), np.zeros(len(LANGUAGES)))
    if not len(np.unique(y)) > 1:
        return m
    state: dict = {}
    weights = np.where(y > 0, min(5.0, (1 - share) / share), 1.0).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            own = np.concatenate([h[first[i] : first[i + 1]] for i in ids])
            rows, begin = m.rows(own, np.concatenate([[0], np.cumsum(counts[ids])]))
            _step(m, state, rows, begin, y[ids], weights[ids], rng)
    m.tables = None  # made again where they are used
    return m


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text divides by 5; rows without an id count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def known_labels(labels: DataFrame) -> DataFrame:
    """l_id, toxic of the labels that aren't held out: one a doc_id (the larger), nulls left out."""
    toxic = F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic")
    return labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(toxic)


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[int], list[str], list[int]]:
    """Ids, texts and labels of at most ``most`` rows to learn from: never held out, never kept back for thresholds."""
    known = known_labels(labels).where(F.pmod(F.xxhash64(F.lit("kept back"), "l_id"), F.lit(KEPT_BACK)) != 0)
    chosen = [(r["l_id"], r["toxic"]) for r in known.withColumn("o", F.xxhash64("l_id")).orderBy("o", "l_id").limit(most).collect()]
    right = docs.sparkSession.createDataFrame(chosen, "l_id long, toxic int")
    own = docs.select(F.col("doc_id").cast("long").alias("d_id"), _text())
    rows = own.join(F.broadcast(right), F.col("d_id") == F.col("l_id")).groupBy("d_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["d_id"])
    return [r["d_id"] for r in rows], [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def calibration_counts(docs: DataFrame, labels: DataFrame, learned: list[int], model) -> np.ndarray:
    """counts[language, label, step of logit] over every labelled row that isn't held out and wasn't learned from.

    Rows of one doc_id all count. The labels are broadcast up to BROADCAST_LABELS of them (counted), else joined by
    a shuffle; what reaches the driver is bounded by the number of steps.
    """
    spark, n_steps = docs.sparkSession, round(2 * MOST_LOGIT / STEP)
    done = F.broadcast(spark.createDataFrame([(i,) for i in learned], "done long"))
    others = known_labels(labels).join(done, F.col("l_id") == F.col("done"), "left_anti")
    right = F.broadcast(others) if others.count() <= BROADCAST_LABELS else others
    own = docs.select(F.col("doc_id").cast("long").alias("d_id"), _text()).join(right, F.col("d_id") == F.col("l_id")).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, h, first in _hashed(batches):
            step = np.clip((model.value.logits(h, first) + MOST_LOGIT) // STEP, 0, n_steps - 1).astype(np.int32)
            language = guess_language(h, first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(language), b.column(1).slice(lo, hi - lo), pa.array(step)], names=["language", "toxic", "step"])

    counts = np.zeros((len(LANGUAGES), 2, n_steps), np.int64)
    for r in own.mapInArrow(tidy(run), "language int, toxic int, step int").groupBy("language", "toxic", "step").count().collect():
        counts[r["language"], r["toxic"], r["step"]] = r["count"]
    return counts


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, lo, hi, word hashes, each text's first) by parts of bounded bytes; the text is column 0."""
    for b in batches:
        buf, offsets = strings(b, "text")
        for start, end in slices(offsets, 1 << 20):
            for lo in range(start, end, 4000):
                hi = min(end, lo + 4000)
                yield b, lo, hi, *word_hashes(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Toxicity of every whole text: the columns in ``keep``, score and predicted.

    Learns from at most ``most`` labelled rows that aren't held out; the thresholds
    come from all other rows that aren't held out. A score is a
    function of the text alone; the language that shifts its threshold is guessed
    from the text's frequent words. Labels may be integers or booleans. Null text is empty and empty texts get a
    score; with no labels of both kinds scores are those of an untrained model; repeated rows are scored alike;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    named, known = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    ids, texts, toxic = labelled_sample(named, known, most)
    fitted = train(texts, toxic)
    del texts
    raw = spark.sparkContext.broadcast(fitted)
    fitted.offset = thresholds(calibration_counts(named, known, ids, raw))
    raw.unpersist()
    model = spark.sparkContext.broadcast(fitted)
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(_text(), *columns)
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, h, first in _hashed(batches):
            s = model.value.scores(h, first)
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double, predicted int"])
    out = source.mapInArrow(tidy(run), schema)
    return out.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    columns = docs.columns
    renamed = docs.select("doc_id", "text", *(F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)))
    scored = score(renamed, labels, most, keep=tuple(f"own_{i}" for i in range(len(columns))))
    return scored.where("predicted = 0").select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)))
