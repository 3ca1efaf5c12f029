"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the words of a text is trained with numpy on the driver
from confirmed toxic texts and unlabelled ones. With class prior p the risk is
p * R_p(+) + max(0, R_u(-) - p * R_p(-)): unlabelled texts stand for the
negatives after the share of positives among them is taken off, and where
that estimate falls below zero, over-fitting is undone by a step the other way.
The samples it is fitted on are bounded by documented parameters; every text
is scored whole.

The prior is the toxic share among labelled rows, which are taken as drawn at
random. Labels are learnt from rows only whose crc32(doc_id as text) mod 4 is not 2.
Null, empty and wordless texts get the score of no evidence; a null doc_id is
neither held out nor learnt from; without labelled toxic rows every score is
the prior, 0 for no labels at all. Columns other than those named are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table
from .text import as_bytes, slices, spans, word_hashes

#: Texts at most that the classifier is fitted on, of those labelled toxic and of all; and distinct words at most of one of them.
MOST_POSITIVE, MOST_UNLABELLED, MOST_WORDS = 3000, 6000, 1 << 14
THRESHOLD = 0.3
#: Standard errors by which a word's share of positives must differ from its share of unlabelled texts.
EVIDENCE = 5.0
STEPS = 300


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each text: the sigmoid of the bias and the weights of its distinct words."""
        data, offsets = as_bytes(column)
        out = np.full(len(offsets) - 1, self.bias)
        marks = np.zeros(1 << 16, bool)
        marks[(self.words >> np.uint64(48)).astype(np.int64)] = True
        for lo, hi in slices(offsets):
            own = offsets[lo : hi + 1]
            part = data[own[0] : own[-1]]
            hashes, row = _row_words(part, own - own[0])
            if not len(self.words):
                continue
            near = np.flatnonzero(marks[(hashes >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, hashes[near]), len(self.words) - 1)
            hit = self.words[at] == hashes[near]
            pair = np.unique(row[near][hit].astype(np.int64) * len(self.words) + at[hit])
            out[lo:hi] += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _row_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word; ASCII punctuation parts words as white space does."""
    data = np.where(_PARTS[data], np.uint8(0x20), data)
    starts, ends, first = spans(data, offsets)
    return word_hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


_PARTS = np.zeros(256, bool)
_PARTS[[b for b in range(128) if not chr(b).isalnum()]] = True


def _featured(docs: DataFrame) -> DataFrame:
    """(positive, words): the distinct word hashes of each text, the ``MOST_WORDS`` least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            lists = []
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1]
                hashes, row = _row_words(data[own[0] : own[-1]], own - own[0])
                cuts = np.searchsorted(row, np.arange(1, hi - lo))
                lists += [np.unique(x)[:MOST_WORDS].tobytes() for x in np.split(hashes, cuts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.binary())], names=["positive", "words"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, words binary")


def fit(docs: DataFrame, labels: DataFrame, most_positive=MOST_POSITIVE, most_unlabelled=MOST_UNLABELLED) -> Model:
    """Train from labels (doc_id, toxic) and the texts of docs (doc_id, text)."""
    learnt = id_remainder("doc_id", 4) != 2
    known = labels.select("doc_id", "toxic").where(learnt & F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = (toxic or 0) / n if n else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (500.0 if prior else -500.0))
    if not 0 < prior < 1:
        return none
    # samples by the order of a hash: the same rows on every run
    order = F.xxhash64("doc_id"), F.col("doc_id")
    positive = known.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(most_positive)
    unlabelled = docs.select("doc_id").where(learnt).distinct().orderBy(*order).limit(most_unlabelled)
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    # broadcast is bounded by the two limits
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    groups = {True: {}, False: {}}
    for row in _featured(texts).toLocalIterator():
        seen, x = groups[row["positive"]], np.frombuffer(row["words"], np.uint64)
        # copies count once; where ids repeat, what goes beyond the limits is left out
        if len(seen) < (most_positive if row["positive"] else most_unlabelled):
            seen.setdefault((len(x), int(np.bitwise_xor.reduce(x)) if len(x) else 0), x)
    positive, unlabelled = ([seen[k] for k in sorted(seen)] for seen in (groups[True], groups[False]))
    return _train(positive, unlabelled, prior) if positive and unlabelled else none


def _train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    n_p, n_u = len(positive), len(unlabelled)
    words, inverse = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    row = np.repeat(np.arange(n_p + n_u), [len(x) for x in (*positive, *unlabelled)])
    in_p = np.bincount(inverse[row < n_p], minlength=len(words))
    in_u = np.bincount(inverse[row >= n_p], minlength=len(words))
    pooled = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_p + 1 / n_u))
    kept = (np.abs(in_p / n_p - in_u / n_u) > EVIDENCE * error) & (in_p + in_u >= 5)
    column = np.cumsum(kept) - 1
    use = kept[inverse]
    row, col, k = row[use], column[inverse[use]], int(kept.sum())
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    is_p = np.arange(n_p + n_u) < n_p
    for step in range(1, STEPS + 1):
        f = b + np.bincount(row, w[col], n_p + n_u)
        s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        softplus = np.logaddexp(0, f)  # the loss of calling a text clean
        rest = softplus[~is_p].mean() - prior * softplus[is_p].mean()
        if rest >= 0:
            g = np.where(is_p, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)
        else:
            g = np.where(is_p, prior * s / n_p, -s / n_u)
        grad = np.append(np.bincount(col, g[row], k) + 1e-4 * w, g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(words[kept], w, float(b))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(b.schema.get_field_index("text"))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
