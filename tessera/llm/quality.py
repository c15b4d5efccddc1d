"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of their character
n-grams, hashed into a fixed number of buckets; a softmax layer gives the class.
Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``sample``, the rows with the smallest id hashes). Word pairs have
two shared buckets, one for a word that repeats the one before it and one for any
other pair, each counted ``PAIR`` times. Scoring reads
every whole text: as the output is linear in the average, each bucket's vector
is reduced to its share of the logit difference once, and a word to the sum over
its features.

Defined results: a null or empty text has no features and gets the score of the
bias alone; null ids and repeated rows are scored like any other; without
labelled rows the score is 0.5. Labels with a null quality are ignored; an id
labelled twice counts by its larger label.
"""
from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_fold, map_texts, utf8

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4)
SAMPLE = 3000
EPOCHS = 6
LEAST_STEPS = 6000  # small samples are gone through more often
RATE = 0.3
THRESHOLD = 0.3
FOLDS = 5
CACHE = 300_000
PAIR = 4
SAME, OTHER = (xxhash.xxh32_intdigest(x) % BUCKETS for x in (b"pair: same", b"pair: other"))


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams (of its bytes, edges marked)."""
    edged = b"<" + word + b">"
    grams = [edged[i: i + n] for n in GRAMS for i in range(len(edged) - n + 1)]
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in [word, *grams]]


class Cache(dict):
    """Word to a value worked out when first seen; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = self.make(word)
        return value


def pairs(words: list[bytes]) -> tuple[int, int]:
    """Weights of the two pair buckets."""
    same = sum(map(operator.eq, words, words[1:]))
    return PAIR * same, PAIR * (max(0, len(words) - 1) - same)


def bag(text: bytes, buckets_of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares; at most BUCKETS entries however long the text."""
    counts = np.zeros(BUCKETS, np.int64)
    words = text.split()
    for start in range(0, len(words), 50_000):
        part = [buckets_of[w] for w in words[start: start + 50_000]]
        counts += np.bincount(np.concatenate(part), minlength=BUCKETS)
    same, other = pairs(words)
    counts[SAME] += same
    counts[OTHER] += other
    index = np.flatnonzero(counts)
    return index.astype(np.int32), (counts[index] / max(1, counts.sum())).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit difference between the classes, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(rows))))
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs if rows else 0):
        for r in rng.permutation(len(rows)):
            label, index, share = rows[r]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[index]
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            # The gradient of a bucket is its share of the mean; scaled by the number of buckets in the text (up to
            # one), so that long texts teach their words as much as short ones do and no step can overshoot.
            vectors[index] -= (rate * np.minimum(share * len(index), 1))[:, None] * back
    return (vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0])


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Bags of at most ``sample`` labelled documents outside the held-out fold."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", FOLDS) != 0))
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label")))
    # Labels of ids without a document are left out before the sample is drawn.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text")

    def run(batches):
        buckets_of = Cache(lambda w: np.array(features(w), np.int64))
        for batch in batches:
            for i, text in enumerate(utf8(batch.column(2))):
                if text.split(None, 1):
                    index, share = bag(text, buckets_of)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([index.tobytes()], pa.binary()),
                         pa.array([share.tobytes()], pa.binary())], ["doc_id", "label", "idx", "share"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, idx binary, share binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on the bounded sample; repeated rows of an id count once."""
    seen = {}
    for r in labelled(docs, labels, sample).toLocalIterator():
        key = (xxhash.xxh64_intdigest(str(r["doc_id"])), r["doc_id"], bytes(r["idx"]))
        seen[key] = (int(r["label"] > 0), np.frombuffer(r["idx"], np.int32), np.frombuffer(r["share"], np.float32))
    return train([seen[k] for k in sorted(seen)][:sample])


def scored(docs: DataFrame, carry: list[str], model: tuple[np.ndarray, float]) -> DataFrame:
    """Columns ``carry`` of every row with ``score``."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input

    def make():
        table = shared.value

        def value(word):
            f = features(word)
            return complex(float(table[f].sum()), len(f))

        values = Cache(value)

        def score(text):
            words = text.split()
            total = sum(map(values.__getitem__, words), 0j)
            same, other = pairs(words)
            share = total.real + same * table[SAME] + other * table[OTHER]
            z = bias + (share / (total.imag + same + other) if words else 0.0)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return lambda texts: [pa.array([score(t) for t in texts], pa.float64())]

    return map_texts(docs, carry, "score double", make)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    return scored(docs, ["doc_id"], fit(docs, labels, sample)).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept."""
    rows = docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c not in ("doc_id", "text")})
    good = scored(rows, rows.columns, fit(docs, labels, sample)).where(F.col("score") >= threshold)
    return good.select(*[F.col(new).alias(old) for new, old in zip(rows.columns, docs.columns)])
