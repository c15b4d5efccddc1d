"""Language-model scores: counts with add-one smoothing, and a log-bilinear neural model.

Tokens are words between ASCII white space, A-Z in lower case, then one end a
text. Word counts of all training texts are summed by the bucket of the word's
hash and come back to each text's block (see blocks). The neural model knows the
``classes`` most frequent words, one class for all other words, and the end. The
vector predicted from the two classes before a token is the sum of their vectors,
weighed by position; its product with a class's vector plus a bias is that class's
score. It is trained by noise-contrastive estimation in numpy: the counts of all
class triples of the training texts are a table of at most classes**3 rows, dealt
into a fixed number of parts; each epoch trains every part from the same
parameters on all of its counts, each with its whole weight, and averages the parts' results.
Then one matrix product gives the normaliser of every context. A word outside the
classes has the probability of its class times its smoothed share in it.

Defined results: a null or empty text is one end token; each input row gives one
row, null and repeated ids too; without training texts all counts are 0 and the
model is uniform.
"""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import crc_fold, utf8, written

CLASSES = 512
START, REST, END, FIRST = 0, 1, 2, 3
DIM, NOISE, DRAW = 32, 32, 2048
PARTS, EPOCHS, STEPS, RATE = 8, 3, 150, 0.1
FOLDS, HELD_OUT = 7, 2
SCORES = "n_tokens bigint, n_known bigint, base_score double, score double"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Splitter:
    def __init__(self):
        self.number, self.texts = blocks.Numbering(), []

    def add(self, text: bytes) -> None:
        self.texts.append(list(map(self.number.__getitem__, words_of(text))))

    def finish(self):
        lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        codes = np.fromiter(chain.from_iterable(self.texts), np.int64, int(lengths.sum()))
        rank = np.argsort(-np.bincount(codes, minlength=len(self.number)), kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        words = list(self.number)
        return place[codes], lengths, [words[i] for i in rank.tolist()]


def in_training(block: blocks.Block) -> np.ndarray:
    """How often each word of a block stands in its training texts."""
    flags = np.repeat(np.array(block.rows.column(1).to_pylist(), bool), block.lengths)
    return np.bincount(block.codes[flags], minlength=len(block.words))


def count_words(group: pa.Table) -> pa.Table:
    """For each block of a bucket its words' counts in all training texts; one more row has the bucket's sums and most frequent words."""
    rows = [(block, blocks.unpacked_bytes(lengths, words), blocks.unpacked(weights)) for block, lengths, words, weights in zip(
        *(group.column(c).to_pylist() for c in ("block", "lengths", "words", "weights")))]
    total: dict[bytes, int] = {}
    for _, words, weights in rows:
        for w, n in zip(words, weights.tolist()):
            total[w] = total.get(w, 0) + n
    bucket = group.column("bucket")[0].as_py()
    known = [(w, n) for w, n in total.items() if n]
    top = sorted(known, key=lambda x: (-x[1], x[0]))[:CLASSES]
    out = {
        "block": [r[0] for r in rows] + [None], "bucket": [bucket] * (len(rows) + 1),
        "counts": [blocks.packed_long(np.array([total[w] for w in words], np.int64)) for _, words, _ in rows] + [None],
        "n": [None] * len(rows) + [sum(n for _, n in known)], "v": [None] * len(rows) + [len(known)],
        "top": [None] * len(rows) + [[{"word": w, "times": n} for w, n in top]]}
    return pa.table(out, pa.schema([
        ("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()),
        ("top", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))]))


COUNTED = "block string, bucket int, counts binary, n bigint, v bigint, top array<struct<word: binary, times: bigint>>"


def triples(rows: DataFrame, classes: dict[bytes, int]) -> DataFrame:
    """(triple, times): counts of (two before, one before, token) over all training texts."""
    def run(batches):
        of = classes.get
        for batch in batches:
            keys = []
            for text in utf8(batch.column(2)):
                ids = [START, START, *[of(w, REST) for w in words_of(text)], END]
                a = np.array(ids, np.int64)
                keys.append((a[:-2] * CLASSES + a[1:-1]) * CLASSES + a[2:])
            if keys:
                key, times = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(times.astype(np.int64))], ["triple", "times"])

    found = rows.where("train").mapInArrow(run, "triple bigint, times bigint")
    return found.groupBy("triple").agg(F.sum("times").alias("times"))


def first_model(share: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random vectors; the bias starts at the classes' shares."""
    rng = np.random.default_rng(seed)
    n = len(share)
    return {"context": rng.normal(0, 0.1, (n, DIM)).astype(np.float32), "target": rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
            "place": np.ones((2, DIM), np.float32), "bias": np.log(share).astype(np.float32)}


def sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``index``."""
    d = values.shape[1]
    flat = (index[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, values.ravel(), n * d).reshape(n, d).astype(np.float32)


def pieces(times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight): every count cut into equal pieces of at most ``most``-th of the sum, so that no step is one count's."""
    cuts = np.maximum(np.ceil(times * (most / times.sum())).astype(np.int64), 1)
    return np.repeat(np.arange(len(times)), cuts), np.repeat(times / cuts, cuts)


def train_part(model: dict[str, np.ndarray], triple: np.ndarray, times: np.ndarray, share: np.ndarray, steps: int, seed: int):
    """Noise-contrastive steps (AdaGrad) over all counts of one part, each with its whole weight; ``steps`` at least."""
    rng = np.random.default_rng(seed)
    model = {k: v.copy() for k, v in model.items()}
    square = {k: np.full_like(v, 1e-3) for k, v in model.items()}
    noise_upto, n = np.cumsum(share), len(share)
    log_noise = np.log(NOISE * share).astype(np.float32)
    index, weight = pieces(times, max(len(times), steps * DRAW))
    order = rng.permutation(len(index))
    steps = max(steps, -(-len(index) // DRAW))
    weight = (weight * (steps / times.sum())).astype(np.float32)  # a step's weights sum to 1 on average
    for of_step in np.array_split(order, steps):
        drawn, part = triple[index[of_step]], weight[of_step]
        a, b, w = drawn // (n * n), drawn // n % n, drawn % n
        noise = np.minimum(np.searchsorted(noise_upto, rng.random(NOISE)), n - 1)
        context, target, place, bias = (model[k] for k in ("context", "target", "place", "bias"))
        ca, cb = context[a], context[b]
        h = place[0] * ca + place[1] * cb
        good = np.einsum("ij,ij->i", h, target[w]) + bias[w] - log_noise[w]
        bad = h @ target[noise].T + bias[noise] - log_noise[noise]
        g = (1 / (1 + np.exp(-np.clip(good, -30, 30))) - 1) * part
        gn = 1 / (1 + np.exp(-np.clip(bad, -30, 30))) * part[:, None]
        back = g[:, None] * target[w] + gn @ target[noise]
        grads = {
            "context": sums(a, place[0] * back, n) + sums(b, place[1] * back, n),
            "target": sums(w, g[:, None] * h, n) + sums(noise, gn.T @ h, n),
            "place": np.stack([(ca * back).sum(0), (cb * back).sum(0)]),
            "bias": (np.bincount(w, g, n) + np.bincount(noise, gn.sum(0), n)).astype(np.float32)}
        for k, v in grads.items():
            square[k] += v * v
            model[k] -= RATE * v / np.sqrt(square[k])
    return model


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at: at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def part_trainer(model: dict[str, np.ndarray], share: np.ndarray, epoch: int):
    """Trains the group of one part from ``model``."""
    def work(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        triple, times = group.column("triple").to_numpy(), group.column("times").to_numpy()
        order = np.argsort(triple)  # the same steps in whatever order the rows come
        got = train_part(model, triple[order], times[order], share, STEPS, seed=1000 * epoch + part)
        return pa.table({"weight": [float(times.sum())], "values": [flat(got).tobytes()]},
                        pa.schema([("weight", pa.float64()), ("values", pa.binary())]))

    return work


def train(counts: DataFrame, n: int = CLASSES) -> dict[str, np.ndarray]:
    """Model of the triple counts (a written table)."""
    seen = np.ones(n)
    for row in counts.groupBy((F.col("triple") % n).alias("w")).agg(F.sum("times").alias("times")).collect():  # n rows at most
        seen[row["w"]] += row["times"]
    seen[START] = 1e-9  # never a token
    share = seen / seen.sum()
    model = first_model(share)
    parts = counts.withColumn("part", F.pmod(F.xxhash64("triple"), F.lit(PARTS)).cast("int"))
    for epoch in range(EPOCHS):
        work = part_trainer(model, share, epoch)
        trained = parts.groupBy("part").applyInArrow(work, "weight double, values binary").collect()  # PARTS rows of fixed size
        if trained:
            weight = np.array([r["weight"] for r in trained])
            values = np.array([np.frombuffer(r["values"], np.float32) for r in trained], np.float64)
            model = shaped((weight / weight.sum()) @ values, model)
    return model


def log_tables(model: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Scores of (two before, token) and of (one before, token) with the bias, and the log normaliser of each context.

    exp of a sum is the product of the exps, so the normalisers of all contexts are one matrix product.
    """
    far = (model["place"][0] * model["context"]).astype(np.float64) @ model["target"].T
    near = (model["place"][1] * model["context"]).astype(np.float64) @ model["target"].T + model["bias"]
    near[:, START] = -1e9
    top_far, top_near = far.max(1, keepdims=True), near.max(1, keepdims=True)
    whole = np.exp(far - top_far) @ np.exp(near - top_near).T
    return far, near, np.log(whole) + top_far + top_near.T


def lm_scores(docs: DataFrame, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held_out = crc_fold("doc_id", FOLDS) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out).alias("train"), "text")
    buckets = blocks.bucket_count(spark)
    counted = written(blocks.by_bucket(blocks.word_rows(rows, Splitter, buckets, in_training, block_bytes), count_words, COUNTED), "lm-counts")
    sums_of = counted.where("block IS NULL")
    n, v = sums_of.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = rows.where("train").count()
    n, v = n + ends, v + (ends > 0)
    top = (sums_of.select(F.explode("top").alias("t")).select("t.word", "t.times")
           .orderBy(F.desc("times"), "word").limit(CLASSES - FIRST).collect())
    classes = {bytes(r["word"]): FIRST + i for i, r in enumerate(top)}
    rest_n, rest_v = n - ends - sum(r["times"] for r in top), v - (ends > 0) - len(top)
    tables = spark.sparkContext.broadcast(log_tables(train(written(triples(rows, classes), "lm-triples"))))  # classes**2 numbers each

    def class_of(block):
        return np.fromiter((classes.get(w, REST) for w in block.words), np.uint32, len(block.words))

    def score(row, codes, lengths, mine):
        far, near, whole = tables.value
        kinds = blocks.unpacked(row["weights"]).astype(np.int64)
        times = np.zeros(len(kinds), np.int64)
        for part, value in mine.values():
            times[part] = blocks.unpacked_long(value["counts"])
        base = np.log10((times + 1) / (n + v + 1))
        inside = np.where(kinds == REST, np.log10((times + 1) / (rest_n + rest_v + 1)), 0.0)
        tokens, known, base_out, out = [], [], [], []
        upto = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        for a, b in zip(upto, upto[1:]):
            c = codes[a:b]
            k = np.concatenate([[START, START], kinds[c], [END]])
            two, one, w = k[:-2], k[1:-1], k[2:]
            model = (far[two, w] + near[one, w] - whole[two, one]).sum() / np.log(10)
            tokens.append(b - a + 1)
            known.append(int((times[c] > 0).sum()) + (ends > 0))
            base_out.append(float(base[c].sum() + np.log10((ends + 1) / (n + v + 1))))
            out.append(float(model + inside[c].sum()))
        return [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base_out, pa.float64()), pa.array(out, pa.float64())]

    scored = blocks.reassemble(rows, counted.where("block IS NOT NULL").select("block", "bucket", "counts"), Splitter, buckets, score,
                               ["doc_id", "train"], SCORES, class_of, block_bytes)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
