"""Toxicity by averaged subword embeddings and a linear softmax.

The features of a text are its words and their character n-grams of 3 to 5 bytes (with the word's ends), hashed to
buckets, so an unseen misspelling shares most features with the word it is made from. Each bucket has an embedding; a
passage of a few words is the mean of its features' embeddings, and a linear softmax over it gives the label. A text is
as toxic as its most toxic passage: a mean over a long text would drown a few words. Embeddings and softmax are trained
jointly, in numpy, by Adagrad on a bounded sample of labelled rows, first with whole texts, then with the highest
passage of each. As the model is linear in the mean, scoring needs one number a bucket: the task that scores a document
sums and divides, and nothing is shuffled.

Learned from are rows of ``labels`` whose crc32(doc_id) modulo 5 is not 0: those with the smallest hash of doc_id, at
most ``SAMPLE_ROWS`` of them and ``SAMPLE_BYTES`` of text; a text that does not fit is passed over. A doc_id labelled twice counts with its highest label; null
labels are left out. A null or empty text has no features and gets the score of the bias alone. Without labels every
score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, constants, flat, hashes, held_out, pieces, spans

SAMPLE_ROWS = 8000
SAMPLE_BYTES = 16 << 20
BITS = 20
#: A feature of fewer texts of the sample than this is not learned, so that no text is learned by heart.
LEAST_TEXTS = 20
DIM = 8
EPOCHS = 12
BATCH = 128
BLOCK = 512
RATE = 0.5
DECAY = 1e-4
#: Words of a passage, and epochs over whole texts before those over passages.
PASSAGE = 8
WHOLE_EPOCHS = 3

_TABLES = constants(41, 5 * 256).astype(np.uint32).reshape(5, 256)
_SPREAD = np.uint32(0x9E3779B1)


def features(column: pa.Array, bits: int = BITS, size: int = PASSAGE) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """[(bucket, passage of it)] for each kind of feature, and for each text its first passage (one more at the end).

    A text of n words is cut into the least number of passages of at most ``size`` words, as even as can be; one without
    words is one passage.
    """
    column = pc.binary_join_element_wise(pa.scalar(b""), column.cast(pa.binary()).fill_null(b""), pa.scalar(b""), b" ")
    data, offsets = flat(column)
    data = LOWER[data]
    inside = NOT_SPACE[data]
    data[~inside] = 32
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    n = np.diff(first)
    cuts = np.maximum(1, -(-n // size))
    head = np.concatenate([[0], np.cumsum(cuts)])
    owner = np.repeat(np.arange(len(n)), cuts)
    word = first[owner] + (np.arange(head[-1]) - head[owner]) * n[owner] // cuts[owner]
    bounds = np.append(np.where(word == first[owner], offsets[owner], starts[np.minimum(word, len(starts) - 1)] if len(starts) else 0), offsets[-1])
    out = [((hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(bounds, starts, "right") - 1)]
    passage = np.repeat(np.arange(head[-1], dtype=np.int32), np.diff(bounds))
    total, middle = _TABLES[0][data], None
    for k in range(2, 6):
        m = len(data) - k + 1
        if m <= 0:
            break
        total = total[:m] + _TABLES[k - 1][data[k - 1 :]]
        if k >= 3:  # all but the first and the last byte are of a word, and one of these too
            middle = inside[1 : 1 + m] if k == 3 else middle[:m] & inside[k - 2 : k - 2 + m]
            at = np.flatnonzero(middle & (inside[:m] | inside[k - 1 :]))
            out.append((((total[at] * _SPREAD) >> np.uint32(32 - bits)).astype(np.int64), passage[at]))
    return out, head


def shares(bucket: np.ndarray, text: np.ndarray, n: int, bits: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each of ``n`` texts, their shares among its features, and where each text begins."""
    keys, times = np.unique((text.astype(np.int64) << bits) | bucket, return_counts=True)
    owner, bucket = keys >> bits, keys & ((1 << bits) - 1)
    share = (times / np.maximum(1, np.bincount(owner, times, n))[owner]).astype(np.float32)
    if seen is not None:
        owner, bucket, share = (x[seen[bucket]] for x in (owner, bucket, share))
    return bucket.astype(np.int32), share, np.searchsorted(owner, np.arange(n + 1))


class Model:
    """``weight``: what each bucket adds to the log-odds; ``bias``: the log-odds of a passage without features."""

    def __init__(self, weight: np.ndarray, bias: float, bits: int = BITS):
        self.weight, self.bias, self.bits = weight, bias, bits

    @classmethod
    def train(cls, texts: list[str], labels: list[int], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, least_texts: int = LEAST_TEXTS, seed: int = 7) -> Model:
        """Whole texts first; then of each text the passage that scores highest, with the text's label."""
        if not texts:
            return cls(np.zeros(1 << bits, np.float32), -np.inf, bits)
        y = np.asarray(labels)
        blocks = [slice(at, at + BLOCK) for at in range(0, len(texts), BLOCK)]
        columns = [pa.array(texts[b], pa.string()) for b in blocks]
        whole = [cls._whole(c, bits) for c in columns]
        often = np.zeros(1 << bits, np.int32)
        for bucket, _, _ in whole:
            often += np.bincount(bucket, minlength=1 << bits).astype(np.int32)
        seen = often >= min(least_texts, max(2, len(texts) // 50))
        trainer = _Trainer(bits, dim, y, seen, seed)
        for epoch in range(epochs):
            model = cls(trainer.weight(), 0.0, bits)
            for i in trainer.random.permutation(len(blocks)):
                trainer.fit(model._best(columns[i], seen) if epoch >= WHOLE_EPOCHS else cls._known(whole[i], seen), y[blocks[i]])
        return cls(trainer.weight(), float(trainer.bias[1] - trainer.bias[0]), bits)

    @staticmethod
    def _whole(column: pa.Array, bits: int) -> tuple:
        kinds, head = features(column, bits, 1 << 40)
        return shares(np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds]), len(head) - 1, bits)

    @staticmethod
    def _known(rows: tuple, seen: np.ndarray) -> tuple:
        bucket, share, cut = rows
        held = seen[bucket]
        return bucket[held], share[held], np.concatenate([[0], np.cumsum(held)])[cut]

    def _best(self, column: pa.Array, seen: np.ndarray) -> tuple:
        """The features of each text's highest passage."""
        kinds, head = features(column, self.bits)
        score = self._passages(kinds, head)
        text = np.repeat(np.arange(len(head) - 1), np.diff(head))
        best = np.lexsort((score, text))[head[1:] - 1]
        held = np.isin(np.arange(head[-1]), best)
        picked = [(b[held[p]], text[p[held[p]]]) for b, p in kinds]
        return shares(np.concatenate([x[0] for x in picked]), np.concatenate([x[1] for x in picked]), len(head) - 1, self.bits, seen)

    def _passages(self, kinds: list, head: np.ndarray) -> np.ndarray:
        total, size = np.zeros(head[-1]), np.zeros(head[-1])
        for bucket, passage in kinds:
            total += np.bincount(passage, self.weight[bucket], head[-1])
            size += np.bincount(passage, minlength=head[-1])
        return total / np.maximum(size, 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Of each text the probability of its highest passage."""
        if not len(column):
            return np.empty(0)
        kinds, head = features(column, self.bits)
        logit = np.maximum.reduceat(self._passages(kinds, head), head[:-1]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


class _Trainer:
    """Embeddings and softmax, trained together by Adagrad with weight decay."""

    def __init__(self, bits: int, dim: int, y: np.ndarray, seen: np.ndarray, seed: int):
        self.random = np.random.Generator(np.random.PCG64(seed))
        self.embed = self.random.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
        self.embed[~seen] = 0
        self.out = self.random.normal(0, 0.1, (dim, 2)).astype(np.float32)
        self.bias = np.log(np.bincount(y, minlength=2) + 1.0).astype(np.float32)
        self.g_embed, self.g_out, self.g_bias = np.full(1 << bits, 1e-8, np.float32), np.full((dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)

    def weight(self) -> np.ndarray:
        return (self.embed @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)

    def fit(self, rows: tuple, labels: np.ndarray) -> None:
        bucket, share, cut = rows
        order = self.random.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = cut[batch + 1] - cut[batch]
            entry = np.repeat(cut[batch], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            used, place = np.unique(bucket[entry], return_inverse=True)
            self._step(np.repeat(np.arange(len(batch)), sizes), used, place, share[entry], np.eye(2, dtype=np.float32)[labels[batch]])

    def _step(self, owner, used, place, share, y) -> None:
        mine, dim = self.embed[used], self.embed.shape[1]
        mean = np.stack([np.bincount(owner, share * mine[place, k], len(y)) for k in range(dim)], axis=1).astype(np.float32)
        logits = mean @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True) - y
        back = g @ self.out.T
        g_out, g_bias = mean.T @ g + DECAY * self.out, g.sum(axis=0)
        g_embed = np.stack([np.bincount(place, share * back[owner, k], len(used)) for k in range(dim)], axis=1).astype(np.float32) + DECAY * mine
        self.g_out += g_out**2
        self.g_bias += g_bias**2
        self.g_embed[used] += (g_embed**2).mean(axis=1)
        self.out -= RATE * g_out / np.sqrt(self.g_out)
        self.bias -= RATE * g_bias / np.sqrt(self.g_bias)
        self.embed[used] = mine - RATE * g_embed / np.sqrt(self.g_embed[used])[:, None]


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels to learn from: a bounded number of rows and bytes, the smallest hashes of doc_id first."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__label"))
    picked = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("__size")).filter(F.col("__size") <= most).join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "__size").limit(rows).collect()
    used, ids, sizes = 0, {}, set()
    for row in picked:  # what does not fit is passed over
        if used + row["__size"] <= most:
            used += row["__size"]
            ids[row.doc_id] = row["__label"]
            sizes.add((row.doc_id, row["__size"]))
    if not ids:
        return [], []
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sorted(sizes), "doc_id long, __size int")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__size", F.octet_length("text"))
    # one text for each pair of an id and a size, however often a doc_id repeats, so at most ``rows`` of them
    found = texts.join(F.broadcast(wanted), ["doc_id", "__size"]).groupBy("doc_id", "__size").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in found], [ids[r.doc_id] for r in found]


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        scores = model.scores(batch.column("text"))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "held_out": batch.column("held_out"),
            "score": pa.array(scores),
            "predicted": pa.array((scores >= 0.5).astype(np.int32)),
        })


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(Model.train(*sample(docs, labels)))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda b: _score(b, model.value), "doc_id long, held_out boolean, score double, predicted int")
