"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters. A word's features are its prefixes and suffixes of 1 to 3 bytes, its 2- and 3-grams with the
word's ends, and the word itself where the sample holds it in ``LEXICON`` texts or more; each is hashed to a bucket with
a weight for each language. Transitions between the languages of neighbouring words are learned too, so a word that says
little takes the language of its neighbours and a text in several languages is labelled in runs. Marginals come from
forward-backward. Chains are passages of at most ``CHAIN`` words, cut evenly. A document's language is the one with most
marginal weight, each word counting by its bytes; its share is the score.

The field is trained in numpy, by Adagrad on the exact gradient of the conditional likelihood, on a bounded sample of
the rows with a language whose crc32(doc_id) modulo 5 is not 0: of each language rows with the smallest hashes of doc_id,
texts up to an equal share of ``SAMPLE_BYTES``, and ``SAMPLE_ROWS`` in all; of a language whose texts are all larger
than its share, pieces from all over one text. There are ``CELLS`` weights, shared
evenly by the languages, so a field is of one size whatever their number. Labels are those of the documents; so that
transitions are learned, some of the passages take the second half of another one. Every language is learned, unless
there are more of them than rows; then those whose first rows have the least hashes are.

Defined cases: a text that is null or has no letter is ``und`` with score 0. With no row to learn from every text is
``und``. Rows with one doc_id are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, byte_class, constants, flat, hashes, held_out, pieces, spans

SAMPLE_BYTES = 3 << 20
SAMPLE_ROWS = 2000
#: Weights of all features and languages together; each feature has a bucket of weights, one for each language.
CELLS = 1 << 21
BITS = 19
#: Parts of a language of which each gives its first rows.
SLICES = 64
CHAIN = 64
EPOCHS = 6
BATCH = 64
RATE = 0.3
DECAY = 1e-4
SWITCHED = 0.3
LEXICON = 3

LETTERS = byte_class(bytes(b for b in range(128) if not chr(b).isalpha()))
_TABLES = constants(51, 3 * 256).astype(np.uint32).reshape(3, 256)
_KINDS = constants(52, 16).astype(np.uint32)


class Words:
    """The words of a column of texts: where they are, and their features as (bucket, word)."""

    def __init__(self, column: pa.Array, bits: int = BITS):
        column = pc.binary_join_element_wise(pa.scalar(b""), column.cast(pa.binary()).fill_null(b""), pa.scalar(b""), b" ")
        data, offsets = flat(column)
        data = LOWER[data]
        starts, ends, self.first = spans(data, offsets, LETTERS)
        self.sizes, n = ends - starts, len(starts)
        self.hash = hashes(data, starts, ends)
        shift = np.uint32(32 - bits)
        put = lambda total, kind: ((total * _KINDS[kind]) >> shift).astype(np.int32)
        word = np.arange(n, dtype=np.int32)
        self.features: list[tuple[np.ndarray, np.ndarray]] = []
        for size in (1, 2, 3):
            long = np.flatnonzero(self.sizes >= size)
            total = sum(_TABLES[k][data[starts[long] + k]] for k in range(size)) if len(long) else np.empty(0, np.uint32)
            self.features.append((put(total, size), word[long]))
            total = sum(_TABLES[k][data[ends[long] - size + k]] for k in range(size)) if len(long) else np.empty(0, np.uint32)
            self.features.append((put(total, 3 + size), word[long]))
        data[~LETTERS[data]] = 32
        for size in (2, 3):
            # from the byte before the word to its last byte but ``size`` - 2, so the ends take part
            lengths = self.sizes + 3 - size
            at = np.repeat(starts - 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            total = sum(_TABLES[k][data[at + k]] for k in range(size)) if n else np.empty(0, np.uint32)
            self.features.append((put(total, 6 + size), np.repeat(word, lengths)))
        self.lexicon = (self.hash >> np.uint64(64 - bits)).astype(np.int32)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """A table (place, chain) of words, -1 where a chain is over; and each chain's text."""
        n = np.diff(self.first)
        cuts = -(-n // CHAIN)
        text = np.repeat(np.arange(len(n)), cuts)
        part = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = self.first[:-1][text] + part * n[text] // cuts[text]
        end = self.first[:-1][text] + (part + 1) * n[text] // cuts[text]
        table = begin[None, :] + np.arange(CHAIN)[:, None]
        return np.where(table < end[None, :], table, -1), text


def marginals(emission: np.ndarray, steps: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    ``emission``: (words, labels) scores; ``steps``: the table of ``Words.chains``. Gives the words' marginals and the
    expected number of moves between labels.
    """
    n_labels = emission.shape[1]
    inner = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
    move = np.exp(moves)
    size = int((steps >= 0).any(axis=1).sum())
    alive = steps >= 0
    forward = np.zeros((size, steps.shape[1], n_labels))
    state = np.exp(start)[None, :]
    for t in range(size):
        held = alive[t][:, None]
        now = (state if t == 0 else forward[t - 1] @ move) * inner[np.maximum(steps[t], 0)]
        forward[t] = np.where(held, now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300), 0)
    out, pairs = np.zeros(emission.shape), np.zeros((n_labels, n_labels))
    back = np.ones((steps.shape[1], n_labels))
    for t in range(size - 1, -1, -1):
        held = alive[t]
        both = forward[t] * back
        both /= np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
        out[steps[t][held]] = both[held]
        if t:
            ahead = inner[np.maximum(steps[t], 0)] * back
            weight = np.maximum(((forward[t - 1] @ move) * ahead).sum(axis=1, keepdims=True), 1e-300)
            pairs += np.where(held[:, None], forward[t - 1] / weight, 0).T @ np.where(held[:, None], ahead, 0) * move
            before = ahead @ move.T
            back = np.where(held[:, None], before / np.maximum(before.sum(axis=1, keepdims=True), 1e-300), 1.0)
    return out, pairs


class Field:
    """The weights: (bucket, label) for features and for the lexicon, and the transitions."""

    def __init__(self, labels: list[str], bits: int = BITS):
        n = len(labels)
        self.labels, self.bits = labels, bits
        self.weight, self.lexicon = np.zeros((1 << bits, n), np.float32), np.zeros((1 << bits, n), np.float32)
        self.start, self.moves = np.zeros(n), np.zeros((n, n))

    def emission(self, words: Words) -> np.ndarray:
        out = self.lexicon[words.lexicon].astype(np.float64)
        for label in range(len(self.labels)):
            column = np.ascontiguousarray(self.weight[:, label])
            for bucket, word in words.features:
                out[:, label] += np.bincount(word, column[bucket], len(out))
        return out

    @classmethod
    def train(cls, texts: list[str], langs: list[str], cells: int = CELLS, epochs: int = EPOCHS, seed: int = 5) -> Field:
        bits = max(8, (cells // max(1, len(set(langs)))).bit_length() - 1)
        field = cls(sorted(set(langs)), bits)
        if not texts:
            return field
        random = np.random.Generator(np.random.PCG64(seed))
        order = random.permutation(len(texts))
        truth = np.searchsorted(field.labels, np.asarray(langs)[order])
        blocks = []
        often = np.zeros(1 << bits, np.int32)
        for at in range(0, len(order), BATCH):
            words = Words(pa.array([texts[i] for i in order[at : at + BATCH]], pa.string()), bits)
            label = np.repeat(truth[at : at + BATCH], np.diff(words.first))
            keys = np.unique(np.stack([np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)), words.lexicon]), axis=1)
            often += np.bincount(keys[1], minlength=1 << bits).astype(np.int32)
            blocks.append((words, label))
        common = often >= LEXICON
        g_weight, g_lexicon, g_moves, g_start = (np.full(x.shape, 1e-6, x.dtype) for x in (field.weight, field.lexicon, field.moves, field.start))
        for _ in range(epochs):
            for b in random.permutation(len(blocks)):
                words, label = blocks[b]
                steps, _ = words.chains()
                if not steps.shape[1]:
                    continue
                mixed = np.flatnonzero(random.random(steps.shape[1]) < SWITCHED)
                steps[CHAIN // 2 :, mixed] = steps[CHAIN // 2 :, random.permutation(mixed)]
                ended = (steps[CHAIN // 2 - 1] < 0)[None, :]
                steps[CHAIN // 2 :] = np.where(ended, -1, steps[CHAIN // 2 :])
                used = np.unique(steps[steps >= 0])
                soft, pairs = marginals(field.emission(words), steps, field.start, field.moves)
                g = np.zeros_like(soft)
                g[used] = soft[used]
                g[used, label[used]] -= 1
                n = max(1, len(used))
                first = steps[0]
                s = soft[first].sum(axis=0) - np.bincount(label[first], minlength=len(field.labels))
                a, z = steps[:-1], steps[1:]
                held = (a >= 0) & (z >= 0)
                seen = np.bincount(label[a[held]] * len(field.labels) + label[z[held]], minlength=pairs.size).reshape(pairs.shape)
                for value, grad, total in ((field.moves, (pairs - seen) / n, g_moves), (field.start, s / n, g_start)):
                    grad = grad + DECAY * value
                    total += grad**2
                    value -= RATE * grad / np.sqrt(total)
                for k in range(len(field.labels)):
                    grad = np.zeros(1 << bits)
                    for bucket, word in words.features:
                        grad = grad + np.bincount(bucket, g[word, k], 1 << bits) / n
                    _step(field.weight, g_weight, k, grad)
                    _step(field.lexicon, g_lexicon, k, np.where(common, np.bincount(words.lexicon, g[:, k], 1 << bits) / n, 0))
        return field

    def labelled(self, words: Words) -> np.ndarray:
        steps, _ = words.chains()
        return marginals(self.emission(words), steps, self.start, self.moves)[0]


def _step(value: np.ndarray, total: np.ndarray, k: int, grad: np.ndarray) -> None:
    at = np.flatnonzero(grad)
    grad = grad[at] + DECAY * 1e-2 * value[at, k]
    total[at, k] += grad**2
    value[at, k] -= RATE * grad / np.sqrt(total[at, k])


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: at most ``rows`` texts of ``most`` bytes in all.

    Each language has an equal share of the bytes and is read in the order of a hash of doc_id as far as its share goes.
    Texts larger than the share come last and cost it whole, so one is taken only where no other is, by pieces from all
    over it. The first text of each language comes before the second of any, up to ``rows``. All is chosen in Spark: by
    narrow rows, within slices of a language and then of what these leave, so that no task reads a whole language; only
    what is chosen reaches the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.select("lang").distinct().count()
    share = most // max(1, min(n, rows))
    size, mark = F.octet_length("text"), F.xxhash64("text")
    narrow = known.filter(size > 0).groupBy("lang", "doc_id").agg(F.min(F.struct(size.alias("size"), mark.alias("mark"))).alias("m"))  # an id may be in many rows
    narrow = narrow.select("lang", "doc_id", "m.*", F.xxhash64("doc_id").alias("place"))
    narrow = narrow.withColumn("large", F.col("size") > share)
    order = ("large", "place", "doc_id")
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= rows)
    slices = first(narrow.withColumn("slice", F.pmod("place", F.lit(SLICES))), "lang", "slice").drop("slice", "rank")
    ranked = first(slices, "lang").withColumn("used", F.sum(F.least("size", F.lit(share))).over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    wanted = ranked.filter(F.col("used") <= share).orderBy("rank", *order).limit(rows).select("doc_id", "lang", "mark")
    pieces_ = max(1, min(64, share // 256))
    width = max(1, share // 4 // pieces_)  # a character has four bytes at most
    step = F.floor(F.length("text") / pieces_)
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces_ - 1)), lambda i: F.substr("text", (i * step + 1).cast("int"), F.lit(width))), " ")
    texts = known.select("doc_id", F.when(size > share, spread).otherwise(F.col("text")).alias("text"), "lang", mark.alias("mark"))
    found = texts.join(F.broadcast(wanted), ["doc_id", "lang", "mark"]).dropDuplicates(["doc_id", "lang"]).select("doc_id", "text", "lang").collect()  # at most ``rows``
    found.sort(key=lambda r: (r.doc_id, r.lang))
    return [r.text for r in found], [r.lang for r in found]


def _most(field: Field) -> int:
    return max(1 << 14, CHUNK_BYTES * 8 // max(8, len(field.labels)))


def _predict(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=_most(field)):
        words = Words(batch.column("text"), field.bits)
        n = batch.num_rows
        best, score = np.zeros(n, np.int64), np.zeros(n)
        if field.labels and len(words.sizes):
            text = np.repeat(np.arange(n), np.diff(words.first))
            soft = field.labelled(words) * words.sizes[:, None]
            total = np.stack([np.bincount(text, soft[:, k], n) for k in range(len(field.labels))], axis=1)
            best = total.argmax(axis=1)
            score = total.max(axis=1) / np.maximum(total.sum(axis=1), 1e-300)
        known = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool) & (np.diff(words.first) > 0) & bool(field.labels)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "held_out": batch.column("held_out"),
            "lang_pred": pa.array([field.labels[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
            "score": pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
        })


def _runs(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=_most(field)):
        words = Words(batch.column("text"), field.bits)
        if not field.labels or not len(words.sizes):
            continue
        soft = field.labelled(words)
        best, text = soft.argmax(axis=1), np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        head = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
        tail = np.append(head[1:], len(best))
        score = np.add.reduceat(soft.max(axis=1), head) / (tail - head)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(text[head])),
            "first_word": pa.array(head - words.first[text[head]]),
            "n_words": pa.array(tail - head),
            "lang": pa.array([field.labels[b] for b in best[head]], pa.string()),
            "score": pa.array(score),
        })


def fit(docs: DataFrame):
    """A broadcast field, trained on a bounded sample of ``docs`` (doc_id, text, lang)."""
    return docs.sparkSession.sparkContext.broadcast(Field.train(*sample(docs.select("doc_id", "text", "lang"))))


def language_runs(docs: DataFrame, field=None) -> DataFrame:
    """(doc_id, first_word, n_words, lang, score): the runs of words of one language of every document."""
    field = field or fit(docs)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _runs(b, field.value), "doc_id long, first_word long, n_words long, lang string, score double")


def language_id(docs: DataFrame, field=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    field = field or fit(docs)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letter.alias("has_letter"), "text")
    return rows.mapInArrow(lambda b: _predict(b, field.value), "doc_id long, held_out boolean, lang_pred string, score double")
