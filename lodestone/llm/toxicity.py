"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its prefixes. Filters of several widths slide over
the words; max pooling keeps each filter's strongest place; a linear layer gives a logit. Training is stochastic gradient
descent with Adagrad on a bounded sample of labelled rows; the first embedding dimension starts from the log-odds of a
bucket's labels, so pooling finds telling words at once. For scoring, embeddings times filters are one table: a word
costs one row look-up, a position a few additions.

The language is read off function words of the text itself (never the lang column); on a part of the sample kept aside, each
language's logits get their own scale and threshold, so that a score of THRESHOLD means the same in each.

Defined results: null or empty text is scored like a text without words; texts of any length are scored whole; rows
without a label are never trained on; without labels of both kinds every score is 0; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held, kept_rows, slices, texts_of
from lodestone.llm.word_rows import WordRows, bounded_sample, bounded_texts

#: Labelled documents that the model is fitted on, at most (about); their characters are bounded too (word_rows).
SAMPLE = 6000
BUCKETS = 1 << 16
PREFIXES = (3, 4, 5, 6)
DIMENSIONS = 8
#: (width, filters)
FILTERS = ((1, 8), (2, 6), (3, 6))
TAPS = sum(w * f for w, f in FILTERS)
POOLED = sum(f for _, f in FILTERS)
EPOCHS, BATCH, RATE, DECAY = 3, 64, 0.05, 1e-5
THRESHOLD = 0.3
#: Labelled rows kept aside, five of each kind among them, that a calibration rests on at least; a language with fewer takes
#: that of all languages, and with fewer of all logits stay as they are.
ENOUGH = 50
SEED = 7
#: Words that are scored together.
TOGETHER = 50_000

#: Common function words, to read a text's language off.
FUNCTION_WORDS = {
    "de": "der die und das von mit den nicht ist ein eine des dem zu sich auf als auch".split(),
    "en": "the of and to that is with for was are this have from not it be they".split(),
    "es": "el los las que del por con una para su como se al más pero sus".split(),
    "fr": "le les des est dans pour qui une pas sur plus avec et du au ce".split(),
}
LANGUAGES = ["", *FUNCTION_WORDS]
PLAIN = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    return word.lower() if word.isalpha() else PLAIN.sub("", word).lower()


def bucket_ids(words: list[str]) -> np.ndarray:
    """Buckets of each word: of the whole, then of its prefixes (of a shorter word, itself once more)."""
    out = np.empty((len(words), 1 + len(PREFIXES)), np.int64)
    for i, w in enumerate(words):
        p = plain(w)
        out[i, 0] = zlib.crc32(p.encode())
        for k, n in enumerate(PREFIXES, 1):
            out[i, k] = zlib.crc32(f"{n}^{p[:n]}".encode())
    return out % BUCKETS


def _languages(words: list[str]) -> np.ndarray:
    own = {w: k for k, names in enumerate(FUNCTION_WORDS.values(), 1) for w in names}
    out = np.zeros((len(words), len(LANGUAGES)), np.float32)
    for i, w in enumerate(words):
        if k := own.get(plain(w)):
            out[i, k] = 1
    return out


def _split(x: np.ndarray) -> list[np.ndarray]:
    """Columns of each filter width, as (..., width, filters)."""
    out, at = [], 0
    for w, f in FILTERS:
        out.append(x[..., at : at + w * f].reshape(*x.shape[:-1], w, f))
        at += w * f
    return out


def responses(taps: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(pooled, filter responses by width, first rows): taps are the words' rows, each document followed by two zero rows."""
    starts = np.cumsum(lengths + 2) - lengths - 2
    cuts = np.stack([starts, starts + lengths], 1).reshape(-1)
    every, pooled = [], []
    for part in _split(taps):
        width = part.shape[1]
        z = part[: len(taps) - 2, 0].copy()
        for t in range(1, width):
            z += part[t : len(taps) - 2 + t, t]
        z = np.concatenate([z, np.zeros((2, z.shape[1]), z.dtype)])
        every.append(z)
        pooled.append(np.maximum.reduceat(z, cuts, axis=0)[::2])
    return np.concatenate(pooled, axis=1), every, starts


def _padded(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers with two zeros behind each document; an empty document is one zero row."""
    lengths = np.array([max(1, len(n)) for n in numbers])
    out = np.zeros(int((lengths + 2).sum()), np.int64)
    at = 0
    for n, size in zip(numbers, lengths.tolist()):
        out[at : at + len(n)] = n
        at += size + 2
    return out, lengths


class Model:
    def __init__(self, embedding: np.ndarray, filters: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.embedding, self.filters, self.bias, self.weights, self.offset = embedding, filters, bias, weights, offset
        self.scales = {lang: (1.0, 0.0) for lang in LANGUAGES}

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset

    def scores(self, logits: np.ndarray, langs: list[str]) -> np.ndarray:
        a, b = np.array([self.scales[g] for g in langs]).reshape(-1, 2).T
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))


def _language(counts: np.ndarray) -> list[str]:
    return [LANGUAGES[int(k)] if c > 0 else "" for k, c in zip(counts.argmax(axis=1), counts.max(axis=1))]


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """None without labels of both kinds."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    lists = [t.split() for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*lists)), 1)}
    ids = np.zeros((len(vocabulary) + 1, 1 + len(PREFIXES)), np.int64)
    ids[1:] = bucket_ids(list(vocabulary))
    speaks = np.concatenate([np.zeros((1, len(LANGUAGES)), np.float32), _languages(list(vocabulary))])
    docs = [np.array([vocabulary[w] for w in words], np.int64) for words in lists]
    langs = _language(np.array([speaks[d].sum(axis=0) for d in docs]))
    order = rng.permutation(len(docs))
    aside, used = order[: len(docs) // 5], order[len(docs) // 5 :]
    if len(set(y[used])) < 2:
        aside, used = order, order

    # log-odds of documents with a bucket, of those that support says something about
    counts = np.zeros((2, BUCKETS))
    for d in used:
        counts[int(y[d]), np.unique(ids[np.unique(docs[d])])] += 1
    n0, n1 = (y[used] == 0).sum(), (y[used] == 1).sum()
    odds = np.log((counts[1] + 0.2) / (n1 + 0.4)) - np.log((counts[0] + 0.2) / (n0 + 0.4))
    odds = np.where(counts[1] >= 3, np.clip(odds, -3, 4), 0)
    e = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    e[:, 0] = np.maximum(odds, 0)
    w = rng.normal(0, 0.2, (DIMENSIONS, TAPS)).astype(np.float32)
    at = 0
    for width, f in FILTERS:  # the first filter of each width reads the log-odds
        w[0, at : at + width * f : f] = 1.0 / width
        at += width * f
    model = Model(e, w, np.zeros(POOLED, np.float32), np.full(POOLED, 0.02, np.float32), float(np.log((n1 + 1) / (n0 + 1))))
    sums = [np.full_like(x, 1e-3) for x in (e, w, model.bias, model.weights)]
    sum_offset = 1e-3
    firsts = np.cumsum([0] + [f for _, f in FILTERS])

    def step(x, g, s, index=...):
        s[index] += g * g
        x[index] -= RATE * g / np.sqrt(s[index])

    for _ in range(EPOCHS):
        dealt = rng.permutation(used)
        for at in range(0, len(dealt), BATCH):
            some = dealt[at : at + BATCH]
            rows, lengths = _padded([docs[d] for d in some])
            own, back_to = np.unique(rows, return_inverse=True)
            vectors = model.embedding[ids[own]].sum(axis=1)
            vectors[own == 0] = 0
            pooled, every, starts = responses((vectors @ model.filters)[back_to], lengths)
            active = pooled + model.bias
            logit = np.maximum(active, 0) @ model.weights + model.offset
            g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) / len(some)).astype(np.float32)
            back = g[:, None] * model.weights * (active > 0)
            g_filters, g_vectors, touched = np.zeros_like(model.filters), [], []
            column = 0
            for k, (width, f) in enumerate(FILTERS):
                z = every[k]
                best = np.stack([s + z[s : s + n].argmax(axis=0) for s, n in zip(starts.tolist(), lengths.tolist())])
                gz = back[:, firsts[k] : firsts[k + 1]]
                for t in range(width):
                    cols = np.arange(column + t * f, column + (t + 1) * f)
                    place = best + t
                    g_filters[:, cols] += np.einsum("bf,bfd->df", gz, vectors[back_to[place]])
                    g_vectors.append((gz[:, :, None] * model.filters[:, cols].T[None]).reshape(-1, DIMENSIONS))
                    touched.append(place.reshape(-1))
                column += width * f
            place, gv = np.concatenate(touched), np.concatenate(g_vectors)
            live = rows[place] != 0
            target = ids[rows[place[live]]].reshape(-1)
            index, inverse = np.unique(target, return_inverse=True)
            ge = np.zeros((len(index), DIMENSIONS), np.float32)
            np.add.at(ge, inverse, np.repeat(gv[live], 1 + len(PREFIXES), axis=0))
            step(model.weights, np.maximum(active, 0).T @ g + DECAY * model.weights, sums[3])
            step(model.filters, g_filters + DECAY * model.filters, sums[1])
            step(model.bias, back.sum(axis=0), sums[2])
            step(model.embedding, ge, sums[0], index)
            sum_offset += float(g.sum()) ** 2
            model.offset -= RATE * float(g.sum()) / np.sqrt(sum_offset)

    logit = np.zeros(len(docs))
    for at in range(0, len(aside), BATCH):
        some = aside[at : at + BATCH]
        rows, lengths = _padded([docs[d] for d in some])
        vectors = model.embedding[ids[rows]].sum(axis=1)
        vectors[rows == 0] = 0
        logit[some] = model.logits(responses(vectors @ model.filters, lengths)[0])
    scaled = lambda own, start: _calibrate(logit[own], y[own], start) if len(own) >= ENOUGH and 5 <= y[own].sum() <= len(own) - 5 else start
    every_scale = scaled(aside, (1.0, 0.0))
    for lang in LANGUAGES:
        model.scales[lang] = scaled(np.array([d for d in aside if langs[d] == lang], np.int64), every_scale)
    return model


def _calibrate(logits: np.ndarray, y: np.ndarray, start: tuple[float, float]) -> tuple[float, float]:
    """(scale, shift) such that sigmoid(scale * logit + shift) is near the labels, and THRESHOLD is where most are right."""
    a, b = start
    for _ in range(50):  # Newton steps with a pull to the start
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        d, r = p * (1 - p), p - y
        h = np.array([[(d * logits**2).sum() + 1, (d * logits).sum()], [(d * logits).sum(), d.sum() + 1]])
        g = np.array([(r * logits).sum() + (a - start[0]), r.sum() + (b - start[1])])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    a = max(float(a), 0.05)
    order = np.argsort(logits, kind="stable")
    x, right = logits[order], y[order]
    gain = np.concatenate([[right.sum()], right.sum() - np.cumsum(right)])  # toxic ones above each cut
    flagged = len(x) - np.arange(len(x) + 1)
    f1 = 2 * gain / np.maximum(flagged + right.sum(), 1)
    at = int(f1.argmax())
    cut = (x[at - 1] + x[at]) / 2 if 0 < at < len(x) else x[0] - 1 if at == 0 else x[-1] + 1
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * cut)


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, sample: int = SAMPLE) -> Model | None:
    """The model of docs(doc_id, text) and labels(doc_id, toxic): a bounded sample outside the held-out remainder of 4."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != held_out)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    chosen = bounded_sample(marked, sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    found = bounded_texts(texts.join(F.broadcast(chosen), "doc_id"))  # about sample rows of labels
    return fit([r["text"] for r in found], [r["toxic"] for r in found])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.table = model.embedding.astype(np.float32) @ model.filters
        self.words = WordRows(self._rows, TAPS + len(LANGUAGES), 200_000)

    def _rows(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.table[bucket_ids(words)].sum(axis=1), _languages(words)], axis=1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        numbers = self.words([t.split() for t in texts])
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):  # some tens of thousands of words at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(numbers[end]) <= TOGETHER):
                size += len(numbers[end])
                end += 1
            rows, lengths = _padded(numbers[at:end])
            taps = self.words.rows[rows]
            pooled, _, starts = responses(taps[:, :TAPS], lengths)
            langs = _language(np.add.reduceat(taps[:, TAPS:], starts, axis=0))
            out[at:end] = self.model.scores(self.model.logits(pooled), langs)
            at = end
        return out


def _scorer(model: Model) -> Scorer:
    return held(("toxicity", zlib.crc32(model.filters.tobytes(), zlib.crc32(model.weights.tobytes()))), lambda: Scorer(model))


def _small(model: Model) -> Model:
    """The model as it goes to the workers."""
    model.embedding = model.embedding.astype(np.float16)
    return model


def not_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose predicted is 0, with all their columns."""
    if model is None:
        return docs
    model = _small(model)
    return kept_rows(docs, lambda texts: _scorer(model)(texts) < THRESHOLD)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted."""
    if model is not None:
        model = _small(model)

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch)
            s = _scorer(model)(texts) if model is not None else np.zeros(len(texts))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), aside, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
