"""Language identification with spans of mixed-language text.

Words are scored per language by byte n-grams with naive Bayes; the ranges of their letters' script first narrow the
candidates to languages seen in that script. Viterbi over the words, with a penalty for each switch, labels spans; the
document's language is the one with most letters, its score that share. Viterbi runs on all documents of a batch at once,
in chunks: each chunk's best path from every state to every state, then chunk after chunk, then back.

Defined results: null text and text without letters are `und` with score 0; texts of any length are read whole; equal
shares go to the first language in alphabetical order; without any labelled document every prediction is `und`; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
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
SAMPLE = 4000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: A word's scores are held within this of its best language; switching costs as much as PENALTY.
SPREAD, PENALTY = 8.0, 20.0
#: A language is determined if its words' log-likelihood is so far above that of the next one: 20 to 1.
MARGIN = 3.0
CHUNK = 64
UNDETERMINED = "und"

#: First code points of the ranges of scripts; a range ends where the next starts.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0x20000, "han"), (0x32000, "other")]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
OF_RANGE = np.array([NAMES.index(n) for _, n in SCRIPTS])
LETTERS = re.compile(r"[\W\d_]+")


def letters_of(word: str) -> str:
    if not word.isalpha():
        word = LETTERS.sub("", word)
        if word and not word.isalpha():  # some numbers count as characters of words
            word = "".join(c for c in word if c.isalpha())
    return word.lower()


def script_of(word: str) -> int:
    """The script of most of its letters; the first in order of NAMES at a tie."""
    if word.isascii() or max(word) < "Ͱ":
        return NAMES.index("latin")
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4")
    return int(np.bincount(OF_RANGE[np.searchsorted(STARTS, codes, "right") - 1], minlength=len(NAMES)).argmax())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word's number) of every byte n-gram of each order in the words with their edges marked."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    buckets, owners = [], []
    h = np.zeros(data.size, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: data.size - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            whole = owner[: h.size] == owner[n - 1 :]
            mixed = h[whole] * np.uint32(2654435761)
            buckets.append((mixed >> np.uint32(16)).astype(np.int64))
            owners.append(owner[: h.size][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def fit(texts: list[str], langs: list[str]) -> dict:
    """Languages, log-probabilities of n-grams by language, and which languages occur in which script."""
    names = sorted(set(langs))
    counts = np.zeros((len(names), BUCKETS))
    scripts = np.zeros((len(names), len(NAMES)))
    for k, name in enumerate(names):
        seen: dict[str, int] = {}
        for text, lang in zip(texts, langs):
            if lang == name:
                for w in text.split():
                    seen[w] = seen.get(w, 0) + 1
        words: dict[str, int] = {}
        for w, n in seen.items():
            if w := letters_of(w):
                words[w] = words.get(w, 0) + n
        if not words:
            continue
        weight = np.array(list(words.values()), float)
        bucket, owner = grams(list(words))
        np.add.at(counts[k], bucket, weight[owner])
        np.add.at(scripts[k], [script_of(w) for w in words], weight)
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    used = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"names": names, "log": np.log(share).T.astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32), "scripts": (used & (scripts > 0)).T}


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """Per word: a score for each language (0 for the best, down to -SPREAD), whether any occurs in its script, and its number of letters."""
    plain = [letters_of(w) for w in words]
    out = np.zeros((len(words), len(model["names"]) + 2), np.float32)
    out[:, -1] = [len(p) for p in plain]
    have = [i for i, p in enumerate(plain) if p]
    if have and model["names"]:
        bucket, owner = grams([plain[i] for i in have])
        order = np.argsort(owner, kind="stable")
        starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
        score = np.add.reduceat(model["log"][bucket[order]], starts, axis=0, dtype=np.float32)
        may = model["scripts"][[script_of(plain[i]) for i in have]]
        score = np.where(may | ~may.any(axis=1, keepdims=True), score, -np.inf)
        score = np.maximum(score - score.max(axis=1, keepdims=True), -SPREAD)
        score[~may.any(axis=1)] = 0
        out[have, :-2] = score
        out[have, -2] = may.any(axis=1)
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY, chunk: int = CHUNK) -> np.ndarray:
    """Best language of every word; scores of all documents' words in a row, lengths by document."""
    k = scores.shape[1]
    if not scores.size:
        return np.zeros(len(scores), np.int64)
    parts = -(-lengths // chunk)
    first = np.cumsum(parts) - parts
    total = int(parts.sum())
    place = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first * chunk, lengths)
    e = np.zeros((total * chunk, k), np.float32)
    e[place] = scores
    e = np.ascontiguousarray(e.reshape(total, chunk, k).transpose(1, 0, 2))
    across = np.where(np.eye(k, dtype=bool), 0, -np.inf).astype(np.float32)[None].repeat(total, 0)
    for t in range(chunk):
        across = np.maximum(across, across.max(axis=2, keepdims=True) - penalty) + e[t][:, None, :]
    enter = np.zeros((total, k), np.float32)
    docs = np.flatnonzero(parts > 1)
    step = 1
    while docs.size:  # chunk after chunk, all documents that have one more
        c = first[docs] + step
        enter[c] = (enter[c - 1][:, :, None] + across[c - 1]).max(axis=1)
        step += 1
        docs = docs[parts[docs] > step]
    v, came = enter, np.zeros((chunk, total, k), np.uint8)
    states = np.arange(k, dtype=np.uint8)
    for t in range(chunk):
        best = v.max(axis=1, keepdims=True)
        came[t] = np.where(v >= best - penalty, states, v.argmax(axis=1)[:, None])
        v = np.maximum(v, best - penalty) + e[t]
    back = np.repeat(states[None], total, 0)  # the state before a chunk, by the state at its end
    for t in range(chunk - 1, -1, -1):
        back = np.take_along_axis(came[t], back, 1)
    end = v.argmax(axis=1).astype(np.uint8)
    docs, step = np.flatnonzero(parts > 1), 2
    while docs.size:
        c = first[docs] + parts[docs] - step
        end[c] = back[c + 1, end[c + 1]]
        docs = docs[parts[docs] > step]
        step += 1
    label = np.zeros((chunk, total), np.uint8)
    for t in range(chunk - 1, -1, -1):
        label[t] = end
        end = came[t][np.arange(total), end]
    return label.T.reshape(-1)[place].astype(np.int64)


def train(docs: DataFrame, held_out: int = 1, sample: int = SAMPLE) -> dict:
    """The model of docs(doc_id, text, lang): a bounded sample of labelled rows outside the held-out remainder of 3."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != held_out))
    found = bounded_texts(bounded_sample(rows.select("doc_id", "text", "lang"), sample))
    return fit([r["text"] for r in found], [r["lang"] for r in found])


class Identifier:
    def __init__(self, model: dict):
        self.model = model
        self.words = WordRows(lambda w: word_scores(model, w), len(model["names"]) + 2)

    def __call__(self, texts: list[str], spans: bool = False, evidence: bool = False) -> list[tuple]:
        """(language, score[, spans as (first word, words, language)][, its share of letters in known scripts, margin]) of each text."""
        names = self.model["names"]
        numbers = self.words([t.split() for t in texts])
        lengths = np.array([len(n) for n in numbers])
        rows = self.words.rows[np.concatenate(numbers)] if len(numbers) else np.zeros((0, len(names) + 2))
        labels = viterbi(rows[:, :-2], lengths) if names else np.zeros(len(rows), np.int64)
        out, at = [], 0
        for n in lengths.tolist():
            mine, letters = labels[at : at + n], rows[at : at + n, -1]
            total = float(letters.sum(dtype=np.float64))
            if not total or not names:
                found: tuple = (UNDETERMINED, 0.0)
            else:
                share = np.bincount(mine, weights=letters, minlength=len(names)) / total
                best = int(share.argmax())
                found = (names[best], float(min(1.0, share[best])))
            if evidence:
                found += self._evidence(rows[at : at + n], mine, names.index(found[0]), total) if found[0] != UNDETERMINED else (0.0, 0.0)
            if spans:
                cuts = np.flatnonzero(np.diff(mine, prepend=-1)).tolist() if names else []
                found += ([{"first": a, "words": b - a, "lang": names[mine[a]]} for a, b in zip(cuts, [*cuts[1:], n])],)
            out.append(found)
            at += n
        return out

    @staticmethod
    def _evidence(rows: np.ndarray, labels: np.ndarray, best: int, total: float) -> tuple[float, float]:
        """Of the words that have the best language and a script in which some language occurs: share of letters, margin over the next language."""
        rows = rows[(labels == best) & (rows[:, -2] > 0)]
        sums = rows[:, :-2].sum(axis=0, dtype=np.float64)
        others = np.delete(sums, best)
        return float(rows[:, -1].sum(dtype=np.float64)) / total, float(sums[best] - others.max()) if others.size else np.inf


def _identifier(model: dict) -> Identifier:
    return held(("language", zlib.crc32(model["log"].tobytes(), zlib.crc32(repr(model["names"]).encode()))), lambda: Identifier(model))


def determined(docs: DataFrame, model: dict, share: float) -> DataFrame:
    """The rows of docs with evidence for one language, with all their columns.

    Share of their letters at least stand in words that have this language and a script in which some learned language
    occurs, and these words' scores are MARGIN above those of the next language.
    """
    model = model | {"log": model["log"].astype(np.float16)}
    return kept_rows(docs, lambda texts: [lang != UNDETERMINED and own >= share and margin >= MARGIN for lang, _, own, margin in _identifier(model)(texts, evidence=True)])


def identify(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, lang_pred, score; spans adds the labelled spans."""
    model = model | {"log": model["log"].astype(np.float16)}

    def run(batches):
        own = _identifier(model)
        for batch in slices(batches):
            found = own(texts_of(batch), spans)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if spans:
                cols.append(pa.array([f[2] for f in found], pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<first:int,words:int,lang:string>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long"), aside, "text").mapInArrow(run, schema)
