"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the words of a text and their beginnings. Identity terms (names of groups of people) are
always features. For each labelled sentence that has one, a copy is made in which each identity term is swapped for
another of its kind, and, so that every term is seen in several sentences, copies of the first MENTION_ROWS sentences
with an added mention of a group; a change of the score
between such copies costs as much as PENALTY says. What a neutral mention of a group adds to the score therefore goes to
nothing, whatever company the terms keep in the labelled rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, texts_of

THRESHOLD = 0.3
#: Labelled rows of each label that the classifier is fitted on, at most, and characters of them in all.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 24_000_000
#: Characters that are read of one such row, from its beginning.
ROW_CHARS = 1_000_000
FEATURES = 2000
LEAST_ROWS = 3
EVIDENCE = 16.0
BEGINNINGS = (4, 5, 6, 7, 8)
RIDGE = 2e-4
PENALTY = 4.0
ROUNDS = 300
#: Words kept at a time in one Python worker.
CACHE = 200_000
#: Kinds of identity terms; a term is swapped within its kind.
IDENTITIES = {
    "gender": "woman women man men girl girls boy boys female male frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres transgender nonbinary",
    "faith": "muslim muslims christian christians jewish jews jew hindu hindus buddhist buddhists atheist atheists catholic catholics sikh sikhs muslime christen juden musulman musulmans juif juifs chrétien chrétiens musulmanes judíos cristianos",
    "origin": "black white asian latino latina hispanic african european arab arabs immigrant immigrants refugee refugees migrant migrants foreigner foreigners ausländer flüchtlinge immigré immigrés réfugiés inmigrante inmigrantes refugiados",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer lgbt schwul lesbisch homosexuel lesbienne homosexuales lesbiana",
    "ability": "disabled deaf blind autistic wheelchair behindert taub sourd aveugle handicapé sordo ciego discapacitado",
    "age": "old young elderly teenager teenagers senior seniors",
}
KINDS = {name: terms.split() for name, terms in IDENTITIES.items()}
KIND_OF = {term: name for name, terms in KINDS.items() for term in terms}
#: Labelled rows that are copied with an added mention of a group; four for each term.
MENTION_ROWS = 4 * len(KIND_OF)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Upper-case letters of two bytes in Latin-1, whose lower case is one bit away.
_UPPER = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")


def words(text: str) -> set[bytes]:
    data = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    if not data.isascii():
        data = _UPPER.sub(lambda m: bytes((0xC3, m[0][1] | 0x20)), data)
    return set(data.split())


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings where it is longer."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def __post_init__(self) -> None:
        self._cache: dict[bytes, tuple[bytes, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._cache = {}

    def _known(self, word: bytes) -> tuple[bytes, ...]:
        found = self._cache.get(word)
        if found is None:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            found = self._cache[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def score(self, text: str) -> float:
        found: set[bytes] = set()
        for known in map(self._known, words(text)):
            if known:
                found.update(known)
        total = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def _swapped(own: set[bytes], turn: int) -> set[bytes]:
    """own with each identity term exchanged for another of its kind."""
    out = set()
    for w in own:
        kind = KIND_OF.get(w.decode("utf-8", "replace"))
        if kind:
            terms = KINDS[kind]
            w = terms[(terms.index(w.decode()) + 1 + turn % (len(terms) - 1)) % len(terms)].encode()
        out.add(w)
    return out


def _evidence(a: int, n1: float, b: int, n0: float) -> float:
    """Likelihood ratio of a of n1 rows and b of n0 rows against one common share."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(k / (n * p)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - p))) if n > k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (part(a, n1, p) + part(b, n0, p)) if 0 < p < 1 else 0.0


def fit(texts: list[str], labels: list[int], penalty: float = PENALTY, mention_rows: int = MENTION_ROWS) -> Model:
    """Fit on labelled texts. Without both labels, the score is constant: the share of label 1, or 0 without rows.

    Identity terms are swapped in all texts; mentions are added to the first mention_rows of them.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, 20.0 if len(y) and y[0] else -20.0)
    # each distinct word once, and texts as arrays of word numbers, so that the sample takes little memory
    number: dict[bytes, int] = {}
    bags = [np.unique(np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32)) for t in texts]
    names: dict[bytes, int] = {}
    known = [np.array([names.setdefault(f, len(names)) for f in features(w)], np.int32) for w in number]
    every = list(names)

    def held(own: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([known[w] for w in own])) if len(own) else own

    seen = np.zeros((2, len(every)), np.int64)
    for own, label in zip(bags, labels, strict=True):
        seen[label][held(own)] += 1
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    # only what stands out by its likelihood ratio, so that few labelled rows give few features
    often = np.flatnonzero(seen.sum(axis=0) >= LEAST_ROWS)
    gain = {every[f]: _evidence(int(seen[1][f]), n1, int(seen[0][f]), n0) for f in often.tolist()}
    gain = {f: g for f, g in gain.items() if g >= EVIDENCE}
    chosen = sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES]
    terms = [t.encode() for t in KIND_OF]
    chosen += [t for t in dict.fromkeys(terms) if t not in set(chosen)]
    index = {f: i for i, f in enumerate(chosen)}
    word_of = list(number)

    def rows(bags: list[set[bytes]]) -> np.ndarray:
        out = np.zeros((len(bags), len(index)), np.float32)
        for r, own in enumerate(bags):
            out[r, [index[f] for w in own for f in features(w) if f in index]] = 1
        return out

    column = np.array([index.get(f, -1) for f in every], np.int64)
    x = np.zeros((len(bags), len(index)), np.float32)
    for r, own in enumerate(bags):
        at = column[held(own)]
        x[r, at[at >= 0]] = 1
    pairs = []
    for k, own in enumerate(bags):
        own = {word_of[w] for w in own} if k < mention_rows or any(word_of[w].decode("utf-8", "replace") in KIND_OF for w in own) else set()
        if any(w.decode("utf-8", "replace") in KIND_OF for w in own):
            pairs.append((own, _swapped(own, k)))
        if k < mention_rows:
            # the same sentence without a mention, with one, and with the next of its kind
            term = terms[k % len(terms)]
            pairs += [(own, own | {term}), (own | {term}, own | _swapped({term}, k))]
    change = rows([a for a, _ in pairs])
    change -= rows([b for _, b in pairs])
    del pairs, bags, known
    weights, bias = np.zeros(len(index), np.float32), float(np.log(n1 / n0))
    grown, pull = np.zeros(len(index), np.float32), 0.0
    balance = np.where(y == 1, max(1.0, n0 / n1 / 2), 1.0)
    balance /= balance.mean()
    for _ in range(ROUNDS):  # Adagrad
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        error = ((p - y) * balance).astype(np.float32)
        slope = x.T @ error / np.float32(len(y)) + np.float32(RIDGE) * weights + np.float32(penalty) * (change.T @ (change @ weights)) / np.float32(max(1, len(change)))
        grown += slope**2
        pull += error.mean() ** 2
        weights -= np.float32(0.5) * slope / (np.sqrt(grown) + np.float32(1e-8))
        bias -= 0.2 * error.mean() / (np.sqrt(pull) + 1e-8)
    return Model({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-6}, float(bias))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows rows of each label, chosen by a hash of the id, and none that is held out.

    Of a text, the first ROW_CHARS characters are read. A row beyond SAMPLE_CHARS is left out and those after it are
    tried; a quarter of the characters is kept for each label.
    """
    marked = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))
    chosen = [marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    # 2 x sample_rows ids at most
    chosen = F.broadcast(materialise(chosen[0].unionByName(chosen[1]), "toxic-sample"))
    texts, marks, used = [], [], [0, 0]
    sample = texts_of(docs, id_col, text_col).join(chosen, "doc_id").withColumn("text", F.substring("text", 1, ROW_CHARS)).orderBy(F.xxhash64("doc_id"), "text")
    for row in materialise(sample, "toxic-texts").orderBy(F.xxhash64("doc_id"), "text").limit(4 * sample_rows).toLocalIterator():
        label = int(row.label)
        kept = max(0, SAMPLE_CHARS // 4 - used[1 - label])
        if sum(used) + kept + len(row.text) > SAMPLE_CHARS:
            continue
        used[label] += len(row.text)
        texts.append(row.text)
        marks.append(label)
    return fit(texts, marks)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, score, predicted. Null text counts as empty, whose score is that of no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [shared.value.score(t) for t in batch.column(1).to_pylist()]
        marks = pa.array([int(s >= threshold) for s in scores], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), marks], ["doc_id", "score", "predicted"])

    return arrow_map(texts_of(docs, id_col, text_col), one, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null id is not held out. Rows that repeat are scored each. Without labels every score is next to 0. Only the
    text is used for a score; other columns aren't read.
    """
    scored = score(docs, learn(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under threshold, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, one, docs.schema)
