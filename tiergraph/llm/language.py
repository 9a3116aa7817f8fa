"""Language of text by a linear-chain conditional random field over its words.

A word's features are its beginning, its ending, its letters by threes and the word itself, hashed into one table of
weights; learned transitions say how a language follows another. Forward-backward gives each word's chances, so
code-switched text has a label a word; the chances' mean over a text says its language.

Sentences to learn from are joined from runs of words of texts in different languages, so that transitions between
languages are seen. Texts are worked through in blocks of equal length at once: the product of a block's matrices tells
how it carries chances across, so what reaches its edges is exact and no text is cut short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialise, texts_of

#: Whole rows to learn from in each language, and in all, at most.
SAMPLE_ROWS = 300
MOST_ROWS = 6000
#: Characters that are read of one such row, from its beginning.
ROW_CHARS = 20_000
BUCKETS = 1 << 16
EPOCHS = 3
BATCH = 64
RUNS = 6
RIDGE = 1e-6
BLOCK = 128
CACHE = 200_000
UNKNOWN = "und"
#: ASCII letters to lower case and other ASCII to a space; bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def feature_rows(found: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and where each word's begin."""
    # ^word$ in one array; a feature is a hash of its kind and up to 8 bytes
    data = np.frombuffer(b"^" + b"$^".join(found) + b"$" + bytes(8), np.uint8)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 2
    start = np.concatenate(([0], np.cumsum(size)[:-1]))

    def packed(at: np.ndarray, k: int, stop: np.ndarray | None = None) -> np.ndarray:
        """k bytes from each place; what is at stop or behind it, in the next word, counts as zero."""
        value = np.zeros(len(at), np.uint64)
        for j in range(k):
            own = data[at + j] if stop is None else np.where(at + j < stop, data[at + j], np.uint8(0))
            value = (value << np.uint64(8)) | own
        return value

    def hashed(value: np.ndarray, kind: int) -> np.ndarray:
        mixed = (value + np.uint64(kind)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        return ((mixed * _MIX) >> np.uint64(40)).astype(np.int64) % buckets

    grams = size - 2  # threes in ^word$
    word_of = np.repeat(np.arange(len(found)), grams)
    inside = np.arange(len(word_of)) - np.repeat(np.concatenate(([0], np.cumsum(grams)[:-1])), grams)
    threes = hashed(packed(start[word_of] + inside, 3), 3)
    end = start + size
    fixed = []
    for kind, k in ((11, 2), (12, 3), (13, 4)):  # with the mark, so 1 to 3 bytes of the word
        fixed.append(hashed(packed(start, k, end), kind))
        fixed.append(hashed(packed(np.maximum(end - k, start), k, end), kind + 10))
    lexicon = np.array([hash_word(w) for w in found], np.uint64)
    fixed.append(hashed(lexicon, 31))
    fixed = np.stack(fixed, axis=1)
    total = grams + fixed.shape[1]
    begin = np.concatenate(([0], np.cumsum(total)[:-1]))
    out = np.empty(int(total.sum()), np.int64)
    out[begin[word_of] + inside] = threes
    for j in range(fixed.shape[1]):
        out[begin + grams + j] = fixed[:, j]
    return out, begin


def hash_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def __post_init__(self) -> None:
        self._cache: dict[bytes, int] = {}
        self._table = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.weights, self.moves

    def __setstate__(self, state) -> None:
        self.languages, self.weights, self.moves = state
        self.__post_init__()

    def scores(self, found: list[bytes]) -> np.ndarray:
        """A row of scores for each word."""
        if len(self._cache) > CACHE:
            self._cache, self._table = {}, self._table[:0]
        new = list(dict.fromkeys(w for w in found if w not in self._cache))
        if new:
            rows, begin = feature_rows(new, len(self.weights))
            sums = np.add.reduceat(self.weights[rows], begin, axis=0)
            self._cache.update(zip(new, range(len(self._table), len(self._table) + len(new)), strict=True))
            self._table = np.concatenate((self._table, sums.astype(np.float32)))
        return self._table[np.fromiter(map(self._cache.__getitem__, found), np.int64, len(found))]

    def label(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text, a row of chances for each word; sums of rows are 1."""
        n = len(self.languages)
        lengths = [len(t) for t in texts]
        blocks = [-(-k // BLOCK) for k in lengths]
        total = sum(blocks)
        if not total:
            return [np.zeros((0, n)) for _ in texts]
        flat = self.scores([w for t in texts for w in t])
        flat = np.exp(np.clip(flat - flat.max(axis=1, keepdims=True), -50, 0)).astype(np.float64)
        # words in blocks; what is missing at a text's end carries chances as they are
        grid, real = np.ones((total, BLOCK, n)), np.zeros((total, BLOCK), bool)
        row = at = 0
        for k, b in zip(lengths, blocks, strict=True):
            grid[row : row + b].reshape(-1, n)[:k] = flat[at : at + k]
            real[row : row + b].reshape(-1)[:k] = True
            row += b
            at += k
        moves = np.exp(self.moves - self.moves.max())
        begin = np.cumsum([0, *blocks[:-1]])
        first = np.zeros(total, bool)
        first[[b for b, k in zip(begin, blocks, strict=True) if k]] = True

        carry = np.broadcast_to(np.eye(n), (total, n, n)).copy()
        for t in range(BLOCK):
            step = (carry.reshape(-1, n) @ moves).reshape(total, n, n) * grid[:, t, None, :]
            on = real[:, t].copy()
            if t == 0:  # no move into a text's first word
                step[first] = carry[first] * grid[first, t, None, :]
            carry = np.where(on[:, None, None], step, carry)
            carry /= carry.max(axis=(1, 2), keepdims=True)
        enter, leave = np.ones((total, n)), np.ones((total, n))
        live = np.array([b for b, k in zip(begin, blocks, strict=True) if k])
        count = np.array([k for k in blocks if k])
        for k in range(1, int(count.max())):
            into = live[count > k] + k
            enter[into] = np.einsum("bi,bij->bj", enter[into - 1], carry[into - 1])
            enter[into] /= enter[into].sum(axis=1, keepdims=True)
            out = (live + count - 1)[count > k] - k
            leave[out] = np.einsum("bij,bj->bi", carry[out + 1], leave[out + 1])
            leave[out] /= leave[out].sum(axis=1, keepdims=True)
        ahead = np.empty((total, BLOCK, n))
        now = enter
        for t in range(BLOCK):
            step = now @ moves * grid[:, t]
            if t == 0:
                step[first] = now[first] * grid[first, t]
            step /= step.sum(axis=1, keepdims=True)
            now = np.where(real[:, t, None], step, now)
            ahead[:, t] = now
        now = leave
        for t in range(BLOCK - 1, -1, -1):
            ahead[:, t] *= now
            step = (grid[:, t] * now) @ moves.T
            step /= step.sum(axis=1, keepdims=True)
            now = np.where(real[:, t, None], step, now)
        chances = ahead[real]
        chances /= chances.sum(axis=1, keepdims=True)
        return np.split(chances, np.cumsum(lengths)[:-1])


def _mixed(bags: list[list[bytes]], marks: np.ndarray, rng: np.random.Generator, count: int) -> list[tuple[list[bytes], np.ndarray]]:
    """Sentences of two or three runs of words, each from a text of its own."""
    out = []
    for _ in range(count):
        sentence, labels = [], []
        for k in rng.integers(0, len(bags), int(rng.integers(2, 4))):
            size = int(rng.integers(4, 24))
            at = int(rng.integers(0, max(1, len(bags[k]) - size + 1)))
            run = bags[k][at : at + size]
            sentence += run
            labels += [marks[k]] * len(run)
        out.append((sentence, np.array(labels)))
    return out


def fit(texts: list[str], languages: list[str], seed: int = 7) -> Field:
    """Learn from texts with a known language. Without any, there is one language, `und`."""
    known = sorted(set(languages)) or [UNKNOWN]
    n = len(known)
    # wide enough for many languages, within the same memory
    field = Field(known, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n)))
    pairs = [(words(t), known.index(lang)) for t, lang in zip(texts, languages, strict=True)]
    pairs = [p for p in pairs if p[0]]
    if n == 1 or not pairs:
        return field
    bags, marks = [p[0] for p in pairs], np.array([p[1] for p in pairs])
    rng = np.random.default_rng(seed)
    # each language as often as any other
    by_language = [np.flatnonzero(marks == k) for k in range(n)]
    even = np.concatenate([rng.choice(rows, max(len(r) for r in by_language)) for rows in by_language if len(rows)])
    bags, marks = [bags[k] for k in even], marks[even]
    grown, grown_moves = np.full((BUCKETS, n), 1e-6, np.float32), np.full((n, n), 1e-6)
    for _ in range(EPOCHS):
        sentences = _mixed(bags, marks, rng, max(400, RUNS * len(bags) // 4))
        for a in range(0, len(sentences), BATCH):
            part = sentences[a : a + BATCH]
            rows, begin = feature_rows([w for s, _ in part for w in s])
            score = np.add.reduceat(field.weights[rows], begin, axis=0).astype(np.float64)
            labels = np.concatenate([y for _, y in part])
            single, double = _expected([len(s) for s, _ in part], score, field.moves)
            single[np.arange(len(labels)), labels] -= 1
            move = double.copy()
            for _, y in part:
                np.add.at(move, (y[:-1], y[1:]), -1.0)
            # slopes of the table's rows
            word_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(rows))))
            used, place = np.unique(rows, return_inverse=True)
            slope = np.zeros((len(used), n))
            for k in range(n):
                slope[:, k] = np.bincount(place, single[word_of, k], len(used))
            slope = (slope / len(part) + RIDGE * field.weights[used]).astype(np.float32)
            grown[used] += slope**2
            field.weights[used] -= 0.3 * slope / np.sqrt(grown[used])
            move = move / len(part) + RIDGE * field.moves
            grown_moves += move**2
            field.moves -= 0.3 * move / np.sqrt(grown_moves)
    return field


def _expected(lengths: list[int], score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each word's language, and expected numbers of moves, by forward-backward over all sentences at once."""
    n, longest, count = score.shape[1], max(lengths), len(lengths)
    grid, real = np.ones((count, longest, n)), np.zeros((count, longest), bool)
    at = 0
    for k, size in enumerate(lengths):
        grid[k, :size] = np.exp(score[at : at + size] - score[at : at + size].max(axis=1, keepdims=True))
        real[k, :size] = True
        at += size
    move = np.exp(moves)
    ahead, behind = np.empty_like(grid), np.ones_like(grid)
    ahead[:, 0] = grid[:, 0] / grid[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        step = ahead[:, t - 1] @ move * grid[:, t]
        ahead[:, t] = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), ahead[:, t - 1])
    double = np.zeros((n, n))
    for t in range(longest - 1, 0, -1):
        right = grid[:, t] * behind[:, t]
        pair = ahead[:, t - 1, :, None] * move * right[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        double += pair[real[:, t]].sum(axis=0)
        step = right @ move.T
        behind[:, t - 1] = np.where(real[:, t, None], step / step.sum(axis=1, keepdims=True), behind[:, t])
    single = ahead * behind
    single /= single.sum(axis=2, keepdims=True)
    return single[real], double


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Learn from at most sample_rows rows a language, chosen by a hash of the id, none of them held out.

    Of each, the first ROW_CHARS characters are read, so at most MOST_ROWS times as many reach the driver.
    """
    marked = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), F.substring(docs[text_col], 1, ROW_CHARS).alias("text"))
    marked = marked.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = marked.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows)
    chosen = materialise(chosen.orderBy("k", "lang").limit(MOST_ROWS).select("doc_id", "lang"), "language-sample")
    texts = marked.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    rows = sorted(texts.dropDuplicates().orderBy(F.xxhash64("doc_id"), "text").limit(MOST_ROWS).toLocalIterator(), key=lambda r: (r.lang, r.doc_id, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def _batched(texts: list[list[bytes]], most: int = 60_000):
    """Parts of texts with about so many words each, blocks counted whole."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += -(-len(t) // BLOCK) * BLOCK
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def identify(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, lang_words (number of words by language).

    lang_pred is the language with the largest mean chance over all words, score that mean; ties go to the first name.
    Null texts and texts without a letter are `und` with score 0. A null id isn't held out. Rows that repeat are each
    labelled. Where no row has a language, all is `und`. Only the text is read for a prediction.
    """
    field = field or learn(docs, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = texts_of(docs, id_col, text_col).select("doc_id", "text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = shared.value
        texts = batch.column(1).to_pylist()
        found = [words(t) if has_letter(t) else [] for t in texts]
        names, scores, counts = [], [], []
        for part in _batched(found):
            for chances in field.label(part):
                if not len(chances):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    counts.append([])
                    continue
                mean = chances.mean(axis=0)
                best = int(mean.argmax())
                names.append(field.languages[best])
                scores.append(min(1.0, float(mean[best])))
                each = np.bincount(chances.argmax(axis=1), minlength=len(mean))
                counts.append([(field.languages[k], int(v)) for k, v in enumerate(each) if v])
        arrays = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "lang_words"])

    out = arrow_map(plain, one, f"doc_id {kind}, lang_pred string, score double, lang_words map<string,bigint>")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_words")
