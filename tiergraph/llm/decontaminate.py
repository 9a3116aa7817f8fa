"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

A document's words are streamed through the automaton, which tracks the longest match that ends at each word. Ten
matched words, or a whole shorter item, are a hit. The automaton is built from a benchmark block of bounded size and
broadcast; a larger benchmark is worked through in several blocks, one pass over the documents each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, texts_of

WINDOW = 10
#: Characters of benchmark text in one broadcast automaton.
BLOCK_CHARS = 4_000_000
#: A document with at least this share of its words hit is dropped whole by clean().
MAX_COVERAGE = 0.5
#: ASCII bytes to lower-case letters and digits or a space; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """States with suffix links over the items' words; each state of a window knows the items that hold it."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[tuple[int, str, int]] = []
        for name, text in items:
            own = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            last, path = 0, []
            for w in own:
                last = self._extend(last, w)
                path.append(w)
            if own:
                ends.append((last, name, len(own)))
        self._index(items, ends)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, w, known)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _index(self, items: Iterable[tuple[str, str]], ends: list[tuple[int, str, int]]) -> None:
        """held: items by the state of a window of theirs; short: (words, item) by the state that ends a short item."""
        self.held: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for last, name, n in ends:
            if n < self.window:
                self.short.setdefault(last, []).append((n, name))
        for name, text in items:
            if len(own := words(text)) >= self.window:
                for state, n in self.matches([self.ids[w] for w in own]):
                    if n >= self.window:
                        self.held.setdefault(self._window_state(state), set()).add(name)
        # the short items that end at a state, along its links
        self.tails: dict[int, list[tuple[int, str]]] = {}
        for state in range(1, len(self.next)):
            found, p = [], state
            while p > 0:
                found += self.short.get(p, [])
                p = self.link[p]
            if found:
                self.tails[state] = found

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, own: list[int | None]):
        """(state, length of the longest match that ends here) for each word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for w in own:
            if w is None:
                state = n = 0
            else:
                to = nxt[state].get(w)
                if to is None:
                    while state and to is None:
                        state = link[state]
                        to = nxt[state].get(w)
                    n = length[state]
                state, n = (to, n + 1) if to is not None else (0, 0)
            yield state, n

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [a, b) of hit words, and the items with a window there."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        window, tails, nxt, link, length = self.window, self.tails, self.next, self.link, self.length
        root = nxt[0]
        state = n = 0
        for i, w in enumerate(map(self.ids.get, own)):
            if w is None:
                state = n = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while state:
                    state = link[state]
                    if (to := nxt[state].get(w)) is not None:
                        break
                n = length[state]
                if to is None:
                    to = root[w]
                    n = 0
            state = to
            n += 1
            most = 0
            if n >= window:
                most = window
                found |= self.held[self._window_state(state)]
            if state in tails:
                for size, name in tails[state]:
                    if size <= n:
                        most = max(most, size)
                        found.add(name)
            if most:
                a = i + 1 - most
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


def _blocks(bench: DataFrame, item_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The benchmark in blocks of about limit characters."""
    plain = bench.select(bench[item_col].cast("string").alias("item"), F.coalesce(bench[text_col], F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = total // limit + 1
    if parts == 1:
        return [plain]
    return [plain.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) for k in range(parts)]


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (array of [first, end) word positions), items (sorted strings).

    Null text has no words; an empty benchmark hits nothing; repeated rows give a row each. An item without words
    or with a null id is in no document. Other columns of either table aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, uid bigint, n_words bigint, spans array<array<int>>, items array<string>"
    blocks = _blocks(bench, item_col, bench_text_col, block_chars)
    plain = texts_of(docs, id_col, text_col)
    if len(blocks) > 1:  # a row number that all passes share
        plain = materialise(plain.withColumn("uid", F.monotonically_increasing_id()), "bench-docs")
    else:
        plain = plain.withColumn("uid", F.lit(0).cast("bigint"))
    out = []
    for block in blocks:
        rows = [(r.item, r.text) for r in block.where("item IS NOT NULL").toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(rows, window))

        def one(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            auto = shared.value
            n, spans, items = [], [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                found, names = auto.scan(own)
                n.append(len(own))
                spans.append(found)
                items.append(sorted(names))
            arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "uid", "n_words", "spans", "items"])

        out.append(arrow_map(plain, one, schema))
    if len(out) == 1:
        return out[0].drop("uid")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    every = every.groupBy("doc_id", "uid", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return every.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), "items")


def n_hit(spans):
    """Words in a union of sorted spans, which may overlap."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s[1] - F.greatest(s[0], acc["to"]), F.lit(0))).alias("n"), F.greatest(s[1], acc["to"]).alias("to")),
        lambda acc: acc["n"],
    )
    return step.cast("bigint")


def report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """hits() as counts and a digest of the items."""
    found = hits(docs, bench, **options)
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def merged(spans: Iterable[list[int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_coverage: float = MAX_COVERAGE, window: int = WINDOW, **options) -> DataFrame:
    """docs with hit spans cut out of text_col; rows whose hit share reaches max_coverage go.

    Rows without a hit come back as they are, null text included. Columns and their order stay. A benchmark of several
    blocks gives what one block would: spans and shares are taken over all blocks before anything is cut.
    """
    block_chars = options.get("block_chars", BLOCK_CHARS)
    blocks = _blocks(bench, options.get("item_col", "item_id"), options.get("bench_text_col", "text"), block_chars)
    at = docs.columns.index(text_col)

    def keep(texts: list[str | None], found: Iterable[tuple[list[tuple[int, int]], int]]) -> tuple[list[str | None], list[bool]]:
        out, stay = [], []
        for text, (spans, n) in zip(texts, found, strict=True):
            share = sum(b - a for a, b in spans) / n if n else 0
            stay.append(share < max_coverage or not spans)
            out.append(cut(text, spans) if spans else text)
        return out, stay

    def put(batch: pa.RecordBatch, texts: list[str | None], stay: list[bool]) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(stay, pa.bool_()))

    if len(blocks) == 1:
        rows = [(r.item, r.text) for r in blocks[0].where("item IS NOT NULL").toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(rows, window))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            own = (words(text or "") for text in texts)
            return put(batch, *keep(texts, ((shared.value.scan(w)[0], len(w)) for w in own)))

        return arrow_map(docs, one, docs.schema)

    number = "_row"
    while number in docs.columns:
        number += "_"
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "bench-rows")
    found = hits(numbered, bench, id_col=number, text_col=text_col, window=window, **options).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_of"), F.struct("spans", "n_words").alias("_hit"))
    both = numbered.join(found, numbered[number] == found["_of"], "left").select(*[numbered[c] for c in docs.columns], found["_hit"].alias(number))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = batch.num_columns - 1
        hit = [(merged(h["spans"]), h["n_words"]) if h else ([], 0) for h in batch.column(last).to_pylist()]
        return put(batch.remove_column(last), *keep(batch.column(at).to_pylist(), hit))

    return arrow_map(both, apply, docs.schema)
