"""Substring dedup: windows by sorted suffixes, and buckets too large for one task, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiergraph.llm import dedup_substring


def plain_spans(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + size] for _, b in texts for k in range(len(b) - size + 1))
    return {(i, k) for i, b in texts for k in range(len(b) - size + 1) if seen[b[k : k + size]] > 1}


@pytest.mark.parametrize("seed", range(30))
def test_equal_windows(seed):
    rng = random.Random(seed)
    size, phrases, n, back, bucket = 12, [], [], [], []
    middle = [bytes(rng.choice(b"ab\0") for _ in range(8)) for _ in range(3)]
    for _ in range(rng.randint(0, 60)):
        g = rng.randrange(3)
        left = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6)))
        least = rng.randint(0, len(left))  # the last window begins this many bytes before the trigger
        right = middle[g] + bytes(rng.choice(b"ab\0") for _ in range(20))
        phrases.append(left + right[: size - least])
        n.append(len(left) - least + 1)
        back.append(len(left))
        bucket.append(g)
    seen = Counter()
    for p, k, t, g in zip(phrases, n, back, bucket, strict=True):
        seen.update((g, t - w, p[w : w + size]) for w in range(k))
    want = {(i, w) for i, (p, k, t, g) in enumerate(zip(phrases, n, back, bucket, strict=True)) for w in range(k) if seen[g, t - w, p[w : w + size]] > 1}
    runs = dedup_substring.equal_windows(phrases, n, back, bucket, size)
    got = [(i, w) for i, a, b in runs for w in range(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("hot", "sorted_at_once"), [(1, 4), (3, 4), (1024, 4), (1024, 16_384)])
def test_spans_are_alike_however_buckets_are_dealt(spark, monkeypatch, hot, sorted_at_once):
    monkeypatch.setattr(dedup_substring, "SORTED", sorted_at_once)
    monkeypatch.setattr(dedup_substring, "SENT", 200)
    rng = random.Random(hot)
    line = "".join(rng.choice("abcd") for _ in range(20))
    noise = lambda n: "".join(rng.choice("abc") for _ in range(n))
    rows = [(k, noise(rng.randint(0, 9)) + line[rng.randint(0, 3) :] + noise(rng.randint(0, 9))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "x" * 60), (103, line * 4), (104, line * 4)]
    texts = dedup_substring._texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    found = dedup_substring.repeated_spans(texts, size=24, guard=9, step=4, hot=hot)
    windows = found.select("doc_id", F.explode(F.sequence("a", F.col("b") - 24)).alias("at")).distinct()
    assert {(r.doc_id, r["at"]) for r in windows.collect()} == plain_spans(rows, 24)
