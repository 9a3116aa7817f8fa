"""Near-duplicates by the similarity of shingle sets, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tiergraph.llm import similar, simhash

SCHEMA = "doc_id bigint, text string"


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_components(sets):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and alike(sets[a], sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def planted():
    """Near copies on both sides of the bound, longer and shorter ones, chains, a group of many around one, and a line
    that many texts share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", "  ", "one two", "One\ttwo", "one two three", "a b c d e", "a b c d e f"]
    for k in range(12):
        base = [word() for _ in range(rng.choice((10, 40, 120, 300)))]
        for _ in range(6 if k else 40):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * rng.uniform(0.7, 1))]
            texts.append(" ".join(copy))
            if rng.random() < 0.2:
                base = copy
    texts += [f"{' '.join(word() for _ in range(rng.randint(0, 30)))} {line}" for _ in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("hot", "often"), [(1, 2), (3, 4), (10**6, 10**6)])
def test_similar_components(spark, monkeypatch, hot, often):
    monkeypatch.setattr(similar, "OFTEN", often)
    rows = planted()
    got = {r.doc_id: r.component_id for r in similar.similar_components(spark.createDataFrame(rows, SCHEMA), hot=hot).collect()}
    sets = {i: plain_set(t) for i, t in rows}
    assert got == plain_components(sets)
    assert len(set(got.values())) < len(got) - 40


def test_no_rows(spark):
    assert similar.similar_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_drops_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = base[:30] + ["v"] + base[31:70] + ["x"] + base[71:140] + ["y", "z"] + base[142:]
    far = [w if k % 10 else "q" for k, w in enumerate(base)]
    docs = spark.createDataFrame([(4, " ".join(near)), (2, " ".join(base)), (3, " ".join(far)), (1, "short one")], SCHEMA).withColumn("other", F.lit(1))
    assert alike(plain_set(" ".join(base)), plain_set(" ".join(near)))
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 2
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
