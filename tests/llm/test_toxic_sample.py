"""Which labelled rows the classifier is fitted on, and which are copied with another group."""

import random

from tiergraph.llm import toxicity


def labelled(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(5))
    return [(k, " ".join(word() for _ in range(20)) + (" grobnak sloven" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(n)]


def learned(spark, monkeypatch, rows):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: seen.append((texts, marks)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    return seen[0]


def test_a_long_row_ends_nothing(spark, monkeypatch):
    rows = labelled(60)
    texts, marks = learned(spark, monkeypatch, rows)
    # the first row in order is longer than all that is read
    first = next(k for k, r in enumerate(rows) if r[1] == texts[0])
    rows[first] = (rows[first][0], "w " * 20_000, rows[first][2])
    for row_chars in (10_000, 100_000):
        monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 30_000)
        monkeypatch.setattr(toxicity, "ROW_CHARS", row_chars)
        got, got_marks = learned(spark, monkeypatch, rows)
        assert got[-len(texts) + 1 :] == texts[1:] and got_marks[-len(texts) + 1 :] == marks[1:]
        assert all(len(t) <= 10_000 for t in got) and len(got) == len(texts) - (row_chars > 10_000)


def test_both_labels_stay(spark, monkeypatch):
    # label 0 alone would take all that is read
    rows = [(k, t if label else "w " * 500 + t, label) for k, t, label in labelled(90)]
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 16_000)
    texts, marks = learned(spark, monkeypatch, rows)
    every = [r for r in learned(spark, monkeypatch, [(k, t[-140:], label) for k, t, label in rows])[1] if r]
    assert sum(map(len, texts)) <= 16_000 and marks.count(0) > 5 and marks.count(1) == len(every)


def test_swaps_in_every_row_with_a_term(monkeypatch):
    rows = labelled(600)
    texts = [t + (" jewish" if k >= 500 else "") for k, t, _ in rows]
    seen = []
    swapped = toxicity._swapped
    monkeypatch.setattr(toxicity, "_swapped", lambda own, turn: seen.append(own) or swapped(own, turn))
    toxicity.fit(texts, [r[2] for r in rows])
    sentences = [own for own in seen if len(own) > 1]
    assert sentences == [toxicity.words(t) for t in texts[500:]]
    added = len(seen) - len(sentences)
    assert added == toxicity.MENTION_ROWS
    seen.clear()
    toxicity.fit(texts, [r[2] for r in rows], mention_rows=0)
    assert len(seen) == 100
