"""The corpus operators against plain Python, on small tables with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiergraph.llm import chat, components, decontaminate, dedup_exact, dedup_substring, html_text, language, packing, simhash, token_store, tokens, toxicity
from tiergraph.llm.common import work_path

PATH = tokens.tokenizer_path()
SHA = lambda data: hashlib.sha256(data).hexdigest()


def docs(spark, rows):
    """With columns whose names operators use inside."""
    extra = ["digest", "n", "h", "a", "uid", "length", "point", "fp", "score", "label"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


ROWS = [(1, "The cat sat on the mat."), (2, "The cat sat on the mat."), (7, "The cat sat on the mat."), (7, "The cat sat on the mat."), (3, None), (4, ""), (5, "   "), (None, "The cat sat on the mat."), (6, "Ünïcode ÉTÉ straße 中文"), (8, "a " * 9000)]


# 9: exact dedup


def test_exact_dedup(spark):
    got = dedup_exact.exact_dedup(docs(spark, ROWS)).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t or "" for i, t in ROWS if i == r.doc_id)
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(x for x in groups[text] if x is not None), len(groups[text]), SHA(text.encode()))
    assert Counter(r.keep_id for r in got if r.kept) == {max(x for x in g if x is not None): 1 for g in groups.values()}
    assert dedup_exact.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_checks_bytes(spark):
    """With a digest that collides, texts are still told apart."""
    rows = [(k, f"{'ab'[k % 2]}{k % 3}") for k in range(12)] + [(12, None), (13, "")]
    got = dedup_exact.exact_dedup(docs(spark, rows), digest=lambda t: F.unhex(F.substring(F.md5(F.substring(t, 1, 1)), 1, 2)))
    want = defaultdict(list)
    for i, t in rows:
        want[t or ""].append(i)
    assert rows_of(got, "doc_id", "keep_id", "group_size") == sorted(((i, max(want[t or ""]), len(want[t or ""])) for i, t in rows), key=repr)
    assert got.where("kept").count() == len(want)


def test_keep_unique(spark):
    assert rows_of(dedup_exact.keep_unique(docs(spark, ROWS)), "doc_id") == [(4,), (5,), (6,), (7,), (8,)]
    assert rows_of(dedup_exact.keep_unique(docs(spark, ROWS[:3])), "doc_id") == [(7,)]
    assert dedup_exact.keep_unique(docs(spark, [(1, None), (1, ""), (1, "a")])).count() == 2
    assert dedup_exact.keep_unique(docs(spark, [])).count() == 0


def test_exact_dedup_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(dedup_exact, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(dedup_exact, "COMPARE_ROWS", 8)
    rows = [(k, "hot" if k % 3 == 0 else f"pair {k // 2}" if k % 3 == 1 else f"own {k}") for k in range(600)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows)
    assert sorted(rows_of(dedup_exact.exact_dedup(docs(spark, rows)), "doc_id", "keep_id", "group_size", "kept")) == want


# 10: SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    """fps by id -> smallest id reachable."""
    up = {i: i for i in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    rows = [(i, t) for i, t in ROWS if i is not None and i != 2] + [(20, "\tOne\n"), (21, "one two"), (22, "x y z w")]
    for k in range(30):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(400)] = "Q"
        rows.append((100 + k, " ".join(words)))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_components(docs(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert simhash.near_components(docs(spark, [])).count() == 0


def test_keep_one_of_each(spark):
    other, third = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    # 5 names two unlike texts; rows without an id; a copy of each kind
    rows = [(5, other), (5, third), (9, other), (None, third), (None, "alone and without an id"), (None, "alone and without an id"), (2, None), (3, "")]
    want = sorted([(5, other), (5, third), (None, "alone and without an id"), (2, None)], key=repr)
    assert rows_of(simhash.keep_one_of_each(docs(spark, rows).withColumns({"_row": F.lit("x"), "_keep": F.lit(1)})), "doc_id", "text") == want
    unique = [(5, other), (9, other), (1, third), (2, None), (3, "")]
    assert rows_of(simhash.keep_one_of_each(docs(spark, unique)), "doc_id") == [(1,), (2,), (5,)]
    assert simhash.keep_one_of_each(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_links_keep_components(spark, hot):
    rng = random.Random(hot)
    values = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):
            values.add(at)
            at ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                at ^= 1 << rng.randrange(64)
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    nodes = spark.createDataFrame([(k,) for k in signed], "fp bigint")
    roots = {r.node: r.root for r in components.components(simhash.links(nodes, hot)).collect()}
    # ids in order of signed value, so that the smallest is the root
    order = {k: i for i, k in enumerate(sorted(signed))}
    want = plain_components({order[k]: v for k, v in signed.items()})
    assert {order[k]: order[roots.get(k, k)] for k in signed} == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.components(edges).collect()} == {0}


# 3: decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(rows, items, window=10):
    windows = defaultdict(set)
    for name, text in items:
        own = plain_words(text)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            windows[tuple(own[k : k + window])].add(str(name))
    out = []
    for i, text in rows:
        own, hit, names = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if found := windows.get(tuple(own[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(own), len(hit), len(names), SHA(",".join(sorted(names)).encode()), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block", [10**6, 40])
def test_decontamination(spark, block):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for k in range(12)] + [(50, None), (51, "-- !"), (52, "Été, straße")]
    rows = [(k, " ".join(rng.choice("abcz.") for _ in range(rng.randint(0, 60)))) for k in range(30)] + [(99, None), (98, "x ÉtÉ été straße"), (98, "x ÉtÉ été straße"), (97, "".join(rng.choice("ab ") for _ in range(40000)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.report(docs(spark, rows), bench, block_chars=block)
    assert rows_of(got, *COLUMNS) == plain_report(rows, items)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.contaminated for r in decontaminate.report(docs(spark, ROWS), bench).collect()} == {False}
    assert decontaminate.report(docs(spark, []), bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=5), st.lists(st.sampled_from("abz"), max_size=50))
def test_automaton(items, text):
    named = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    spans, found = decontaminate.Automaton(named, 4).scan(decontaminate.words(" ".join(text)))
    _, _, hit, n, _, _ = plain_report([(0, " ".join(text))], named, 4)[0]
    assert (sum(b - a for a, b in spans), len(found)) == (hit, n)


def test_clean_cuts_passages_only(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    rows = [(1, "Before it, " + "and more words stand here too. " * 4 + passage.upper() + "! After it."), (2, passage), (3, "clean Text"), (4, None)]
    got = {r.doc_id: r.text for r in decontaminate.clean(docs(spark, rows), bench).collect()}
    assert got == {1: "Before it, " + "and more words stand here too. " * 4 + "! After it.", 3: "clean Text", 4: None}


# 1 and 8: tokens


def plain_ids(text):
    from tokenizers import Tokenizer

    tool = plain_ids.tool = getattr(plain_ids, "tool", None) or Tokenizer.from_file(PATH)
    return tool.encode(text or "", add_special_tokens=False).ids


def test_clean_is_the_same_over_several_blocks(spark):
    w = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(str(k), " ".join(w[a : a + 12])) for k, a in enumerate((0, 8, 20, 40))], "item_id string, text string")
    rows = [
        (1, "A. " + " ".join(w[:32]) + " tail " * 40),
        (2, " ".join(w[:12]) + " x " * 6 + ", ".join(w[40:52]) + " y" * 8),  # half and more, over two items
        (2, " ".join(w[15:25])),
        (3, None),
        (4, ""),
        (5, "x " + " ".join(w[:5]) + " " + " ".join(w[40:52]) + " " + " ".join(w[5:12]) + " z" * 40),  # no new match by cutting
    ]
    whole = rows_of(decontaminate.clean(docs(spark, rows), bench), "doc_id", "text")
    parts = decontaminate.clean(docs(spark, rows).withColumn("_row", F.lit("x")), bench, block_chars=40)
    assert parts.columns[-1] == "_row" and rows_of(parts, "doc_id", "text") == whole
    assert [r[0] for r in whole] == [1, 2, 3, 4, 5]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a", "Z", "é", "É", "é", " ", "\n", "\x1c", "\xa0", ".", ",", "!", "'s", "’", "ß", "İ", "Σ", "12", "中", "<|endoftext|>", "<|STARTOFTEXT|>", "ﬁ", "Å", "😀", "hello"]), st.text(max_size=3)), max_size=8))
def test_encoder_is_the_tokenizer(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert np.frombuffer(tokens.encoder(PATH).encode(text), "<u4").tolist() == plain_ids(text)


def test_token_store(spark):
    rows = ROWS + [(k, f"text {k} " * (k % 7)) for k in range(100, 160)]
    got = token_store.token_digests(docs(spark, rows), PATH).collect()
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in ordered]
    for r, (_, t) in zip(sorted(got, key=lambda r: r.start), ordered, strict=True):
        ids = [*plain_ids(t), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_digests(docs(spark, []), PATH).count() == 0


def test_token_store_reads_single_documents(spark, tmp_path):
    path = work_path(spark, "store")
    token_store.write_store(docs(spark, ROWS), path, PATH)
    found = {r.doc_id: r.ids for r in token_store.read_ids(spark, path, [6, 4, 77]).collect()}
    assert found == {6: [*plain_ids(ROWS[8][1]), 2], 4: [2]}
    writer = token_store.ShardWriter(f"file://{tmp_path}/x", frame_bytes=64)
    for k in range(50):
        writer.add(k, bytes(4 * (k % 20)))
    writer.close()
    reader = token_store.ShardReader(f"file://{tmp_path}/x")
    assert len(reader.frames) > 10 and [len(ids) // 4 for _, ids in reader] == [k % 20 for k in range(50)]
    data = bytearray((tmp_path / "x").read_bytes())
    data[int(reader.starts[3]) + 8] ^= 1
    (tmp_path / "x").write_bytes(bytes(data))
    with pytest.raises(Exception):  # noqa: B017  the frame can't be decompressed, or its checksum differs
        list(token_store.ShardReader(f"file://{tmp_path}/x"))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_every_piece(histogram):
    made = packing.plan(histogram, 40)
    used = Counter()
    for filling, n in made:
        assert sum(filling) <= 40 and n > 0
        for x in filling:
            used[x] += int(n)
    assert used == histogram
    total, n = sum(k * v for k, v in histogram.items()), sum(int(k) for _, k in made)
    assert n >= -(-total // 40)
    # no worse than first-fit decreasing's bound
    assert n <= 11 / 9 * max(-(-total // 40), sum(v for k, v in histogram.items() if k > 20)) + 8


def test_exact_complements():
    assert packing.plan({30: 5, 10: 5}, 40) == [([30, 10], 5)]
    assert packing.plan({21: 3, 12: 3, 7: 3}, 40) == [([21, 12, 7], 3)]
    assert packing.plan({25: 2, 7: 2, 5: 2, 3: 2}, 40) == [([25, 7, 5, 3], 2)]


def test_packing(spark):
    rows = ROWS + [(k, "word " * (k % 50 * 3)) for k in range(200, 320)]
    got = packing.pack(docs(spark, rows), PATH, size=64).collect()
    by_doc = defaultdict(list)
    for i, t in rows:
        by_doc[i].append([*plain_ids(t), 0])
    want = sorted(((i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for i, all_ids in by_doc.items() for ids in all_ids for k in range(0, len(ids), 64)), key=repr)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack(docs(spark, []), PATH).count() == 0


# 2: repeated substrings


def plain_repeats(rows, size):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, SHA(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé \n") for _ in range(300))
    rows = [(None, base[:100]), (0, base[50:150]), (0, base[50:150]), (1, None), (2, ""), (3, "a" * 23), (4, "a" * 200), (5, "ab" * 40), (6, base)]
    for k in range(10, 30):
        a = rng.randrange(250)
        noise = ["".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) for _ in range(2)]
        rows.append((k, noise[0] + base[a : a + rng.randint(5, 90)] + noise[1]))
    got = dedup_substring.remove_repeats(docs(spark, rows), size=24, guard=9)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_repeats(rows, 24)


def test_substring_dedup_of_nothing(spark):
    assert dedup_substring.remove_repeats(docs(spark, [])).count() == 0


def test_substring_dedup_over_block_ends(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abc") for _ in range(900))
    data = text.encode()
    whole = [tuple(np.concatenate(x).tolist() for x in zip(*dedup_substring.phrases(data, 60, 16), strict=True))]
    monkeypatch.setattr(dedup_substring, "BLOCK", 100)
    parts = [np.concatenate(x) for x in zip(*dedup_substring.phrases(data, 60, 16), strict=True)]
    spread = np.repeat(parts[2], parts[1])
    assert spread.tolist() == np.repeat(whole[0][2], whole[0][1]).tolist()


# 7: toxicity


def toxic_rows(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("aeioutnr") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        bad = k % 5 == 0
        if bad:
            words += rng.sample(["grobnak", "grobnish", "sloven", "vilest"], 2)
        # an identity term that comes with toxic rows far more often
        if rng.random() < (0.8 if bad else 0.05):
            words.append("immigrants")
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(600)
    rows += [(10_000, None), (10_001, ""), (10_002, "the immigrants came to town")]
    marked = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), marked).collect()}
    assert len(got) == len(rows)
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in held) for k, _ in labels)
    assert np.mean([got[k].predicted == dict(labels)[k] for k in held]) > 0.97
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert got[10_000].score == got[10_001].score and got[10_002].predicted == 0


def test_penalty_frees_identity_terms():
    rows, labels = toxic_rows(600)
    free, bound = (toxicity.fit([t for _, t in rows], [y for _, y in labels], p) for p in (0.0, toxicity.PENALTY))
    weight = lambda model: sum(model.weights.get(f, 0) for f in toxicity.features(b"immigrants"))
    assert weight(free) > 0.3 and abs(weight(bound)) < 0.1 * weight(free)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs(spark, ROWS), none).collect()} == {0}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


# 4: language


def language_rows(n):
    rng = random.Random(4)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "que", "é"]}
    out = []
    for k in range(n):
        lang = rng.choice(list(sounds))
        out.append((k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 300))), lang))
    return out


def test_language(spark):
    rows = language_rows(300) + [(900, None, "aa"), (901, "12 3 !", "aa"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(3))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[k].held_out for k, *_ in held)
    assert np.mean([got[k].lang_pred == lang for k, _, lang in held]) > 0.97
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_language_of_code_switched_text():
    rows = language_rows(200)
    field = language.fit([t for _, t, _ in rows], [x for *_, x in rows])
    text = language.words("kato mika tomi kaka verung schver ungsch schung")
    chances = field.label([text])[0]
    assert [field.languages[k] for k in chances.argmax(axis=1)] == ["aa"] * 4 + ["bb"] * 4


def test_blocks_are_exact(monkeypatch):
    rows = language_rows(60)
    field = language.fit([t for _, t, _ in rows], [x for *_, x in rows])
    texts = [language.words(t) for _, t, _ in rows[:10]] + [[], [b"ka"]]
    whole = field.label(texts)
    monkeypatch.setattr(language, "BLOCK", 7)
    for a, b, t in zip(whole, field.label(texts), texts, strict=True):
        assert np.allclose(a, b)
        if t:
            single, _ = language._expected([len(t)], field.scores(t).astype(float), field.moves)
            assert np.allclose(a, single)


# 5: chat


def test_chat(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text), (1, 2, "assistant", "\\b\\l<#\n"), (1, 0, None, None), (1, 2, "assistant", "z"), (1, None, "a:b", "q"), (None, 5, "assistant", "é中😀")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("x")).withColumn("message", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_format(df).collect()}
    for conv in (-7, 1, None):
        own = sorted(((-1 if n is None else n, role or "", t or "") for c, n, role, t in rows if c == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), SHA("".join(f"{a}\n{t}\n" for _, a, t in own).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), SHA(loss.encode()))
    assert chat.chat_format(df.limit(0)).count() == 0


def test_events_are_folded(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "He"), (1, 3, 2, "delta", None, "llo"), (1, 5, 2, "regenerate", None, "By"), (1, 6, 2, "delta", None, "e"),
        (1, 4, 1, "edit", None, "hey"), (1, 7, 3, "message", "user", "x"), (1, 8, 3, "delete", None, None), (2, 1, 9, "delta", "assistant", "a"), (2, 2, 9, "delta", None, None), (2, 3, 9, "delta", None, "b"),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    assert rows_of(chat.fold(events), "conv_id", "at", "role", "text") == [(1, 1, "user", "hey"), (1, 2, "assistant", "Bye"), (2, 1, "assistant", "ab")]


# 6: pages


def test_pages(spark):
    page = "<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><a>menu here</a></nav><div class='ad big'>buy it</div><article><h1>Head &amp; line</h1><p>One  <b>bo</b>ld.<br>Two<p>Three &lt;3<div class=comments>no no</div></article><footer>foot</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>"), (5, "x", "<nav>a b c</nav>"), (5, "x", "plain text"), (6, "y", "<!-- open"), (7, "z", "<p>" + "word " * 50000 + "</p>")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x")))
    want = [(1, "u", "Head & line\nOne bold.\nTwo\nThree <3"), (2, None, ""), (3, "v", ""), (4, "w", ""), (5, "x", ""), (5, "x", "plain text"), (6, "y", ""), (7, "z", ("word " * 50000).strip())]
    assert rows_of(got, "page_id", "url", "text") == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_labelled_pages_come_out():
    for page in html_text.LABELLED:
        want = " ".join(" ".join(re.findall(r"\{\{(.*?)\}\}", page, re.S)).replace("<", " <").split())
        want = " ".join(re.sub(r"<[^>]*>", "", want).split())
        assert " ".join(html_text.extract(page.replace("{{", "").replace("}}", "")).split()).replace(" ,", ",").replace(" .", ".") == want.replace(" ,", ",").replace(" .", ".")


def test_largest_part():
    assert html_text.best_part([(0, 5.0), (3, -9.0), (5, 4.0), (6, 3.0)]) == (5, 6)
    assert html_text.best_part([(0, -1.0)]) is None
