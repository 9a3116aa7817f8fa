import json

import pandas as pd
import pytest
from corpus_files import write
from pyspark.sql import functions as F

from tiergraph.operators import metadata, quantify, summary, transcribe
from tiergraph.plans import eql
from tiergraph.sources import annot_json, cmdi
from tiergraph.streaming import sync


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("fx_corpus"))


@pytest.fixture(scope="module")
def corpus(spark, folder, tmp_path_factory):
    return annot_json.read_corpus(spark, folder).save(str(tmp_path_factory.mktemp("store")))


def ids(found):
    return sorted((r.bundle, r.start_item_id) if r.start_item_id == r.end_item_id else (r.bundle, r.start_item_id, r.end_item_id) for r in found.collect())


def b(text):
    """`B1/1 2 B2/5` as pairs."""
    out, bundle = [], None
    for part in text.split():
        if "/" in part:
            bundle, _, part = part.partition("/")
        out.append((bundle, *map(int, part.split("-"))))
    return sorted(out)


QUERIES = {
    "Phonetic == a": "B1/15 18 B2/7 B3/5",
    "Phoneme != n": "B1/6 7 8 9 10 13 B2/3 4 B3/3 4",
    "Word:Accent == S": "B1/1 B2/1",
    "Word != cat": "B1/2 B2/1 B3/1 6",
    "Phonetic =~ [tk]": "B1/14 16 B2/6",
    "Phoneme =~ .*": "B1/6 7 8 9 10 11 12 13 B2/3 4 5 B3/3",
    "Phoneme !~ .*": "B3/4",
    "[Phoneme == a -> Phoneme == n]": "B1/10-11 B2/4-5",
    "[Phoneme == n -> Phoneme == n]": "B1/11-12",
    "[#Phoneme == a -> Phoneme == n]": "B1/10 B2/4",
    "[Phoneme == a -> #Phoneme == n]": "B1/11 B2/5",
    "[Phonetic == a -> Phonetic == n]": "B1/18-19 B2/7-8",
    "[Syllable == S ^ Phoneme == n]": "B1/4 B2/2",
    "[Syllable == S ^ #Phoneme == n]": "B1/11 B2/5",
    "[Phoneme == n ^ Syllable == S]": "B1/11 B2/5",
    "[Word =~ .* ^ Phonetic == n]": "B1/2 B2/1",
    "Start(Syllable, Phoneme) == 1": "B1/6 9 12 B2/3 B3/3",
    "End(Syllable, Phoneme) == 1": "B1/8 11 13 B2/5 B3/4",
    "Medial(Syllable, Phoneme) == 1": "B1/7 10 B2/4",
    "Medial(Syllable, Phoneme, 2)": "B1/7 10 13 B2/4 B3/4",
    "Start(Phoneme, Phonetic) == 1": "B1/14 15 16 17 18 19 20 B2/6 7 8 B3/5",
    "Start(Syllable, Phoneme) != 1": "B1/7 8 10 11 13 B2/4 5 B3/4",
    "Num(Syllable, Phoneme) >= 3": "B1/3 4 B2/2",
    "Num(Word, Syllable) == 0": "B3/6",
    "Num(Word, Syllable) >= 2": "B1/2",
    "[Phonetic == t | Phonetic == k | Phonetic == i]": "B1/14 16 20 B2/6",
    "[Phoneme == n & End(Syllable, Phoneme) == 1]": "B1/11 B2/5",
    "[[Phoneme == a -> Phoneme == n] ^ Phonetic == a]": "B1/10-11 B2/4-5",
    "[Syllable == S ^ [Phoneme == a -> Phoneme == n]]": "B1/4 B2/2",
    "[Phoneme == s -> Phoneme == a -> Phoneme == n]": "B1/9-11",
}


@pytest.mark.parametrize("text", QUERIES)
def test_queries(corpus, text):
    assert ids(corpus.query(text)) == b(QUERIES[text])


def test_rows_carry_times_and_labels(corpus):
    rows = {(r.bundle, r.labels): (r.start, r.end) for r in corpus.query("[Phonetic == a -> Phonetic == n]").collect()}
    assert rows == {("B1", "a->n"): (360, 610), ("B2", "a->n"): (60, 300)}
    assert {r.start for r in corpus.query("Word == cat").collect()} == {None}
    assert [(r.start, r.end) for r in corpus.query("Tone == L-").collect()] == [(650, 650)]


@pytest.mark.parametrize("text", ["", "Phoneme", "Phoneme == ", "[Phoneme == a", "Nothing == a", "Phoneme:Accent == a", "[Word == a -> Phoneme == b]", "[Tone == a ^ Phoneme == b]", "Num(Word, Syllable)", "Start(Word, Syllable) > 1", "Duration > 100"])
def test_bad_queries_are_errors(corpus, text):
    with pytest.raises(eql.EqlSyntaxError):
        corpus.query(text)


def test_options(corpus):
    assert len(ids(corpus.query("Word != cat", other_attributes=True))) == 4 + 4 + 1
    assert ids(corpus.query("Phonetic =~ ^[tk]$", patterns="regex")) == b("B1/14 16 B2/6")


def test_navigation(corpus):
    a = corpus.query("Phonetic == a")
    assert ids(corpus.scout(a, 1)) == b("B1/16 19 B2/8")
    rows = {(r.bundle, r.labels): (r.start, r.end) for r in corpus.scout(a, 1, capture=2).collect()}
    assert rows == {("B1", "t s"): (200, 360), ("B1", "n i"): (470, 700), ("B2", "n"): (190, 300)}
    assert ids(corpus.retreat(corpus.scout(a, 1), 1)) == b("B1/15 18 B2/7")
    assert ids(corpus.ascend_to(corpus.query("Phonetic == n"), "Phoneme")) == b("B1/11 12 B2/5")
    assert ids(corpus.ascend_to(corpus.query("Phonetic == n"), "Word")) == b("B1/2 B2/1")
    assert [(r.start_item_id, r.start) for r in corpus.descend_to(corpus.query("Syllable == W"), "Tone").collect()] == [(22, 650)]


def test_positions_part_all_children(corpus):
    parts = [set(ids(corpus.query(f"{f}(Syllable, Phoneme) == 1"))) for f in ("Start", "End", "Medial")]
    assert set.union(*parts) == set(ids(corpus.query("Phoneme =~ *")) + b("B3/4"))


def test_metadata(corpus):
    rows = {r.bundle: r.asDict() for r in corpus.metadata().collect()}
    assert {k: r["Country"] for k, r in rows.items()} == {"B1": "Canada", "B2": "USA", "B3": "USA"}
    assert {k: r["Dialect"] for k, r in rows.items()} == {"B1": "Northern", "B2": "Northern", "B3": None}
    assert {r.bundle: r.value for r in metadata.field(corpus, "Age", "integer").collect()} == {"B1": 9, "B2": 9, "B3": None}
    assert {r.bundle for r in corpus["S1"].collect()} == {"B1", "B2"} and {r.bundle for r in corpus["B[23]"].collect()} == {"B2", "B3"}
    later = corpus.set_metadata(bundle="B2", Speaker="S002").set_metadata(Country="UK")
    assert {r.bundle: (r.Speaker, r.Country) for r in later.metadata().collect()} == {"B1": ("S001", "Canada"), "B2": ("S002", "UK"), "B3": (None, "UK")}
    with pytest.raises(ValueError):
        corpus.set_metadata(allow_new=False, Height=3)
    with pytest.raises(TypeError):
        corpus.set_metadata(bundle="B1", Age="nine")


def test_sheets(corpus, tmp_path):
    metadata.export_sheets(corpus, str(tmp_path))
    rows = {(r.session, r.bundle): r.asDict() for r in metadata.sheet(corpus, "bundles").collect()}
    assert rows["S1", "B1"]["Speaker"] == "S001" and rows["S2", "B3"]["Country"] is None and "Gender" in rows["S2", "B3"]
    text = (next((tmp_path / "sessions").glob("part-*.csv"))).read_text()
    assert "Northern" in "".join(p.read_text() for p in (tmp_path / "sessions").glob("part-*.csv")) and text.startswith("db_uuid,session,")
    for p in (tmp_path / "sessions").glob("*.csv"):
        changed = p.read_text().replace("Northern", "Southern")
        p.unlink()
        (tmp_path / "sessions" / f".{p.name}.crc").unlink(missing_ok=True)
        p.write_text(changed)
    later = metadata.import_sheets(corpus, str(tmp_path))
    assert {r.bundle: (r.Dialect, r.Speaker, r.Country) for r in later.metadata().collect()} == {"B1": ("Southern", "S001", "Canada"), "B2": ("Southern", None, "USA"), "B3": (None, None, "USA")}
    assert {r.bundle: r.value for r in metadata.field(later, "Age", "integer").collect()} == {"B1": 9, "B2": 9, "B3": None}


def test_round_trip(spark, corpus, folder):
    made = annot_json.write_back(corpus).collect()
    for r in made:
        with open(f"{folder}/{r.session}_ses/{r.bundle}_bndl/{r.bundle}_annot.json") as f:
            mine, theirs = json.loads(r.json), json.load(f)
        for x in (mine, theirs):  # links have no order
            x["links"].sort(key=lambda k: (k["fromID"], k["toID"]))
        assert mine == theirs


def test_counts_and_export(spark, corpus, folder):
    assert {r.what: r.n for r in summary.corpus_counts(corpus).collect()} == {"bundles": 3, "items": 36, "labels": 41, "links": 32, "sessions": 2}
    text = cmdi.export(corpus, "Fixture")
    assert cmdi.read(text)["Bundles"] == "3" and cmdi.read(text)["Title"] == "Fixture"
    assert annot_json.signal_hashes(spark, folder).count() == 3


def test_changes(spark, corpus, folder, tmp_path):
    now = annot_json.annotations(spark, folder, "fx")
    keys = ["session", "bundle"]
    assert sync.changes(now, None, keys, "md5_annot_json").count() == 3
    before = now.withColumn("md5_annot_json", F.when(F.col("bundle") == "B2", "old").otherwise(F.col("md5_annot_json"))).where("bundle != 'B3'")
    assert {(r.bundle, r.change) for r in sync.changes(now, before, keys, "md5_annot_json").collect()} == {("B2", "changed"), ("B3", "new")}
    seen = []
    for _ in range(2):
        sync.follow(spark, folder, str(tmp_path / "check"), lambda df, _: seen.extend(r.bundle for r in df.collect()))
    assert sorted(seen) == ["B1", "B2", "B3"]


def test_suggestions_are_checked_written_and_taken_back(spark, corpus):
    rows = [("fx-0001", "S1", "B1", 0.0, 100.0, "x"), ("fx-0001", "S1", "B1", 50.0, 150.0, "y"), ("fx-0001", "S1", "B2", 0.0, 100.0, "x"), ("fx-0001", "S1", "B2", 100.0, 105.0, ""), ("fx-0001", "S2", "B3", 100.0, 900.0, "z")]
    given = spark.createDataFrame(rows, "db_uuid string, session string, bundle string, start_time double, end_time double, label string")
    ready = transcribe.prepare(corpus, "Vowel", "SEGMENT")
    made = transcribe.suggestions(given, "Vowel")
    assert {(r.bundle, r.problem) for r in transcribe.problems(ready, made).collect()} == {("B1", "overlap"), ("B2", "short"), ("B2", "empty"), ("B3", "outside")}
    new, log = transcribe.transcribe(ready, made)
    assert ids(new.query("Vowel == x")) == b("B2/9")
    assert [(r.item_id, r.seq_idx, r.sample_start, r.sample_dur) for r in new.items.where("level = 'Vowel'").orderBy("seq_idx").collect()] == [(9, 1, 0, 100), (10, 2, 100, 5)]
    back = transcribe.reverse(new, log)
    assert back.items.count() == 36 and back.labels.count() == 41


def test_quantify(corpus):
    found = corpus.query("Phonetic == a")
    track = lambda seg: pd.DataFrame({"f1": range(10), "f2": range(10, 20)})
    rows = quantify.quantify(found, track, "f1 bigint, f2 bigint", at=[0.25, 0.5, 0.75]).collect()
    assert len(rows) == 12 and {(r.time_point, r.f1) for r in rows} == {(0.25, 1), (0.5, 4), (0.75, 7)}
    rows = quantify.quantify(found, lambda seg, k: {"x": k / (seg["start"])}, "x double", parameters={"k": 2.0}, errors=True).collect()
    assert sorted(r.error is None for r in rows) == [False, True, True, True]
    with pytest.raises(ValueError):
        quantify.quantify(found, track, "f1 bigint", at=[2.0])
    pairs = quantify.quantify_pairs(found, corpus.query("Phonetic == n"), lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]}), "n bigint")
    assert [r.n for r in pairs.collect()] == [6]


def test_parameters_follow_metadata(corpus):
    found = quantify.with_metadata(corpus, corpus.query("Phonetic == a"), ["Gender", "Age"])
    rows = {r.bundle: (r.nominalF1, r.maxFormantHz) for r in quantify.derive_parameters(found, ["Gender", "Age"]).collect()}
    assert rows == {"B1": (1000, 10000), "B2": (1000, 10000), "B3": (530, 5300)}
    rows = quantify.derive_parameters(found, ["Gender", "Age"], {"nominalF1": 450}).collect()
    assert {(r.nominalF1, r.maxFormantHz) for r in rows} == {(450, 4500)}


def test_hierarchy(corpus):
    h = corpus.hierarchy
    assert h.path("Word", "Phonetic") == ["Word", "Syllable", "Phoneme", "Phonetic"] and h.path("Tone", "Word") is None
    assert h.segment_levels("Accent") == ["Phonetic"] and h.problems() == []
    assert ["Word", "Syllable", "Tone"] in h.all_paths()
    with pytest.raises(ValueError):
        h.without_level("Word")


def test_metadata_and_configuration_are_written_back(spark, corpus, tmp_path):
    (tmp_path / "S1_ses" / "B1_bndl").mkdir(parents=True)
    (tmp_path / "S1_ses" / "B1_bndl" / "METADATA.json").write_text('[{"Speaker": "old", "Kept": 1}]')
    changed = corpus.set_metadata(session="^S1$", bundle="^B2$", Count=3, Done=True)
    assert annot_json.write_metadata(changed, str(tmp_path)).count() >= 3
    b1, b2 = (json.loads((tmp_path / "S1_ses" / f"{b}_bndl" / "METADATA.json").read_text()) for b in ("B1", "B2"))
    assert b1["Speaker"] == "S001" and b1["Kept"] == 1 and b2["Count"] == 3 and b2["Done"] is True
    read = annot_json.metadata_tables(spark, str(tmp_path), "fx-0001")
    want = {(r.session, r.field_name, r.field_value) for r in corpus.meta_session.collect()}
    assert {(r.session, r.field_name, r.field_value) for r in read["meta_session"].collect()} == want
    assert annot_json.write_config(changed, str(tmp_path)).endswith("fx_DBconfig.json")
    assert annot_json.read_config(spark, str(tmp_path))["UUID"] == "fx-0001"


def test_several_configurations_are_an_error(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}_DBconfig.json").write_text("{}")
    with pytest.raises(ValueError, match="several"):
        annot_json.read_config(spark, str(tmp_path))


def test_databases_are_kept_apart(corpus):
    tables = {}
    for name in ("bundles", "items", "labels", "links", "meta_bundle", "meta_session", "meta_database"):
        table = getattr(corpus, name)
        again = table.withColumn("db_uuid", F.lit("fx-0002"))
        tables[name] = table.unionByName(again.withColumn("field_value", F.lit("70")) if name.startswith("meta_") else again)
    both = corpus.replace(**tables)
    ages = {(r.db_uuid, r.bundle): r.value for r in metadata.field(both, "Age").collect()}
    assert ages["fx-0001", "B1"] == "9" and ages["fx-0002", "B1"] == "70" and len(ages) == 6
    found = both.query("Phonetic == a")
    got = quantify.with_metadata(both, found, ["Age"])
    assert got.count() == found.count() and {(r.db_uuid, r.Age) for r in got.where("bundle = 'B1'").collect()} == {("fx-0001", "9"), ("fx-0002", "70")}
