"""What goes on around a corpus folder: tracks, annotators, drafts, batches, documents and keeping them up to date."""

import datetime as dt
import shutil

import numpy as np
import pandas as pd
import pytest
from corpus_files import write
from pyspark.sql import functions as F

from tiergraph.corpus import COMMITTED, Corpus
from tiergraph.operators import annotate, drafts, metadata, simulate, summary, transcribe
from tiergraph.sources import annot_json, eaf, tracks
from tiergraph.streaming import sync


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "fx").mkdir()
    return write(tmp_path / "fx")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    made = annot_json.read_corpus(spark, write(tmp_path_factory.mktemp("fx")))
    return made.save(str(tmp_path_factory.mktemp("store")))


def test_track_files_come_back(spark, folder, tmp_path):
    values = np.arange(600).reshape(300, 2)
    text = tracks.ssff(100.0, 0.005, {"fm": ("SHORT", values), "rms": ("DOUBLE", values[:, 0] / 4)})
    assert tracks.parse_ssff(text)[2]["fm"].tolist() == values.tolist()
    with pytest.raises(ValueError):
        tracks.parse_ssff(b"RIFF")
    for bundle in ("B1", "B2"):
        with open(f"{folder}/S1_ses/{bundle}_bndl/{bundle}.fms", "wb") as out:
            out.write(text)
    found = tracks.read_tracks(spark, folder, "fms")
    assert found.count() == 1200
    assert tracks.read_tracks(spark, folder, "fms", ["fm"]).count() == 600
    stored = tracks.save(found, str(tmp_path / "tracks"))
    rows = tracks.between(stored, 10, 30, "fm").where("bundle = 'B1'").orderBy("t").collect()
    assert [(r.frame, r.t, r.values) for r in rows] == [(2, 15.0, [2.0, 3.0]), (3, 25.0, [4.0, 5.0])]
    assert {(r.bundle, r.n) for r in tracks.between(stored, 0).groupBy("bundle").agg(F.count("*").alias("n")).collect()} == {("B1", 600), ("B2", 600)}


def test_frames_of_segments(spark):
    at = spark.createDataFrame([("s", "b", float(t), t) for t in range(0, 5000, 100)], "session string, bundle string, t double, v int")
    found = spark.createDataFrame([("s", "b", 1, 900.0, 2100.0), ("s", "b", 2, 50.0, 60.0), ("s", "x", 3, 0.0, 100.0), ("s", "b", 4, 100.0, 100.0), ("s", "b", 5, None, None)], "session string, bundle string, id int, start double, end double")
    rows = tracks.of_segments(found, at, ["id"]).collect()
    assert sorted((r.id, r.v) for r in rows) == [(1, t) for t in range(900, 2200, 100)] + [(4, 100)]


@pytest.mark.parametrize(("start", "end", "cut", "n", "last", "window"), [(512, 522, 0.4, 3, None, (514, 516)), (512, 522, 0.4, 2, None, (515, 516)), (512, 525, 0.4, 3, None, (516, 518)), (1, 525, 0.0, 3, None, (1, 3)), (1, 525, 1.0, 3, None, (524, 526)), (1, 525, 1.0, 3, 525, (523, 525))])
def test_sample_window(spark, start, end, cut, n, last, window):
    row = spark.range(1).select(tracks.sample_window(F.lit(start), F.lit(end), F.lit(cut), F.lit(n), F.lit(last) if last else None).alias("x")).first()
    assert tuple(row.x) == window


def test_segments_without_a_file_go(spark, corpus, folder):
    files = annot_json.signals(spark, folder)
    assert tracks.with_signal(corpus.query("Phonetic == a"), files, "wav").count() == 4
    assert tracks.with_signal(corpus.query("Phonetic == a"), files.where("bundle = 'B1'"), "wav").count() == 2
    assert tracks.with_signal(corpus.query("Phonetic == a"), files, "flac").count() == 0


FILES = "db_uuid string, session string, bundle string, f0 array<double>, pulses array<double>, intensity_times array<double>, intensity array<double>"


def files(spark):
    wave = [float(150 + 40 * np.sin(k / 9)) for k in range(120)]
    rows = [("fx-0001", "S1", "B1", wave, [0.01, 0.02, 0.9], [0.0, 0.1], [60.0, 70.0]), ("fx-0001", "S1", "B2", wave[:60], [], [], []), ("fx-0001", "S2", "nope", wave, [], [], [])]
    return spark.createDataFrame(rows, FILES)


def test_periods_are_labelled_with_intensity(spark, corpus):
    found, failed = annotate.draft_periods(corpus, files(spark))
    assert [(r.bundle, r.start_time, r.end_time, r.label, r.type) for r in found.orderBy("start_time").collect()] == [("B1", 10.0, 10.0, "61.00", "EVENT"), ("B1", 20.0, 20.0, "62.00", "EVENT"), ("B1", 900.0, 900.0, "", "EVENT")]
    assert failed.count() == 0


def test_tones_are_drafted_and_written(spark, corpus):
    made, log, failed = annotate.annotate_tones(corpus, files(spark), force=True)
    added = made.query("Intsint =~ .*").collect()
    assert added and {r.labels for r in added} <= set(annotate.TONES) and {r.bundle for r in added} == {"B1", "B2"}
    assert log.added.count() == len(added) and failed.count() == 0
    assert transcribe.reverse(made, log).items.count() == corpus.items.count()
    with pytest.raises(ValueError):
        annotate.draft(corpus, files(spark).unionByName(files(spark)), annotate.periods, "Period")


def test_drafts_are_kept_and_failures_tried_again(spark, corpus, tmp_path):
    tried, path = tmp_path / "tried", drafts.draft_path(str(tmp_path), "draft_words", dt.date(2024, 5, 6))
    tried.mkdir()

    def words(row, fail):
        (tried / f"{row['bundle']}{len(list(tried.iterdir()))}").touch()
        if fail and row["bundle"] == "B2":
            raise RuntimeError("no sound")
        return pd.DataFrame({"start_time": [1.0], "end_time": [2.0], "label": ["x"]})

    found, failed = annotate.draft(corpus, files(spark), words, "Phonetic", "SEGMENT", path, {"fail": True})
    assert [r.bundle for r in found.collect()] == ["B1"] and [(r.bundle, r.error) for r in failed.collect()] == [("B2", "RuntimeError: no sound")]
    found, failed = annotate.draft(corpus, files(spark), words, "Phonetic", "SEGMENT", path, {"fail": False})
    assert sorted(r.bundle for r in found.collect()) == ["B1", "B2"] and failed.count() == 0
    assert len(list(tried.glob("B1*"))) == 1 and len(list(tried.glob("B2*"))) == 2
    other = drafts.draft_path(str(tmp_path), "tones", dt.date(2024, 6, 1))
    annotate.draft(corpus, files(spark), words, "Phonetic", "SEGMENT", other, {"fail": False})
    assert [x["function"] for x in drafts.draft_stores(spark, str(tmp_path))] == ["tones", "words"]
    drafts.mark_completed(spark, path)
    keys = ["db_uuid", "session", "bundle"]
    rows = drafts.list_drafts(spark, str(tmp_path), corpus.bundles.withColumnRenamed("name", "bundle"), keys).orderBy("date").collect()
    assert [(r.function, r.completed, r.n_completed, r.n_total) for r in rows] == [("words", True, 2, 3), ("tones", False, 2, 3)]
    assert [x["function"] for x in drafts.draft_stores(spark, str(tmp_path), "draft_words")] == ["words"]


def test_annotate_tags_rows_and_goes_on_after_errors(spark):
    def one(row):
        if row["bundle"] == "B2":
            raise KeyError("gone")
        return {"start_time": [0.0], "end_time": [1.0], "label": [row["bundle"]]}

    rows = annotate.annotate(files(spark), one).collect()
    assert sorted((r.bundle, r.label, r.error is None) for r in rows if r.label) == [("B1", "B1", True), ("nope", "nope", True)]
    assert [r.error for r in rows if r.bundle == "B2"] == ["KeyError: 'gone'"]
    assert annotate.annotate(files(spark), lambda row: {"start_time": [], "end_time": [], "label": []}).count() == 0


def test_caches_are_managed(tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.bin").write_bytes(b"12345")
    (tmp_path / "q" / "b.bin").write_bytes(b"1234567")
    where = {"quantify": str(tmp_path / "q"), "draft": str(tmp_path / "none")}
    assert [(x["kind"], x["bytes"], x["status"]) for x in drafts.manage(where)] == [("quantify", 12, "ok"), ("draft", 0, "ok")]
    assert [x[2] for x in drafts.manage(where, "list")] == [7, 5]
    later = dt.datetime.now() + dt.timedelta(days=40)
    assert len(drafts.manage(where, "clean", today=later)) == 2 and len(drafts.manage(where, "list")) == 2
    drafts.manage(where, "clean", dry_run=False, today=later)
    assert drafts.manage(where, "list") == []
    for wrong in ({"action": "burn"}, {"kind": "x"}, {"days": 0}):
        with pytest.raises(ValueError):
            drafts.manage(where, **wrong)


def test_batches_are_added_whole_or_not_at_all(spark, corpus, tmp_path):
    def only(bundles):
        here = F.col("bundle").isin(bundles)
        tables = {n: getattr(corpus, n).where(here) for n in ("items", "labels", "links", "meta_bundle")}
        return corpus.replace(bundles=corpus.bundles.where(F.col("name").isin(bundles)), **tables)

    path = str(tmp_path / "store")
    only(["B1"]).save(path)
    both = only(["B2"]).append_to(path)
    assert {r.bundle: r.n for r in both.query("Phonetic == a").groupBy("bundle").agg(F.count("*").alias("n")).collect()} == {"B1": 2, "B2": 1}
    with pytest.raises(ValueError, match="stored already"):
        only(["B2", "B3"]).append_to(path)
    whole = only(["B3"]).append_to(path)
    for name in ("bundles", "items", "labels", "links", "nodes"):
        assert getattr(whole, name).count() == getattr(corpus, name).count()
    batch = next(d for d in (tmp_path / "store" / "batches").iterdir() if spark.read.parquet(str(d / "bundles")).first()["name"] == "B3")
    (batch / COMMITTED).unlink()  # as if the writer had been lost
    assert sorted(r.name for r in Corpus.load(spark, path).bundles.collect()) == ["B1", "B2"]
    with pytest.raises(ValueError, match="added batches"):
        whole.save(path)
    gathered = Corpus.load(spark, path).save(str(tmp_path / "gathered"))
    assert gathered.query("Phonetic == a").count() == 3


def test_documents_hold_what_is_in_time(corpus):
    rows = {r.bundle: eaf.read(r.eaf) for r in eaf.documents(corpus).collect()}
    assert [x for x in rows["B2"] if x[0] == "Phonetic"] == [("Phonetic", 0, 60, "t"), ("Phonetic", 60, 190, "a"), ("Phonetic", 190, 300, "n")]
    assert [x for x in rows["B2"] if x[0] in ("Word", "Syllable")] == [("Syllable", 0, 300, "S"), ("Word", 0, 300, "tan")]
    assert [x for x in rows["B1"] if x[0] == "Tone"] == [("Tone", 100, 101, "H*"), ("Tone", 650, 651, "L-")]
    assert [x for x in rows["B1"] if x[0] == "Word"] == [("Word", 0, 260, "cat"), ("Word", 260, 700, "sunny")]
    assert {x[0] for x in eaf.read(next(r.eaf for r in eaf.documents(corpus, False).collect() if r.bundle == "B2"))} == {"Phonetic"}


def test_a_folder_is_kept_up_to_date(spark, folder, tmp_path):
    assert sync.check(spark, folder) is None and sync.load_config(folder) is None
    sync.enable(folder)
    with pytest.raises(ValueError):
        sync.enable(folder, colour="red")
    first = sync.check(spark, folder)
    assert first == {"changes": 7, "eaf": 3, "cmdi": 1}
    assert (tmp_path / "fx" / "S1_ses" / "B1_bndl" / "B1.eaf").exists() and (tmp_path / "fx" / "fx.cmdi").exists()
    assert sync.check(spark, folder) == {"changes": 0, "eaf": 0, "cmdi": 0}
    annot = tmp_path / "fx" / "S1_ses" / "B2_bndl" / "B2_annot.json"

    def change(folder):
        annot.write_text(annot.read_text().replace('"tan"', '"ten"'))
        return "done"

    assert sync.then_check(spark, folder, change) == "done"
    assert ("Word", 0, 300, "ten") in eaf.read((annot.parent / "B2.eaf").read_text())
    assert sync.run(spark, folder, force=True)["eaf"] == 3
    sync.add_session(spark, folder, "S9")
    assert (tmp_path / "fx" / "S9_ses").is_dir()
    sync.remove_session(spark, folder, "S2")
    assert not (tmp_path / "fx" / "S2_ses").exists() and "<Sessions>1</Sessions>" in (tmp_path / "fx" / "fx.cmdi").read_text()
    for wrong in ("", "../x", "."):
        with pytest.raises(ValueError):
            sync.remove_session(spark, folder, wrong)
    corpus = annot_json.read_corpus(spark, folder)
    sync.update_config(spark, transcribe.prepare(corpus, "Extra", "EVENT"), folder)
    assert "Extra" in (tmp_path / "fx" / "fx.cmdi").read_text()
    sync.enable(folder, False)
    assert sync.check(spark, folder) is None


def test_digests_and_clearing(spark, corpus, folder):
    made = metadata.add_digests(corpus, annot_json.signal_hashes(spark, folder, "*.wav"))
    rows = made.meta_bundle.where("field_name = 'signal_hashes'").collect()
    assert sorted(r.bundle for r in rows) == ["B1", "B2", "B3"] and "sha1" in rows[0].field_value
    assert metadata.add_digests(made, annot_json.signal_hashes(spark, folder, "*.wav")).meta_bundle.count() == made.meta_bundle.count()
    assert metadata.clear(made, bundle="B1").meta_bundle.where("bundle = 'B1'").isEmpty()
    assert metadata.clear(corpus, session="S1").meta_session.isEmpty() and metadata.clear(corpus).meta_database.isEmpty()
    assert metadata.clear(corpus, session="S2").meta_session.count() == corpus.meta_session.count()


def test_results_are_previewed_as_rows(corpus):
    found = corpus.query("Phonetic == a")
    rows = {r.column: (r.rows, r.n, r.n_values) for r in summary.overview(found).collect()}
    assert rows["labels"] == (4, 4, 1) and rows["bundle"] == (4, 4, 3) and len(rows) == len(found.columns)
    assert summary.plan_of(found)["joins"] == 0 and summary.plan_of(corpus.query("[Syllable == S ^ Phoneme == n]"))["joins"] > 0
    words = next(r for r in summary.glimpse(corpus, 2).collect() if r.level == "Word")
    assert (words.n_items, words.n_labels, words.examples) == (5, 5, ["a", "cat"])
    listed = summary.bundle_overview(corpus.metadata(), ["Speaker"]).orderBy("session").collect()
    assert [(r.session, r.n_bundles, r.n_Speaker) for r in listed] == [("S1", 2, 1), ("S2", 1, 0)]


def test_stored_tracks_of_a_sweep(spark, tmp_path):
    listed = spark.createDataFrame([("S1", "B1", 2.0), ("S2", "B2", 3.0)], "session string, bundle string, x double")
    grid = simulate.parameter_grid(spark, {"k": [1, 2]})
    made = simulate.enrich_grid(listed, grid, lambda row, k: {"v": [row["x"] * k]}, "v double")
    simulate.save(made, grid, str(tmp_path / "a"), "mul")
    assert [r.track[0].v for r in simulate.reminisce_tracks(spark, str(tmp_path / "a"), {"k": 2}, session="2$").collect()] == [6.0]
    assert simulate.reminisce_tracks(spark, str(tmp_path / "a"), {"k": 1}).count() == 2
    with pytest.raises(KeyError):
        simulate.reminisce_tracks(spark, str(tmp_path / "a"), {"k": 3})
    assert [(r.function, r.n_points, r.path.rsplit("/", 1)[1]) for r in simulate.list_simulations(spark, str(tmp_path)).collect()] == [("mul", 2, "a")]
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    for file in (tmp_path / "b" / "meta").glob("*.parquet"):
        file.write_bytes(b"not a table")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert [r.function for r in simulate.list_simulations(spark, str(tmp_path)).collect()] == ["mul"]
    assert simulate.list_simulations(spark, str(tmp_path / "none")).isEmpty()
