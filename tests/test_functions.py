import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiergraph.functions import prosody, scalars
from tiergraph.functions.patterns import glob_to_regex, label_glob
from tiergraph.operators import drafts, simulate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sizes(spark):
    for n, text in ((500, "500.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (int(2.5 * 1024**2), "2.50 MB"), (1024**4, "1.00 TB"), (0, "0 B"), (None, "0 B")):
        assert one(spark, scalars.format_bytes(F.lit(n).cast("bigint"))) == text
    for text, n in (("1.5 KB", 1536), ("1 mb", 1048576), ("500kb", 512000), ("2 TB", 2 * 1024**4), ("7 XB", None)):
        assert one(spark, scalars.parse_size(F.lit(text))) == n
    assert one(spark, scalars.format_duration(F.lit(3725.9))) == "01:02:05"


def test_scales(spark):
    assert one(spark, scalars.semitones(F.lit(32.7032))) == pytest.approx(12)
    assert one(spark, scalars.octave(F.lit(-1.0))) == 0
    assert [one(spark, scalars.frame_index(F.lit(x), F.lit(10))) for x in (0.0, 0.25, 0.5, 0.75, 1.0)] == [1, 2, 5, 8, 10]
    assert one(spark, scalars.without_glitches(F.array(*map(F.lit, (100.0, 120.0, 100.0, 101.0))))) == [100, 0, 100, 101]
    assert one(spark, scalars.merge_maps(F.expr("map('a','1','b','2')"), F.expr("map('b',null,'c','3')"))) == {"a": "1", "c": "3"}
    assert one(spark, scalars.bandwidth(F.lit(500.0), F.lit(132.0))) == pytest.approx(15.8146139 + 0.0810159009 * 500 - 9.79728215e-5 * 500**2 + 5.28725064e-8 * 500**3 - 1.07099364e-11 * 500**4 + 7.91528509e-16 * 500**5)
    assert one(spark, scalars.formant_correction(F.lit(0.0), F.lit(500.0), F.lit(80.0), F.lit(16000.0))) == pytest.approx(0)


@pytest.mark.parametrize("pattern,yes,no", [("*", ["", "x\ny"], []), ("a?c", ["abc"], ["ac", "abbc"]), ("*[^b]*", ["a", "bc"], ["b", ""]), ("a.b", ["a.b"], ["axb"]), ("[a]]", ["a]"], ["a"])])
def test_globs(pattern, yes, no):
    found = re.compile(glob_to_regex(pattern))
    assert all(found.match(x) for x in yes) and not any(found.match(x) for x in no)


def test_label_patterns():
    assert label_glob(".*") == "*?**"


def test_hashes_ignore_order(spark):
    assert simulate.hash_parameters({"a": 1, "b": 2}) == simulate.hash_parameters({"b": 2, "a": 1}) != simulate.hash_parameters({"a": 1}, {"b": 2})
    counts = [simulate.parameter_grid(spark, *x).count() for x in (({"param1": [1, 2, 3], "param2": ["a", "b"]},), ({}, {"r": [1, 2], "f": ["w", "m"]}), ({"f1": [1, 2, 3]}, {"r": [1, 2]}), ({},))]
    assert counts == [6, 4, 6, 0]


def test_sweeps_are_stored_by_point(spark, tmp_path):
    found = spark.createDataFrame([("s", "b", k, float(k)) for k in range(4)], "session string, bundle string, start_item_id bigint, start double")
    grid = simulate.parameter_grid(spark, {"k": [1, 2]})
    simulate.save(simulate.quantify_grid(found, grid, lambda seg, k: {"v": seg["start"] * k}, "v double"), grid, str(tmp_path / "a"), "times")
    assert sorted(r.v for r in simulate.reminisce(spark, str(tmp_path / "a"), {"k": 2}).collect()) == [0, 2, 4, 6]
    assert [r.n_points for r in simulate.list_simulations(spark, str(tmp_path)).collect()] == [2]


def test_drafts_resume(spark, tmp_path):
    bundles = spark.createDataFrame([("s", "a"), ("s", "b")], "session string, bundle string")
    seen = []

    def draft(todo):
        seen.append(sorted(r.bundle for r in todo.collect()))
        return todo.withColumn("level", F.lit("T")).withColumn("error", F.when(F.col("bundle") == "b", "failed"))

    for _ in range(2):
        out = drafts.resume(bundles, str(tmp_path / "d"), draft)
    assert seen == [["a", "b"], ["b"]] and out.count() == 2
    assert [(r.n, r.n_done) for r in drafts.draft_summary(out).collect()] == [(2, 1)]


def test_eviction_takes_the_oldest_quarter(spark):
    cache = spark.range(8).select(F.col("id").cast("string").alias("cache_key"), F.col("id").alias("accessed_at"), F.lit(10).alias("size_bytes"))
    assert sorted(int(r.cache_key) for r in drafts.evict(cache, 50).collect()) == [2, 3, 4, 5, 6, 7]
    assert drafts.evict(cache, 500).count() == 8


def test_targets_and_tones():
    f0 = np.concatenate([120 + 60 * np.sin(np.linspace(0, np.pi, 60)), 180 - 40 * np.sin(np.linspace(0, np.pi, 60))])
    targets = prosody.pitch_targets(f0)
    assert 2 <= len(targets) < 20 and any(abs(hz - 180) < 12 and 20 < t < 40 for t, hz in targets)
    made = prosody.tones(targets)
    assert len(made["targets"]) == len(targets) and made["targets"][0]["tone"] in "TMB" and 0.5 <= made["range"] <= 2.4
    assert prosody.pitch_targets([]) == [] and prosody.tones([])["targets"] == []
    assert list(prosody.smooth(np.array([100.0, 120.0, 100.0]))) == [100, 0, 100]


def test_tone_udf(spark):
    df = spark.createDataFrame([([120.0] * 40 + [200.0] * 40,), ([],), (None,)], "f0 array<double>")
    assert [r.x.key is not None for r in df.select(prosody.intsint("f0").alias("x")).collect()] == [True] * 3


def test_speaker_parameters(spark):
    from tiergraph.operators import speaker_parameters

    rows = [("Male", 20, 40, "minF", 60.0, 30), ("Male", 41, 60, "minF", 70.0, 5), ("Female", 20, 22, "minF", 100.0, 10), ("Female", 26, 28, "minF", 100.0, None), ("Male", 20, 60, "nominalF1", 500.0, 3), ("Male", None, 5, "minF", 1.0, 1)]
    defaults = spark.createDataFrame(rows, "gender string, age_lower int, age_upper int, parameter string, setting double, participants int")
    got = {(r.gender, r.age): r for r in speaker_parameters.table(defaults, ["minF", "nominalF1", "nominalF2", "windowSize"]).collect()}
    assert {g for g, _ in got} == {"Male", "Female", "Unspecified"}
    assert (got["Female", 24].minF, got["Female", 24].windowSize) == (100, 20) and got["Female", 24].nominalF1 is None
    assert got["Male", 30].nominalF1 == 500 and got["Male", 30].nominalF2 == 1500 and 55 <= got["Male", 25].minF <= got["Male", 55].minF <= 75
    assert speaker_parameters.table(defaults.limit(0), ["minF"]).count() == 0
