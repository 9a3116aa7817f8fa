"""The pipeline's stages, one after another, against plain Python on planted documents."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tiergraph.llm import queries
from tiergraph.llm.decontaminate import report
from tiergraph.llm.simhash import near_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_queries_give_a_row_for_each_input_row(spark, name):
    n = queries.QUERIES[name](spark, SF).count()
    table = {"op6_main_text": "pages"}.get(name, "documents")
    want = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert n >= want if name == "op8_packing" else n == want


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7)))
    text = lambda n=80: " ".join(word() for _ in range(n))
    passage = " ".join(f"bench{k}" for k in range(20))
    rows, labels, kind = [], [], {}
    for k in range(300):
        bad = k % 6 == 0
        rows.append((k, text() + (" grobnak sloven vilest" if bad else "")))
        labels.append((k, 1, int(bad)))
        kind[k] = "toxic" if bad else "clean"
    rows += [(400, rows[1][1]), (401, rows[1][1]), (402, text() + " " + passage + " " + text(20)), (403, None), (404, "")]
    folder = tmp_path_factory.mktemp("planted")
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    write("documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write("labels", labels, "doc_id bigint, quality int, toxic int")
    write("benchmark", [(1, passage)], "item_id bigint, text string")
    return str(folder), dict(rows), kind


def test_stages(spark, planted):
    folder, texts, kind = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {k for k, v in kind.items() if v == "clean"} | {400, 401, 402, 403, 404}
    assert set(kept["toxicity"]) == clean
    # 1, 400 and 401 are one text, and so are null and empty
    assert set(kept["exact_dedup"]) == clean - {1, 400, 403}
    before = spark.read.parquet(f"{folder}/exact_dedup.parquet")
    first = {r.component_id for r in near_components(before).collect()}
    assert set(kept["simhash_near_dedup"]) == first
    last = kept["decontamination"]
    assert set(last) == first and all(last[k] == texts[k] for k in last if k != 402)
    assert "bench" not in last[402] and len(last[402].split()) == 100
    assert report(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").count() == 0
    assert all(r.n_chars == len(r.text or "") for r in docs.where("doc_id = 402").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(last)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


CLASHING = ["fp", "component_id", "digest", "h", "score", "_row", "keep_id", "n"]


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_with_odd_tables(spark, tmp_path, kind):
    """No rows at all, or null and repeated ids, null texts, repeated rows and a hot text, with names used inside."""
    rows = [(None, "one two three"), (None, None), (1, None), (1, "one two three"), (1, "one two three"), (2, ""), (3, "w " * 30_000)]
    rows += [(k, "the same text in a third of all rows") for k in range(10, 30)]
    docs = spark.createDataFrame(rows if kind == "odd" else [], "doc_id bigint, text string")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}.parquet"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", *CLASHING]
    texts = sorted(r.text or "" for r in docs.collect())
    assert texts == (sorted({t or "" for _, t in rows}) if kind == "odd" else [])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == (docs.select("doc_id").distinct().count())
