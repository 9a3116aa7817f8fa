"""Corpora as folders: `<session>_ses/<bundle>_bndl/<bundle>_annot.json`, with metadata files at three levels."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..plans.hierarchy import Hierarchy
from ..schemas import ANNOTATION, KEYS

SESSION = r"([^/]*)_ses/"
BUNDLE = r"_ses/([^/]*)_bndl/"


def _texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, value, session, bundle) of whole files; session and bundle are empty above their level."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.expr("url_decode(_metadata.file_path)")
    return read.select(path.alias("path"), "value").select("path", "value", F.regexp_extract("path", SESSION, 1).alias("session"), F.regexp_extract("path", BUNDLE, 1).alias("bundle"))


def read_config(spark: SparkSession, folder: str) -> dict:
    """The corpus's configuration: one small file. A folder with several is an error, as it is of several databases."""
    rows = spark.read.option("pathGlobFilter", "*_DBconfig.json").text(folder, wholetext=True).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"{folder} holds several configurations: read the folder of each database by itself")
    return json.loads(rows[0].value) if rows else {}


def annotations(spark: SparkSession, folder: str, uuid: str) -> DataFrame:
    """A row per annotation file: keys, parsed content and digest; annotation is null where a file can't be parsed."""
    found = _texts(spark, folder, "*_annot.json")
    parsed = F.from_json("value", ANNOTATION, {"mode": "PERMISSIVE"})
    parsed = F.when(parsed["levels"].isNotNull() | parsed["annotates"].isNotNull(), parsed)
    return found.select(F.lit(uuid).alias("db_uuid"), "session", "bundle", "path", parsed.alias("annotation"), F.md5("value").alias("md5_annot_json"))


def tables(read: DataFrame) -> dict[str, DataFrame]:
    """bundles, items, labels and links of parsed annotations. Positions count from 1 and count skipped items."""
    good = read.where("annotation IS NOT NULL")
    bundles = good.select("db_uuid", "session", F.col("bundle").alias("name"), "annotation.annotates", F.col("annotation.sampleRate").alias("sample_rate"), "md5_annot_json")
    level = good.select(*KEYS, F.col("annotation.sampleRate").alias("sample_rate"), F.explode("annotation.levels").alias("level")).where("level.name IS NOT NULL AND level.type IS NOT NULL")
    item = level.select(*KEYS, "sample_rate", F.col("level.name").alias("level"), F.col("level.type").alias("type"), F.posexplode("level.items").alias("pos", "item")).where("item.id IS NOT NULL")
    items = item.select(
        *KEYS, F.col("item.id").alias("item_id"), "level", "type", (F.col("pos") + 1).alias("seq_idx"), "sample_rate", F.col("item.samplePoint").alias("sample_point"), F.col("item.sampleStart").alias("sample_start"), F.col("item.sampleDur").alias("sample_dur")
    )
    label = item.select(*KEYS, F.col("item.id").alias("item_id"), F.posexplode("item.labels").alias("pos", "label")).where("label.name IS NOT NULL")
    labels = label.select(*KEYS, "item_id", (F.col("pos") + 1).alias("label_idx"), F.col("label.name").alias("name"), F.coalesce("label.value", F.lit("")).alias("label"))
    link = good.select(*KEYS, F.explode("annotation.links").alias("link")).where("link.fromID IS NOT NULL AND link.toID IS NOT NULL")
    links = link.select(*KEYS, F.col("link.fromID").alias("from_id"), F.col("link.toID").alias("to_id"), F.col("link.label").alias("label"))
    return {"bundles": bundles, "items": items, "labels": labels, "links": links}


def metadata_tables(spark: SparkSession, folder: str, uuid: str) -> dict[str, DataFrame]:
    """Values of METADATA.json and .meta_json files, at the level of the folder that they are in; unreadable files give none."""
    found = _texts(spark, folder, "{METADATA.json,*.meta_json}")
    # a file is an object, or an array of one
    one = F.regexp_replace(F.regexp_replace("value", r"^\s*\[", ""), r"\]\s*$", "")
    pairs = found.select(F.lit(uuid).alias("db_uuid"), "session", "bundle", F.explode(F.from_json(one, "map<string,string>")).alias("field_name", "field_value"))
    value = F.col("field_value")
    kind = (
        F.when(value.rlike(r"^(true|false)$"), "logical").when(value.rlike(r"^-?\d+$"), "integer").when(value.rlike(r"^-?\d*\.\d+([eE][-+]?\d+)?$"), "numeric")
        .when(value.rlike(r"^\d{4}-\d\d-\d\d$"), "date").when(value.rlike(r"^\d{4}-\d\d-\d\dT"), "datetime").otherwise("character")
    )
    pairs = pairs.withColumn("field_type", kind).withColumn("field_value", F.when(F.col("field_type") == "logical", F.upper("field_value")).otherwise(value))
    names = ["field_name", "field_value", "field_type"]
    return {
        "meta_bundle": pairs.where("bundle != ''").select(*KEYS, *names),
        "meta_session": pairs.where("bundle = '' AND session != ''").select("db_uuid", "session", *names),
        "meta_database": pairs.where("session = ''").select("db_uuid", *names),
    }


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """A corpus folder as lazy tables; save() it for queries."""
    config = read_config(spark, folder)
    uuid = config.get("UUID", "")
    return Corpus.of(spark, Hierarchy.from_config(config), config, **tables(annotations(spark, folder, uuid)), **metadata_tables(spark, folder, uuid))


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation files that can't be parsed."""
    return annotations(spark, folder, "").where("annotation IS NULL").select("session", "bundle", "path")


def write_back(corpus: Corpus) -> DataFrame:
    """(db_uuid, session, bundle, json): annotation files from tables, the inverse of reading. Empty levels are written too."""
    label = F.struct(F.col("name").alias("name"), F.col("label").alias("value"))
    labels = corpus.labels.groupBy(*KEYS, "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label_idx", label.alias("x")))), lambda p: p["x"]).alias("labels"))
    item = F.struct(F.col("item_id").alias("id"), F.col("sample_point").alias("samplePoint"), F.col("sample_start").alias("sampleStart"), F.col("sample_dur").alias("sampleDur"), "labels")
    items = corpus.items.join(labels, [*KEYS, "item_id"], "left")
    levels = items.groupBy(*KEYS, "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq_idx", "item_id", item.alias("x")))), lambda p: p["x"]).alias("items"))
    # every level of the hierarchy, in its order
    defined = [F.struct(F.lit(k).alias("k"), F.lit(x.name).alias("level"), F.lit(x.type).alias("type")) for k, x in enumerate(corpus.hierarchy.levels)]
    bundles = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"), "annotates", "sample_rate")
    every = bundles.select(*KEYS, F.explode(F.array(*defined)).alias("x")).select(*KEYS, "x.*").join(levels, [*KEYS, "level"], "left")
    level = F.struct(F.col("level").alias("name"), "type", F.coalesce("items", F.from_json(F.lit("[]"), levels.schema["items"].dataType)).alias("items"))
    whole = every.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", level.alias("x")))), lambda p: p["x"]).alias("levels"))
    link = F.struct(F.col("from_id").alias("fromID"), F.col("to_id").alias("toID"), "label")
    links = corpus.links.groupBy(*KEYS).agg(F.array_sort(F.collect_list(link)).alias("links"))
    out = bundles.join(whole, KEYS).join(links, KEYS, "left")
    none = F.from_json(F.lit("[]"), links.schema["links"].dataType)
    body = F.struct(F.col("bundle").alias("name"), "annotates", F.col("sample_rate").alias("sampleRate"), "levels", F.coalesce("links", none).alias("links"))
    return out.select(*KEYS, F.to_json(body, {"ignoreNullFields": "true"}).alias("json"))


def signals(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(session, bundle, name, extension, full_path) of files in bundles; contents are read only for digests."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.expr("url_decode(path)")
    parts = [F.regexp_extract(path, SESSION, 1).alias("session"), F.regexp_extract(path, BUNDLE, 1).alias("bundle"), F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).alias("name"), F.regexp_extract(path, r"\.([^./]*)$", 1).alias("extension"), path.alias("full_path")]
    return found.select(*parts, *([F.sha1("content").alias("sha1")] if content else [])).where("bundle != '' AND NOT endswith(full_path, '.json')")


def signal_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Per bundle, its files' digests as a JSON list: the metadata field signal_hashes."""
    hashed = file_digests(signals(spark, folder, pattern, content=True), ["session", "bundle"], ["name", "extension"])
    return hashed.select("session", "bundle", F.lit("signal_hashes").alias("field_name"), "field_value", F.lit("json").alias("field_type"))


def file_digests(files: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, field_value): the files of each bundle with the SHA-1 of their content, as a JSON list."""
    digest = F.col("sha1") if "sha1" in files.columns else F.sha1("content")
    rows = F.array_sort(F.collect_list(F.struct(*names, digest.alias("sha1"))))
    return files.groupBy(*keys).agg(F.to_json(rows).alias("field_value"))


def interval_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of intervals, `tmin;tier;text;tmax;segment`."""
    return spark.read.csv(path, sep=";", header=True, schema="tmin double, tier string, text string, tmax double, segment string")


def _put(uri: str, text: str) -> None:
    """Write a small file whole: under another name first, so that a reader never sees half of it."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.new") as out:
        out.write(text.encode())
    fs.move(f"{path}.new", path)


def _get(uri: str) -> dict:
    """The object in a JSON file, or in an array of one; empty if there is none."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    if fs.get_file_info(path).type != pafs.FileType.File:
        return {}
    with fs.open_input_stream(path) as read:
        found = json.loads(read.read() or b"{}")
    return (found[0] if found else {}) if isinstance(found, list) else found


def _json_value(value: str | None, tag: str | None):
    if value is None or tag == "NULL":
        return None
    try:
        return {"integer": int, "numeric": float, "logical": lambda v: v.upper() == "TRUE", "json": json.loads}.get(tag, str)(value)
    except ValueError:  # text that isn't of its type stays text
        return value


def write_metadata(corpus: Corpus, folder: str, merge: bool = True) -> DataFrame:
    """Write the values set at each level to METADATA.json in its folder; (path, fields) of the files written.

    Files are written by the tasks, when the result is asked for; a task that runs again writes the same.

    With merge, fields that a file has and the corpus doesn't stay; without, the file has the corpus's fields alone.
    Levels without a value get no file. A corpus of several databases is an error, as a folder holds one.
    """
    if len(corpus.bundles.select("db_uuid").distinct().limit(2).collect()) > 1:
        raise ValueError("a folder holds one database")
    field = F.struct("field_name", "field_value", "field_type")
    of_bundle = F.concat("session", F.lit("_ses/"), "bundle", F.lit("_bndl/METADATA.json"))
    parts = [(corpus.meta_bundle, of_bundle), (corpus.meta_session, F.concat("session", F.lit("_ses/METADATA.json"))), (corpus.meta_database, F.lit("METADATA.json"))]
    rows = [df.groupBy(F.concat(F.lit(folder.rstrip("/") + "/"), at).alias("path")).agg(F.array_sort(F.collect_list(field)).alias("fields")) for df, at in parts]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            counts = []
            for path, fields in zip(pdf["path"], pdf["fields"], strict=True):
                new = {f["field_name"]: _json_value(f["field_value"], f["field_type"]) for f in fields}
                whole = (_get(path) if merge else {}) | new
                _put(path, json.dumps(whole, ensure_ascii=False, indent=2))
                counts.append(len(whole))
            yield pd.DataFrame({"path": pdf["path"], "fields": counts})

    return rows[0].unionByName(rows[1]).unionByName(rows[2]).mapInPandas(write, "path string, fields int")


def write_config(corpus: Corpus, folder: str) -> str:
    """Write the configuration, with the levels and links as they are now, and give its path."""
    path = f"{folder.rstrip('/')}/{corpus.config.get('name', 'corpus')}_DBconfig.json"
    _put(path, json.dumps(corpus.config | corpus.hierarchy.to_config(), ensure_ascii=False, indent=2))
    return path
