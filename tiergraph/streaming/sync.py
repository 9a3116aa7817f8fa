"""Changed annotations: a comparison of digests, a stream of files that arrive, and what is derived from a folder."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANNOTATION, KEYS
from ..sources import annot_json
from ..sources.cmdi import export
from ..sources.eaf import documents, write_documents


def changes(now: DataFrame, before: DataFrame | None, keys: list[str], digest: str) -> DataFrame:
    """(keys, digest, change) of rows that are new or whose digest differs; rows that are gone aren't reported."""
    if before is None:
        return now.select(*keys, digest, F.lit("new").alias("change"))
    old = before.select(*keys, F.col(digest).alias("_old"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "changed")
    return now.select(*keys, digest).join(old, keys, "left").withColumn("change", change).where("change IS NOT NULL").select(*keys, digest, "change")


def merged_state(now: DataFrame, before: DataFrame | None, keys: list[str], digest: str) -> DataFrame:
    """The state after a comparison: rows of now, and those of before that now lacks."""
    if before is None:
        return now.select(*keys, digest)
    return now.select(*keys, digest).unionByName(before.select(*keys, digest).join(now.select(*keys), keys, "left_anti"))


def follow(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Give each annotation file that has arrived since the last call to sink(rows, batch) once, then stop.

    The checkpoint keeps what was seen, so a call that failed is taken up where it stopped.
    """
    read = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_annot.json").text(folder)
    path = F.col("_metadata.file_path")
    rows = read.select(
        path.alias("path"), F.regexp_extract(path, r"([^/]*)_ses/", 1).alias("session"), F.regexp_extract(path, r"_ses/([^/]*)_bndl/", 1).alias("bundle"), F.md5("value").alias("md5_annot_json"), F.from_json("value", ANNOTATION).alias("annotation")
    )
    run = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def per_bundle_counts(spark: SparkSession, folder: str, schema, checkpoint: str, out: str) -> None:
    """Keep items by bundle and level counted over a folder of item tables as files arrive.

    Each batch writes a folder of its own, out/batch=N; a reader takes the newest that is whole (counts()).
    """
    items = spark.readStream.schema(schema).parquet(folder)
    counts = items.groupBy(*KEYS, "level").agg(F.count("*").alias("n"))
    run = counts.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def counts(spark: SparkSession, out: str) -> DataFrame:
    """What per_bundle_counts() wrote last; a batch without its mark of success is passed over."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/_SUCCESS")
    done = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    newest = max(int(x.getPath().getParent().getName().split("=")[1]) for x in done)
    return spark.read.parquet(f"{out}/batch={newest}")


#: Names of the settings and of the folder of states below a corpus folder.
CONFIG, STATE = ".sync_config.json", "sync_state"
DEFAULTS = {"enabled": False, "sync_eaf": True, "sync_cmdi": True, "align_items": True, "cmdi_profile": "speech-corpus"}
STATE_KEYS = ["kind", "session", "bundle"]


def enable(folder: str, enabled: bool = True, **settings) -> dict:
    """Write the settings (see DEFAULTS) for a corpus folder and give them; an unknown setting is an error."""
    if unknown := settings.keys() - DEFAULTS.keys():
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    config = DEFAULTS | settings | {"enabled": enabled}
    annot_json._put(f"{folder}/{CONFIG}", json.dumps(config, indent=2))
    return config


def load_config(folder: str) -> dict | None:
    return annot_json._get(f"{folder}/{CONFIG}") or None


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, session, bundle, digest) of annotation files, and of the metadata and configuration files of each place."""
    annot = annot_json.annotations(spark, folder, "").select(F.lit("annot").alias("kind"), "session", "bundle", F.col("md5_annot_json").alias("digest"))
    others = []
    for kind, pattern in (("metadata", "{METADATA.json,*.meta_json}"), ("config", "*_DBconfig.json")):
        files = annot_json._texts(spark, folder, pattern).select("session", "bundle", F.struct("path", F.md5("value").alias("md5")).alias("x"))
        # a place has a few such files
        whole = files.groupBy("session", "bundle").agg(F.md5(F.to_json(F.array_sort(F.collect_list("x")))).alias("digest"))
        others.append(whole.select(F.lit(kind).alias("kind"), "session", "bundle", "digest"))
    return annot.unionByName(others[0]).unionByName(others[1])


def _states(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the states that were written whole, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STATE}/state-*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(x.getPath().getParent().getName().split("-")[1]) for x in found)


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole state, or None."""
    known = _states(spark, folder)
    return spark.read.parquet(f"{folder}/{STATE}/state-{known[-1]}") if known else None


def save_state(state: DataFrame, folder: str) -> None:
    """Write a state under the next number, so that readers of the last one aren't disturbed, and delete all before that."""
    spark = state.sparkSession
    known = _states(spark, folder)
    state.write.mode("overwrite").parquet(f"{folder}/{STATE}/state-{(known or [0])[-1] + 1}")
    for n in known[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STATE}/state-{n}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, folder: str, eaf: bool = True, cmdi: bool = True, force: bool = False) -> dict[str, int]:
    """Bring what is derived from a corpus folder up to date: a document for each changed bundle, and the description.

    Gives the number of changes and of documents. force writes all. The state is saved last, so a run that failed is done
    again as a whole.
    """
    config = DEFAULTS | (load_config(folder) or {})
    now, before = digests(spark, folder), load_state(spark, folder)
    changed = changes(now, before, STATE_KEYS, "digest")
    corpus = annot_json.read_corpus(spark, folder)
    out = {"changes": changed.count(), "eaf": 0, "cmdi": 0}
    if eaf:
        made = documents(corpus, config["align_items"])
        if not force:
            made = made.join(changed.where("kind = 'annot'").select("session", "bundle"), ["session", "bundle"], "left_semi")
        out["eaf"] = write_documents(made, folder).count()
    if cmdi and (force or out["changes"]):
        name = corpus.config.get("name", "corpus")
        annot_json._put(f"{folder}/{name}.cmdi", export(corpus, name, config["cmdi_profile"]))
        out["cmdi"] = 1
    save_state(merged_state(now, before, STATE_KEYS, "digest"), folder)
    return out


def check(spark: SparkSession, folder: str, force: bool = False) -> dict[str, int] | None:
    """run() as the folder's settings say; None where they are missing or not enabled."""
    config = load_config(folder)
    return run(spark, folder, config["sync_eaf"], config["sync_cmdi"], force) if config and config["enabled"] else None


def then_check(spark: SparkSession, folder: str, change: Callable, *args, **options):
    """change(folder, ...) and then check(); what change gives."""
    made = change(folder, *args, **options)
    check(spark, folder)
    return made


def add_session(spark: SparkSession, folder: str, name: str) -> str:
    """Make a session's folder and check(); a session counts as soon as it has a bundle."""
    _inside(name)
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(f"{path}/{name}_ses", recursive=True)
    check(spark, folder)
    return name


def remove_session(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a session's folder with all its bundles, and write the description anew if the settings say so."""
    _inside(name)
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    if fs.get_file_info(f"{path}/{name}_ses").type == pafs.FileType.Directory:
        fs.delete_dir(f"{path}/{name}_ses")
    _describe(spark, folder)


def update_config(spark: SparkSession, corpus, folder: str) -> str:
    """Write the corpus's configuration, with its levels and links, and the description anew if the settings say so."""
    path = annot_json.write_config(corpus, folder)
    _describe(spark, folder)
    return path


def _inside(name: str) -> None:
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"{name!r} is no name of a session")


def _describe(spark: SparkSession, folder: str) -> None:
    config = load_config(folder)
    if config and config["enabled"] and config["sync_cmdi"]:
        run(spark, folder, eaf=False, cmdi=True, force=True)
