"""What the corpus operators share: the shared work folder, lineage cuts, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; our own only where the session names none (tests)."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tiergraph-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as written to the shared folder, and the path: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


class Scratch:
    """Tables in the shared folder that are deleted once what was made from them is stored."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        """Delete all tables kept so far, and the shuffle files of the jobs that made them."""
        while self.paths:
            remove(self.spark, self.paths.pop())
        release(self.spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours below the shared folder."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"{path} isn't below the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
    """Apply fn to each Arrow batch; batches are kept small, as one row may be megabytes of text."""
    df.sparkSession.conf.set(ARROW_ROWS, str(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, null text as empty, so that other columns can't clash with ours."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def shuffled(df: DataFrame) -> DataFrame:
    """df, marked so that a join with it deals both sides by key. Without that the planner broadcasts what it estimates
    to be small, from the size of files: it doesn't know how many rows explode() makes or how well columns are packed, and
    the driver has to hold the table."""
    return df.hint("merge")


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast df if it has at most limit rows (narrow rows only); a shuffled join otherwise."""
    return F.broadcast(df) if small(df, limit) else shuffled(df)


def by_key(rows: DataFrame, values: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Join rows with values, which has one row for each key and its number of rows as n; counts has the same n.

    Keys with more than a quarter of an even partition's share are looked up in a broadcast table. There are at most
    four times as many of them as partitions, whatever the data, so its size is bounded. The rest is shuffled.
    """
    parts = partitions(rows.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > max(total // (4 * parts), 16)
    few = values.where(heavy)
    some = rows.join(F.broadcast(few.drop("n")), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(shuffled(values.where(~heavy).drop("n")), key)
    return some.unionByName(rest)
