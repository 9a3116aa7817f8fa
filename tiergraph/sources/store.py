"""Corpora that are stored once in a Spark application, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..corpus import Corpus

_stored: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tiergraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def once(spark: SparkSession, name: str, build: Callable[[], Corpus]) -> Corpus:
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex[:12]}"
        build().save(path)
        _stored[key] = path
    return Corpus.load(spark, _stored[key])
