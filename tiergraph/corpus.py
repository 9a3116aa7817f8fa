"""A corpus: tables of one or more annotation databases, and what can be asked of them. Everything is lazy."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .operators import metadata, navigate
from .plans import eql
from .plans.compile import Compiler, own_labels, segments
from .plans.hierarchy import Hierarchy

SCHEMAS = {"bundles": S.BUNDLE, "items": S.ITEMS, "labels": S.LABELS, "links": S.LINKS, "meta_bundle": S.META_BUNDLE, "meta_session": S.META_SESSION, "meta_database": S.META_DATABASE}
#: Stored in folders by these columns, which each query names: it reads the folders of its levels and attributes alone.
FOLDERS = {"items": "level", "labels": "name", "nodes": "level"}


@dataclass(frozen=True)
class Corpus:
    spark: SparkSession
    hierarchy: Hierarchy
    bundles: DataFrame
    items: DataFrame
    labels: DataFrame
    links: DataFrame
    meta_bundle: DataFrame
    meta_session: DataFrame
    meta_database: DataFrame
    config: dict = field(default_factory=dict)
    #: Items with their own label as they were stored, so that queries by it read one table and join nothing.
    stored_nodes: DataFrame | None = None

    @property
    def nodes(self) -> DataFrame:
        return own_labels(self.items, self.labels) if self.stored_nodes is None else self.stored_nodes

    @classmethod
    def of(cls, spark: SparkSession, hierarchy: Hierarchy, config: dict | None = None, **tables: DataFrame) -> Corpus:
        """A corpus of the given tables; those left out are empty."""
        made = {}
        for name, schema in SCHEMAS.items():
            table = tables.get(name)
            made[name] = spark.createDataFrame([], schema) if table is None else table.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in schema])
        return cls(spark, hierarchy, config=config or {}, **made)

    def replace(self, **tables) -> Corpus:
        return replace(self, **{"stored_nodes": None if {"items", "labels"} & tables.keys() else self.stored_nodes} | tables)

    def compiler(self, **options) -> Compiler:
        return Compiler(self.nodes, self.items, self.labels, self.links, self.hierarchy, **options)

    def query(self, text: str, ordered: bool = False, **options) -> DataFrame:
        """Result rows of a query; see plans.compile.Compiler for options."""
        return segments(self.compiler(**options).compile(eql.parse(text)), ordered)

    ask_for = query

    def scout(self, found: DataFrame, steps: int, **options) -> DataFrame:
        return navigate.scout(self, found, steps, **options)

    def retreat(self, found: DataFrame, steps: int, **options) -> DataFrame:
        return navigate.retreat(self, found, steps, **options)

    def ascend_to(self, found: DataFrame, level: str) -> DataFrame:
        return navigate.ascend_to(self, found, level)

    def descend_to(self, found: DataFrame, level: str) -> DataFrame:
        return navigate.descend_to(self, found, level)

    def fields(self) -> list[str]:
        """Names of metadata fields; a corpus has a column for each, so they are few."""
        return sorted(r.field_name for r in metadata.registry(self).select("field_name").toLocalIterator())

    def metadata(self, **options) -> DataFrame:
        return metadata.wide(self, **options)

    def __getitem__(self, at) -> DataFrame:
        """corpus[session_pattern, bundle_pattern], or corpus[pattern] of a session if one matches, else of a bundle."""
        session, bundle = at if isinstance(at, tuple) else (at, None)
        if not isinstance(at, tuple):
            any_session = not self.bundles.where(F.col("session").rlike("(?i)" + at)).isEmpty()
            session, bundle = ("(?i)" + at, None) if any_session else (None, at)
        return metadata.wide(self, session_pattern=session, bundle_pattern=bundle)

    def set_metadata(self, session: str | None = None, bundle: str | None = None, allow_new: bool = True, **values) -> Corpus:
        return metadata.set_values(self, values, session, bundle, allow_new)

    def peek(self, what: str) -> DataFrame:
        """levels, attributes, links, tracks, sessions or bundles."""
        spark, h = self.spark, self.hierarchy
        if what == "levels":
            return spark.createDataFrame([(x.name, x.type, len(x.attributes), "; ".join(x.attributes)) for x in h.levels], "name string, type string, n_attributes int, attributes string")
        if what == "attributes":
            return spark.createDataFrame([(x.name, a) for x in h.levels for a in x.attributes], "level string, name string")
        if what == "links":
            return spark.createDataFrame([(h.kinds.get(x, "ONE_TO_MANY"), *x) for x in h.links], "type string, superlevel string, sublevel string")
        if what == "tracks":
            tracks = self.config.get("ssffTrackDefinitions", [])
            return spark.createDataFrame([(t["name"], t["columnName"], t["fileExtension"]) for t in tracks], "name string, column string, extension string")
        if what == "sessions":
            return self.bundles.select("db_uuid", F.col("session").alias("name")).distinct()
        if what == "bundles":
            return self.bundles
        raise ValueError(f"can't peek at {what}")

    def save(self, path: str) -> Corpus:
        """Write the tables and read them back. A store that batches were added to can't be written over."""
        if _batches(self.spark, path):
            raise ValueError(f"{path} holds added batches: save to another path")
        self._write(path)
        return Corpus.load(self.spark, path)

    def _write(self, path: str) -> None:
        for name in (*SCHEMAS, "nodes"):
            writer = getattr(self, name).write.mode("overwrite")
            (writer.partitionBy(FOLDERS[name]) if name in FOLDERS else writer).parquet(f"{path}/{name}")
        config = json.dumps(self.config | self.hierarchy.to_config())
        self.spark.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    def append_to(self, path: str) -> Corpus:
        """Add this corpus's tables to the one stored at path, whole or not at all, and read that back.

        Tables go to a folder of their own, which readers take from when its mark is written after the last of them; what a
        failed call left is passed over. A bundle that is stored already is an error, as is another hierarchy. To gather
        many batches into one set of tables, load the store and save it at another path.
        """
        stored = Corpus.load(self.spark, path)
        if stored.hierarchy.to_config() != self.hierarchy.to_config():
            raise ValueError("the stored corpus has other levels or links")
        keys = ["db_uuid", "session", "name"]
        if twice := self.bundles.select(*keys).join(stored.bundles.select(*keys), keys, "left_semi").head(1):
            raise ValueError(f"{tuple(twice[0])} is stored already")
        batch = f"{path}/batches/{uuid.uuid4().hex}"
        self._write(batch)
        _file_system(self.spark, batch).create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{batch}/{COMMITTED}"), False).close()
        return Corpus.load(self.spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        config = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/config").limit(1000).toLocalIterator()))
        roots = [path, *_batches(spark, path)]
        # folders of levels are found from a table's own folder, so each is read by itself
        read = {name: reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{r}/{name}") for r in roots]) for name, schema in (SCHEMAS | {"nodes": S.NODES}).items()}
        return cls(spark, Hierarchy.from_config(config), config=config, stored_nodes=read.pop("nodes"), **read)


#: The mark of a batch whose tables are all written.
COMMITTED = "_COMMITTED"


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches that were added to a stored corpus."""
    marks = _file_system(spark, path).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batches/*/{COMMITTED}")) or []
    return sorted(x.getPath().getParent().toString() for x in marks)
