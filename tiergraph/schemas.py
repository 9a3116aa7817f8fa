"""Schemas of the stored tables and of query results."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["db_uuid", "session", "bundle"]


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    """Flat columns, read without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


DATABASE = _schema("uuid string, name string")
SESSION = _schema("db_uuid string, name string")
BUNDLE = _schema("db_uuid string, session string, name string, annotates string, sample_rate double, md5_annot_json string")
ITEMS = _schema(
    "db_uuid string, session string, bundle string, item_id bigint, level string, type string, seq_idx int, sample_rate double, sample_point bigint, sample_start bigint, sample_dur bigint"
)
#: Items with the label of their level's own attribute, one row for each such label; null where an item has none.
NODES = _schema(
    "db_uuid string, session string, bundle string, item_id bigint, level string, type string, seq_idx int, sample_rate double, sample_start bigint, sample_end bigint, label string"
)
LABELS = _schema("db_uuid string, session string, bundle string, item_id bigint, label_idx int, name string, label string")
LINKS = _schema("db_uuid string, session string, bundle string, from_id bigint, to_id bigint, label string")
META_BUNDLE = _schema("db_uuid string, session string, bundle string, field_name string, field_value string, field_type string")
META_SESSION = _schema("db_uuid string, session string, field_name string, field_value string, field_type string")
META_DATABASE = _schema("db_uuid string, field_name string, field_value string, field_type string")

#: What every part of a compiled query yields, so that parts combine in any way.
NODE = [*KEYS, "item_id", "end_item_id", "level", "attribute", "seq_idx", "end_seq_idx", "type", "sample_start", "sample_end", "sample_rate", "label"]

#: Result rows, in this order; times in milliseconds, null where an item has no place in time.
SEGMENTS = _schema(
    "labels string, start double, end double, db_uuid string, session string, bundle string, start_item_id bigint, end_item_id bigint, level string, attribute string, "
    "start_item_seq_idx int, end_item_seq_idx int, type string, sample_start bigint, sample_end bigint, sample_rate double"
)

#: An annotation file, for from_json.
ANNOTATION = (
    "name string, annotates string, sampleRate double, "
    "levels array<struct<name:string,type:string,items:array<struct<id:bigint,samplePoint:bigint,sampleStart:bigint,sampleDur:bigint,labels:array<struct<name:string,value:string>>>>>>, "
    "links array<struct<fromID:bigint,toID:bigint,label:string>>"
)
