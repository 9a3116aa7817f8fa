"""Metadata in three levels: a bundle's own value, else its session's, else the database's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS

TAGS = {bool: "logical", int: "integer", float: "numeric", str: "character"}


def encode(value) -> tuple[str, str]:
    """A value as text and the tag of its type."""
    import datetime
    import json

    if value is None:
        return "NULL", "NULL"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S"), "datetime"
    if isinstance(value, datetime.date):
        return value.isoformat(), "date"
    if isinstance(value, dict | list):
        return json.dumps(value, sort_keys=True), "json"
    if isinstance(value, bool):
        return str(value).upper(), "logical"
    return str(value), TAGS[type(value)]


def decode(value: Column, tag: str) -> Column:
    """Text as a column of the tag's type; what can't be read is null."""
    value = F.when(~value.isin("NULL", "NA"), value)
    kinds = {"logical": "boolean", "numeric": "double", "integer": "bigint", "date": "date", "datetime": "timestamp"}
    return value.try_cast(kinds[tag]) if tag in kinds else value


def long(corpus) -> DataFrame:
    """(db_uuid, session, bundle, field_name, field_value, field_type): each bundle's values after inheritance."""
    bundles = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"))
    own = corpus.meta_bundle.select("db_uuid", "session", "bundle", "field_name", "field_value", "field_type", F.lit(1).alias("priority"))
    session = bundles.join(corpus.meta_session, ["db_uuid", "session"]).select("db_uuid", "session", "bundle", "field_name", "field_value", "field_type", F.lit(2).alias("priority"))
    database = bundles.join(corpus.meta_database, "db_uuid").select("db_uuid", "session", "bundle", "field_name", "field_value", "field_type", F.lit(3).alias("priority"))
    every = own.unionByName(session).unionByName(database)
    # combined before the shuffle, where a window would sort every value
    best = every.groupBy("db_uuid", "session", "bundle", "field_name").agg(F.min(F.struct("priority", "field_value", "field_type")).alias("best"))
    return best.select(*KEYS, "field_name", "best.field_value", "best.field_type")


def wide(corpus, fields: list[str] | None = None, session_pattern: str | None = None, bundle_pattern: str | None = None) -> DataFrame:
    """A row per bundle with a text column per field, in order of their names. Patterns are found anywhere in a name."""
    fields = sorted(fields if fields is not None else corpus.fields())
    bundles = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"))
    if session_pattern is not None:
        bundles = bundles.where(F.col("session").rlike(session_pattern))
    if bundle_pattern is not None:
        bundles = bundles.where(F.col("bundle").rlike(bundle_pattern))
    if not fields:
        return bundles
    values = long(corpus).where(F.col("field_name").isin(*fields))
    pivoted = values.groupBy(*KEYS).agg(*[F.max(F.when(F.col("field_name") == f, F.col("field_value"))).alias(f) for f in fields])
    return bundles.join(pivoted, KEYS, "left").select(*KEYS, *[f"`{f}`" for f in fields])


def field(corpus, name: str, tag: str = "character") -> DataFrame:
    """(db_uuid, session, bundle, value) of one field, with its type."""
    bundles = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"))
    values = long(corpus).where(F.col("field_name") == name).select(*KEYS, decode(F.col("field_value"), tag).alias("value"))
    return bundles.join(values, KEYS, "left")


def at_level(corpus, level: str) -> DataFrame:
    """Values as set at one level, without inheritance."""
    return {"bundle": corpus.meta_bundle, "session": corpus.meta_session, "database": corpus.meta_database}[level]


def diagnostics(corpus) -> DataFrame:
    """Per field: bundles, sessions and databases that set it, and the levels at which it is set."""
    b = corpus.meta_bundle.groupBy("field_name").agg(F.countDistinct(*KEYS).alias("n_bundles"))
    s = corpus.meta_session.groupBy("field_name").agg(F.countDistinct("db_uuid", "session").alias("n_sessions"))
    d = corpus.meta_database.groupBy("field_name").agg(F.countDistinct("db_uuid").alias("n_databases"))
    out = b.join(s, "field_name", "full").join(d, "field_name", "full").na.fill(0)
    levels = F.concat_ws("+", F.when(F.col("n_bundles") > 0, "bundle"), F.when(F.col("n_sessions") > 0, "session"), F.when(F.col("n_databases") > 0, "database"))
    return out.withColumn("levels", levels)


def biographize(corpus, found: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Segments with their bundle's metadata; segments without any stay."""
    return found.join(wide(corpus, fields), KEYS, "left")


def registry(corpus) -> DataFrame:
    """(field_name, field_type): every field and its type, the first by name where levels differ."""
    parts = [x.select("field_name", "field_type") for x in (corpus.meta_bundle, corpus.meta_session, corpus.meta_database)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("field_name").agg(F.min("field_type").alias("field_type"))


def merged(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over base: rows of new replace rows with the same keys."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def checked(corpus, values: dict, allow_new: bool = False) -> dict[str, tuple[str, str]]:
    """values as text and tags; raises where a type differs from the registry, or a field is new."""
    known = {r.field_name: r.field_type for r in registry(corpus).where(F.col("field_name").isin(*values)).limit(len(values)).toLocalIterator()}
    out = {}
    for name, value in values.items():
        text, tag = encode(value)
        if name not in known and not allow_new:
            raise ValueError(f"{name} is a new field")
        if known.get(name, tag) not in (tag, "numeric" if tag == "integer" else tag) and tag != "NULL":
            raise TypeError(f"{name} is {known[name]}, not {tag}")
        out[name] = (text, known.get(name, tag))
    return out


def set_values(corpus, values: dict, session: str | None = None, bundle: str | None = None, allow_new: bool = True):
    """A corpus with values set for the bundles or sessions that match the patterns, or for the database."""
    spark = corpus.spark
    rows = [(k, *v) for k, v in checked(corpus, values, allow_new).items()]
    new = spark.createDataFrame(rows, "field_name string, field_value string, field_type string")
    names = ["field_name", "field_value", "field_type"]
    if bundle is not None:
        target = corpus.bundles.where(F.col("name").rlike(bundle) & F.col("session").rlike(session or "")).select("db_uuid", "session", F.col("name").alias("bundle"))
        keys = ["db_uuid", "session", "bundle", "field_name"]
        return corpus.replace(meta_bundle=merged(corpus.meta_bundle, target.crossJoin(F.broadcast(new)).select(*keys, *names[1:]), keys))
    if session is not None:
        target = corpus.bundles.where(F.col("session").rlike(session)).select("db_uuid", "session").distinct()
        keys = ["db_uuid", "session", "field_name"]
        return corpus.replace(meta_session=merged(corpus.meta_session, target.crossJoin(F.broadcast(new)).select(*keys, *names[1:]), keys))
    target = corpus.bundles.select("db_uuid").distinct()
    keys = ["db_uuid", "field_name"]
    return corpus.replace(meta_database=merged(corpus.meta_database, target.crossJoin(F.broadcast(new)).select(*keys, *names[1:]), keys))


#: Sheets of exported metadata: table, and the columns that name a row.
SHEETS = {"bundles": ("meta_bundle", ["db_uuid", "session", "bundle"]), "sessions": ("meta_session", ["db_uuid", "session"]), "database": ("meta_database", ["db_uuid"])}
MANDATORY = ("Age", "Gender")


def sheet(corpus, name: str, mandatory: tuple[str, ...] = MANDATORY) -> DataFrame:
    """A row per bundle, session or database with the values set there, without inheritance; mandatory fields have a column
    in any case."""
    table, keys = SHEETS[name]
    rows = getattr(corpus, table)
    present = {r.field_name for r in rows.select("field_name").distinct().toLocalIterator()}
    fields = sorted(present | set(mandatory))
    base = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle")).select(*keys).distinct()
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("field_name") == f, F.col("field_value"))).alias(f) for f in fields])
    return base.join(wide, keys, "left").select(*keys, *[f"`{f}`" for f in fields])


def export_sheets(corpus, path: str, mandatory: tuple[str, ...] = MANDATORY, overwrite: bool = False) -> None:
    """Each sheet as CSV with a header below path."""
    for name in SHEETS:
        sheet(corpus, name, mandatory).write.mode("overwrite" if overwrite else "errorifexists").csv(f"{path}/{name}", header=True)


def import_sheets(corpus, path: str):
    """A corpus with the values of exported sheets over its own; empty cells change nothing. Types follow the registry."""
    tables = {}
    types = registry(corpus).select("field_name", F.col("field_type").alias("_type"))
    for name, (table, keys) in SHEETS.items():
        read = corpus.spark.read.csv(f"{path}/{name}", header=True)
        if "db_uuid" not in read.columns:  # a sheet of one database may leave its name out
            ids = [r.db_uuid for r in corpus.bundles.select("db_uuid").distinct().limit(2).collect()]
            if len(ids) != 1:
                raise ValueError(f"the sheet {name} names no database, and the corpus has several or none")
            read = read.withColumn("db_uuid", F.lit(ids[0]))
        fields = [c for c in read.columns if c not in keys]
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("field_value")) for f in fields])).alias("x")
        rows = read.select(*keys, pairs).select(*keys, "x.*").where("field_value IS NOT NULL")
        rows = rows.join(types, "field_name", "left")
        on = [*keys, "field_name"]
        tables[table] = merged(getattr(corpus, table), rows.select(*on, "field_value", F.coalesce("_type", F.lit("character")).alias("field_type")), on)
    return corpus.replace(**tables)


def add_digests(corpus, hashes: DataFrame):
    """The corpus with its files' digests as metadata of their bundles (sources.annot_json.signal_hashes).

    hashes names no database, so a corpus of several is an error; digests of bundles that the corpus lacks are left out.
    """
    ids = [r.db_uuid for r in corpus.bundles.select("db_uuid").distinct().limit(2).collect()]
    if len(ids) > 1:
        raise ValueError("the corpus has several databases")
    keys = ["db_uuid", "session", "bundle"]
    known = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"))
    new = known.join(hashes, ["session", "bundle"]).select(*keys, "field_name", "field_value", "field_type")
    return corpus.replace(meta_bundle=merged(corpus.meta_bundle, new, [*keys, "field_name"]))


def clear(corpus, session: str | None = None, bundle: str | None = None):
    """The corpus without the values set at the bundles or sessions that match the patterns, or at the database."""
    if bundle is not None:
        hit = F.col("bundle").rlike(bundle) & F.col("session").rlike(session or "")
        return corpus.replace(meta_bundle=corpus.meta_bundle.where(~hit))
    if session is not None:
        return corpus.replace(meta_session=corpus.meta_session.where(~F.col("session").rlike(session)))
    return corpus.replace(meta_database=corpus.meta_database.where(F.lit(False)))
