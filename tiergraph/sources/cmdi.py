"""A corpus's description as component metadata in XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_duration
from ..operators import metadata

NAMESPACE = "http://www.clarin.eu/cmd/"
PROXIES = 10


def facts(corpus) -> DataFrame:
    """One row: sessions, bundles, items, total duration and speakers."""
    length = corpus.items.groupBy("db_uuid", "session", "bundle").agg(F.max((F.coalesce("sample_start", "sample_point") + F.coalesce("sample_dur", F.lit(0))) / F.col("sample_rate")).alias("s"))
    total = length.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"))
    counts = corpus.bundles.agg(F.countDistinct("session").alias("n_sessions"), F.count("*").alias("n_bundles"))
    items = corpus.items.agg(F.count("*").alias("n_items"))
    return counts.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(total)).withColumn("duration", format_duration(F.col("seconds")))


def participants(corpus, id_field: str = "Participant.ID") -> DataFrame:
    """(participant, gender, age): of each participant, the values of the last bundle by name."""
    fields = corpus.fields()
    wide = metadata.wide(corpus, [f for f in (id_field, "Gender", "Age") if f in fields])
    if id_field not in fields:
        return wide.limit(0).select(F.lit("").alias("participant"), F.lit("").alias("gender"), F.lit("").alias("age"))
    pick = [F.max_by(F.col(f"`{c}`") if c in fields else F.lit(None).cast("string"), F.struct("session", "bundle", "db_uuid")).alias(c.lower()) for c in ("Gender", "Age")]
    return wide.where(F.col(f"`{id_field}`").isNotNull()).groupBy(F.col(f"`{id_field}`").alias("participant")).agg(*pick)


def export(corpus, title: str, profile: str = "speech-corpus") -> str:
    """The document; at most PROXIES bundles are listed as resources, as the format asks for a sample."""
    row = facts(corpus).first()
    root = ET.Element("CMD", {"xmlns": NAMESPACE, "CMDVersion": "1.2"})
    header = ET.SubElement(root, "Header")
    ET.SubElement(header, "MdProfile").text = profile
    proxies = ET.SubElement(ET.SubElement(root, "Resources"), "ResourceProxyList")
    for k, b in enumerate(corpus.bundles.orderBy("session", "name").select("session", "name").limit(PROXIES).toLocalIterator()):
        proxy = ET.SubElement(proxies, "ResourceProxy", {"id": f"r{k}"})
        ET.SubElement(proxy, "ResourceRef").text = f"{b.session}_ses/{b.name}_bndl"
    body = ET.SubElement(ET.SubElement(root, "Components"), profile)
    for name, value in (("Title", title), ("Sessions", row.n_sessions), ("Bundles", row.n_bundles), ("Items", row.n_items), ("Duration", row.duration)):
        ET.SubElement(body, name).text = str(value)
    people = participants(corpus).groupBy("gender").agg(F.count("*").alias("n")).orderBy("gender")
    for p in people.toLocalIterator():
        ET.SubElement(body, "Participants", {"gender": p.gender or "unknown"}).text = str(p.n)
    levels = ET.SubElement(body, "Levels")
    for x in corpus.hierarchy.levels:
        ET.SubElement(levels, "Level", {"type": x.type}).text = x.name
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def read(text: str) -> dict[str, str]:
    """The fields of an exported document."""
    root = ET.fromstring(text)
    out = {}
    for name in ("Title", "Sessions", "Bundles", "Items", "Duration", "MdProfile"):
        found = root.find(f".//{{{NAMESPACE}}}{name}")
        if found is not None:
            out[name] = found.text or ""
    out["Levels"] = ";".join(x.text or "" for x in root.iter(f"{{{NAMESPACE}}}Level"))
    return out
