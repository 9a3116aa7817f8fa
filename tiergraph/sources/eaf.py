"""Annotations as time-aligned XML tiers (EAF), a document for each bundle."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEYS
from .annot_json import _put

#: The type that all tiers share, and the way they are bound to time.
TIER_TYPE = "default-lt"


def document(media: str | None, rows: list[dict]) -> str:
    """The document of one bundle; rows are (level, start, end, label), times in milliseconds, in order of level and time."""
    root = ET.Element("ANNOTATION_DOCUMENT", {"AUTHOR": "", "DATE": "1970-01-01T00:00:00+00:00", "FORMAT": "3.0", "VERSION": "3.0"})
    header = ET.SubElement(root, "HEADER", {"MEDIA_FILE": "", "TIME_UNITS": "milliseconds"})
    if media:
        ET.SubElement(header, "MEDIA_DESCRIPTOR", {"MEDIA_URL": media, "MIME_TYPE": "audio/x-wav"})
    times = {t: f"ts{k}" for k, t in enumerate(sorted({round(r[c]) for r in rows for c in ("start", "end")}), 1)}
    order = ET.SubElement(root, "TIME_ORDER")
    for t, name in times.items():
        ET.SubElement(order, "TIME_SLOT", {"TIME_SLOT_ID": name, "TIME_VALUE": str(t)})
    tiers: dict[str, ET.Element] = {}
    for k, r in enumerate(rows, 1):
        tier = tiers.get(r["level"])
        if tier is None:
            tier = tiers[r["level"]] = ET.SubElement(root, "TIER", {"TIER_ID": r["level"], "LINGUISTIC_TYPE_REF": TIER_TYPE})
        at = {"ANNOTATION_ID": f"a{k}", "TIME_SLOT_REF1": times[round(r["start"])], "TIME_SLOT_REF2": times[round(r["end"])]}
        ET.SubElement(ET.SubElement(ET.SubElement(tier, "ANNOTATION"), "ALIGNABLE_ANNOTATION", at), "ANNOTATION_VALUE").text = r["label"] or ""
    ET.SubElement(root, "LINGUISTIC_TYPE", {"LINGUISTIC_TYPE_ID": TIER_TYPE, "TIME_ALIGNABLE": "true", "GRAPHIC_REFERENCES": "false"})
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def read(text: str) -> list[tuple[str, int, int, str]]:
    """(tier, start, end, label) of a document's aligned annotations."""
    root = ET.fromstring(text)
    times = {x.get("TIME_SLOT_ID"): int(x.get("TIME_VALUE")) for x in root.iter("TIME_SLOT")}
    return [(tier.get("TIER_ID"), times[a.get("TIME_SLOT_REF1")], times[a.get("TIME_SLOT_REF2")], a.findtext("ANNOTATION_VALUE") or "") for tier in root.iter("TIER") for a in tier.iter("ALIGNABLE_ANNOTATION")]


def aligned(corpus, align_items: bool = True) -> DataFrame:
    """(keys, level, start, end, label) of what has a place in time, in milliseconds.

    With align_items, items without one take it from the timed items that links lead them to, over any number of levels of
    the hierarchy: from the first start to the last end. Events are a millisecond long, as the format asks for a length.
    """
    ms = lambda c: F.col(c) / F.col("sample_rate") * 1000
    timed = corpus.nodes.where("sample_start IS NOT NULL")
    end = F.when(F.col("type") == "EVENT", ms("sample_start") + 1).otherwise(ms("sample_end"))
    placed = timed.select(*KEYS, "item_id", "level", ms("sample_start").alias("start"), end.alias("end"), "label")
    out = placed.drop("item_id")
    if align_items:
        segments = placed.join(timed.where("type = 'SEGMENT'").select(*KEYS, "item_id"), [*KEYS, "item_id"], "left_semi").select(*KEYS, "item_id", "start", "end")
        names = {x.name: x.type for x in corpus.hierarchy.levels}
        spans = {name: segments.join(timed.where(F.col("level") == name).select(*KEYS, "item_id"), [*KEYS, "item_id"], "left_semi") for name, kind in names.items() if kind == "SEGMENT"}
        for name, kind in names.items():
            ways = [way for way in corpus.hierarchy.paths_from(name) if names.get(way[-1]) == "SEGMENT" and len(way) > 1] if kind == "ITEM" else []
            spread = None
            for way in ways:
                rows = spans[way[-1]]
                for _ in way[1:]:
                    up = corpus.links.select(*KEYS, F.col("to_id").alias("item_id"), "from_id")
                    rows = rows.join(up, [*KEYS, "item_id"]).groupBy(*KEYS, F.col("from_id").alias("item_id")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
                spread = rows if spread is None else spread.unionByName(rows)
            if spread is not None:
                whole = spread.groupBy(*KEYS, "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
                own = corpus.nodes.where((F.col("level") == name) & F.col("sample_start").isNull())
                out = out.unionByName(own.join(whole, [*KEYS, "item_id"]).select(*out.columns))
    return out


def documents(corpus, align_items: bool = True) -> DataFrame:
    """(keys, eaf): a document for each bundle; a bundle without anything in time has one without tiers.

    The annotations of one recording go into one document, so they are gathered by bundle.
    """
    row = F.struct("level", "start", "end", "label")
    rows = aligned(corpus, align_items).groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    bundles = corpus.bundles.select("db_uuid", "session", F.col("name").alias("bundle"), "annotates")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [document(media, list(found) if found is not None else []) for media, found in zip(pdf["annotates"], pdf["rows"], strict=True)]
            yield pdf[KEYS].assign(eaf=made)

    return bundles.join(rows, KEYS, "left").mapInPandas(write, "db_uuid string, session string, bundle string, eaf string")


def write_documents(made: DataFrame, folder: str) -> DataFrame:
    """Write each document beside its annotation file, by the tasks, when the result is asked for; gives (path, bytes)."""
    at = F.concat(F.lit(folder.rstrip("/") + "/"), "session", F.lit("_ses/"), "bundle", F.lit("_bndl/"), "bundle", F.lit(".eaf"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, text in zip(pdf["path"], pdf["eaf"], strict=True):
                _put(path, text)
            yield pd.DataFrame({"path": pdf["path"], "bytes": [len(x.encode()) for x in pdf["eaf"]]})

    return made.select(at.alias("path"), "eaf").mapInPandas(write, "path string, bytes bigint")
