"""A query tree to one lazy plan.

Every part yields the columns of NODE, so parts nest in any way. Labels are filtered before any join, and what a part
asks of other items is asked by semi joins of key columns.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import glob_to_regex, label_glob
from .. import schemas as S
from ..schemas import KEYS, NODE
from .eql import Binary, EqlSyntaxError, Function, Node, Simple
from .hierarchy import Hierarchy

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def places(items: DataFrame) -> DataFrame:
    """items with sample_start and sample_end as results have them; an event's place is its point."""
    start = F.coalesce("sample_start", "sample_point")
    return items.select(*KEYS, "item_id", "level", "type", "seq_idx", "sample_rate", start.alias("sample_start"), (start + F.coalesce("sample_dur", F.lit(0))).alias("sample_end"))


def own_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """placed items with the label of their level's own attribute, each such label once."""
    own = labels.select(*KEYS, "item_id", F.col("name").alias("level"), "label").distinct()
    return places(items).join(own, [*KEYS, "item_id", "level"], "left").select(*S.NODES.names)


def as_nodes(items: DataFrame, attribute: Column) -> DataFrame:
    """placed items with a label column, as NODE."""
    return items.select(
        *KEYS, "item_id", F.col("item_id").alias("end_item_id"), "level", attribute.alias("attribute"), "seq_idx", F.col("seq_idx").alias("end_seq_idx"), "type", "sample_start", "sample_end", "sample_rate", "label"
    )


class Compiler:
    """patterns: "glob" for =~ as globs found anywhere, "regex" for regular expressions.

    other_attributes: whether != also lets labels of other attributes of the level through.
    """

    def __init__(self, nodes: DataFrame, items: DataFrame, labels: DataFrame, links: DataFrame, hierarchy: Hierarchy, patterns: str = "glob", other_attributes: bool = False):
        self.nodes, self.items, self.labels, self.links, self.hierarchy = nodes, places(items), labels, links, hierarchy
        self.patterns, self.other_attributes = patterns, other_attributes

    def compile(self, node: Node) -> DataFrame:
        if isinstance(node, Simple):
            return self.simple(node)
        if isinstance(node, Function):
            return self.count(node) if node.name == "Num" else self.position(node)
        return {"->": self.sequence, "^": self.dominance, "&": self.both, "|": self.either}[node.op](node)

    def _level(self, name: str) -> DataFrame:
        if not self.hierarchy.level(name):
            raise EqlSyntaxError(f"no level {name}")
        return self.items.where(F.col("level") == name)

    def _own(self, name: str) -> DataFrame:
        """Items of a level with its own attribute's label."""
        if not self.hierarchy.level(name):
            raise EqlSyntaxError(f"no level {name}")
        return self.nodes.where(F.col("level") == name)

    def condition(self, node: Simple) -> Column:
        label, name = F.col("label"), F.col("name") == node.attribute
        if node.op == "==":
            return name & (label == node.value)
        if node.op == "!=":
            return (label != node.value) | ~name if self.other_attributes else name & (label != node.value)
        found = label.rlike(glob_to_regex(label_glob(node.value)) if self.patterns == "glob" else node.value)
        return name & (found if node.op == "=~" else ~found)

    def simple(self, node: Simple) -> DataFrame:
        level = self.hierarchy.level(node.level)
        if not level or node.attribute not in level.attributes:
            raise EqlSyntaxError(f"no attribute {node.attribute} on a level {node.level}")
        if node.attribute == level.name and not (self.other_attributes and node.op == "!="):
            own = self._own(level.name).where(F.col("label").isNotNull()).withColumn("name", F.lit(level.name))
            return as_nodes(own.where(self.condition(node)), F.lit(level.name))
        labels = self.labels.where(self.condition(node)).select(*KEYS, "item_id", "name", "label")
        return as_nodes(self._level(node.level).join(labels, [*KEYS, "item_id"]), F.col("name")).distinct()

    def sequence(self, node: Binary) -> DataFrame:
        a, b = level_of(node.left), level_of(node.right)
        if a and b and a != b:
            raise EqlSyntaxError(f"a sequence of {a} and {b}: levels differ")
        left, right = self.compile(node.left), self.compile(node.right)
        next_to = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*KEYS, "level")] + [F.col("l.end_seq_idx") + 1 == F.col("r.seq_idx")]
        on = reduce(operator.and_, next_to)
        if marked(node.left):
            return left.alias("l").join(right.alias("r"), on, "left_semi").select(*NODE)
        if marked(node.right):
            return right.alias("r").join(left.alias("l"), on, "left_semi").select(*NODE)
        whole = left.alias("l").join(right.alias("r"), on)
        taken = {"end_item_id": "r", "end_seq_idx": "r", "sample_end": "r"}
        made = {"label": F.concat("l.label", F.lit("->"), "r.label"), "type": F.lit("ITEM")}
        return whole.select(*[made[c].alias(c) if c in made else F.col(f"{taken.get(c, 'l')}.{c}") for c in NODE])

    def reach(self, ids: DataFrame, way: list[str], up: bool) -> DataFrame:
        """Keys and ids of the items that ids (at one end of way) are linked with at the other end."""
        here, there = ("to_id", "from_id") if up else ("from_id", "to_id")
        steps = way[::-1] if up else way
        for k, level in enumerate(steps[1:], 1):
            edges = self.links.select(*KEYS, F.col(here).alias("item_id"), F.col(there).alias("_next"))
            ids = edges.join(ids, [*KEYS, "item_id"], "left_semi").select(*KEYS, F.col("_next").alias("item_id")).distinct()
            if k < len(steps) - 1:  # the last step meets items of its level anyway
                ids = ids.join(self._level(level).select(*KEYS, "item_id"), [*KEYS, "item_id"], "left_semi")
        return ids

    def dominance(self, node: Binary) -> DataFrame:
        a, b = level_of(node.left), level_of(node.right)
        if not a or not b:
            raise EqlSyntaxError("each side of ^ must be of one level")
        way, turned = self.hierarchy.path(a, b), False
        if way is None or a == b:
            way, turned = self.hierarchy.path(b, a), True
        if way is None or a == b:
            raise EqlSyntaxError(f"{a} and {b} aren't on one way down")
        keep, other = (node.right, node.left) if marked(node.right) and not marked(node.left) else (node.left, node.right)
        up = (keep is node.left) != turned
        ids = self.reach(self.compile(other).select(*KEYS, "item_id").distinct(), way, up)
        return self.compile(keep).join(ids, [*KEYS, "item_id"], "left_semi")

    def both(self, node: Binary) -> DataFrame:
        ids = [*KEYS, "item_id"]
        return self.compile(node.left).join(self.compile(node.right).select(*ids).distinct(), ids, "left_semi")

    def either(self, node: Binary) -> DataFrame:
        return self.compile(node.left).unionByName(self.compile(node.right)).distinct()

    def _pairs(self, node: Function) -> DataFrame:
        """Children of a level with their parents of the other."""
        parents = self._level(node.parent).select(*KEYS, F.col("item_id").alias("from_id"))
        edges = self.links.select(*KEYS, "from_id", F.col("to_id").alias("item_id"))
        return edges.join(parents, [*KEYS, "from_id"], "left_semi").join(self._own(node.child), [*KEYS, "item_id"])

    def position(self, node: Function) -> DataFrame:
        by_parent = W.partitionBy(*KEYS, "from_id")
        # a link that stands twice counts once
        ranked = self._pairs(node).withColumn("rank", F.dense_rank().over(by_parent.orderBy("seq_idx", "item_id"))).withColumn("size", F.max("rank").over(by_parent))
        rank, size = F.col("rank"), F.col("size")
        if node.position is not None:
            # a rank given by number
            found = rank == node.position
        else:
            found = {"Start": rank == 1, "End": rank == size, "Medial": (rank > 1) & (rank < size)}[node.name]
        if (node.op == "==") != (node.value == 1):
            found = ~found
        kept = ranked.where(found).drop("from_id", "rank", "size").distinct()
        return as_nodes(kept, F.lit(node.child))

    def count(self, node: Function) -> DataFrame:
        children = self._level(node.child).select(*KEYS, F.col("item_id").alias("to_id"))
        edges = self.links.select(*KEYS, "from_id", "to_id").join(children, [*KEYS, "to_id"], "left_semi")
        counts = edges.groupBy(*KEYS, F.col("from_id").alias("item_id")).agg(F.countDistinct("to_id").alias("n"))
        parents = self._own(node.parent).join(counts, [*KEYS, "item_id"], "left")
        kept = parents.where(COMPARE[node.op](F.coalesce("n", F.lit(0)), F.lit(node.value))).drop("n")
        return as_nodes(kept, F.lit(node.parent))


def marked(node: Node) -> bool:
    """Whether the part, or one in it, bears a projection mark."""
    return node.projected or (isinstance(node, Binary) and (marked(node.left) or marked(node.right)))


def level_of(node: Node) -> str | None:
    """The level of a part's results, or None if it has several."""
    if isinstance(node, Simple):
        return node.level
    if isinstance(node, Function):
        return node.parent if node.name == "Num" else node.child
    if node.op == "^":
        return level_of(node.right if marked(node.right) and not marked(node.left) else node.left)
    if node.op == "|":
        a, b = level_of(node.left), level_of(node.right)
        return a if a == b else None
    return level_of(node.left)


def segments(nodes: DataFrame, ordered: bool = False) -> DataFrame:
    """NODE columns as result rows, with times in milliseconds."""
    out = nodes.select(
        F.col("label").alias("labels"),
        (F.col("sample_start") / F.col("sample_rate") * 1000).alias("start"),
        (F.col("sample_end") / F.col("sample_rate") * 1000).alias("end"),
        *KEYS,
        F.col("item_id").alias("start_item_id"),
        "end_item_id",
        "level",
        "attribute",
        F.col("seq_idx").alias("start_item_seq_idx"),
        F.col("end_seq_idx").alias("end_item_seq_idx"),
        "type",
        "sample_start",
        "sample_end",
        "sample_rate",
    )
    return out.orderBy("session", "bundle", "start_item_seq_idx", "level", "start_item_id") if ordered else out
