"""The directed graph of levels: definitions, paths and checks. Small, and so on the driver."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace

TYPES = ("ITEM", "SEGMENT", "EVENT")


@dataclass(frozen=True)
class Level:
    name: str
    type: str = "ITEM"
    attributes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"level {self.name}: type {self.type!r} is none of {', '.join(TYPES)}")
        if self.name not in self.attributes:
            object.__setattr__(self, "attributes", (self.name, *self.attributes))


@dataclass(frozen=True)
class Hierarchy:
    levels: tuple[Level, ...] = ()
    links: tuple[tuple[str, str], ...] = ()
    kinds: dict[tuple[str, str], str] = field(default_factory=dict, hash=False, compare=False)

    def level(self, name: str) -> Level | None:
        return next((x for x in self.levels if x.name == name), None)

    def level_of(self, attribute: str) -> str | None:
        """The first level with this attribute."""
        return next((x.name for x in self.levels if attribute in x.attributes), None)

    def attributes(self) -> list[str]:
        return list(dict.fromkeys(a for x in self.levels for a in x.attributes))

    def children(self, name: str) -> list[str]:
        return [b for a, b in self.links if a == name]

    def parents(self, name: str) -> list[str]:
        return [a for a, b in self.links if b == name]

    def path(self, top: str, bottom: str) -> list[str] | None:
        """The shortest way down from top to bottom; links defined first win ties."""
        before: dict[str, str | None] = {top: None}
        queue = deque([top])
        while queue:
            at = queue.popleft()
            if at == bottom:
                way = []
                while at is not None:
                    way.append(at)
                    at = before[at]
                return way[::-1]
            for child in self.children(at):
                if child not in before:
                    before[child] = at
                    queue.append(child)
        return None

    def dominates(self, top: str, bottom: str) -> bool:
        return top != bottom and self.path(top, bottom) is not None

    def paths_from(self, name: str) -> list[list[str]]:
        """All ways from a level down to levels without children."""
        below = self.children(name)
        return [[name, *rest] for child in below for rest in self.paths_from(child)] if below else [[name]]

    def all_paths(self) -> list[list[str]]:
        """All ways down from any level, and their beginnings of two levels or more, each once."""
        out: dict[tuple[str, ...], None] = {}
        for level in self.levels:
            for way in self.paths_from(level.name):
                for k in range(2, len(way) + 1):
                    out[tuple(way[:k])] = None
        return [list(x) for x in out]

    def paths_between(self, a: str, b: str) -> list[list[str]]:
        return [x for x in self.all_paths() if {x[0], x[-1]} == {a, b}]

    def suffixes(self) -> list[list[str]]:
        """The ends, of two levels or more, of all ways down."""
        return [list(x) for x in dict.fromkeys(tuple(way[k:]) for way in self.all_paths() for k in range(len(way) - 1))]

    def segment_levels(self, attribute: str) -> list[str]:
        """SEGMENT levels below the level of an attribute."""
        start = self.level_of(attribute)
        reached = {name for way in self.paths_from(start) for name in way[1:]} if start else set()
        return [x.name for x in self.levels if x.type == "SEGMENT" and x.name in reached]

    def problems(self) -> list[str]:
        names = [x.name for x in self.levels]
        out = [f"level {n} is defined {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]
        return out + [f"link {a}->{b}: {x} is not a level" for a, b in self.links for x in (a, b) if x not in names]

    def with_level(self, level: Level) -> Hierarchy:
        if self.level(level.name):
            raise ValueError(f"level {level.name} exists")
        return replace(self, levels=(*self.levels, level))

    def without_level(self, name: str) -> Hierarchy:
        if not self.level(name):
            raise ValueError(f"no level {name}")
        if any(name in x for x in self.links):
            raise ValueError(f"level {name} is in a link definition")
        return replace(self, levels=tuple(x for x in self.levels if x.name != name))

    def to_config(self) -> dict:
        return {
            "levelDefinitions": [{"name": x.name, "type": x.type, "attributeDefinitions": [{"name": a, "type": "STRING"} for a in x.attributes]} for x in self.levels],
            "linkDefinitions": [{"type": self.kinds.get(x, "ONE_TO_MANY"), "superlevelName": x[0], "sublevelName": x[1]} for x in self.links],
        }

    @classmethod
    def from_config(cls, config: dict) -> Hierarchy:
        levels = tuple(Level(x["name"], x["type"], tuple(a["name"] for a in x.get("attributeDefinitions", []))) for x in config.get("levelDefinitions", []))
        links = [((x["superlevelName"], x["sublevelName"]), x.get("type", "ONE_TO_MANY")) for x in config.get("linkDefinitions", [])]
        return cls(levels, tuple(x for x, _ in links), dict(links))
