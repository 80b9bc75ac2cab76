"""Configuration files, and the tables that rule files fill on the side."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class User:
    id: int
    grammars: list[tuple[str, str]] = field(default_factory=list)  # (class, name) of rule sets, in order
    topics: dict[tuple[str, str], list[tuple]] = field(default_factory=dict)  # (entity class, subclass, id, weight) a rule set needs
    spelling: dict[str, str] = field(default_factory=dict)
    dictionaries: list[str] = field(default_factory=list)
    flags: str = ""


@dataclass
class Config:
    stem: bool = False
    rules: list[tuple[str, str, str]] = field(default_factory=list)  # (file, class, name of the rule set)
    entities: list[str] = field(default_factory=list)
    dictionaries: list[str] = field(default_factory=list)
    threads: int = 1
    users: dict[int, User] = field(default_factory=dict)


def load_config(xml: str) -> Config:
    """<config> with <parse>, <rules>, <entities>, <dict>, <users><user>.. and <instance>; other parts are left alone."""
    root = ET.fromstring(xml)
    if root.tag != "config":
        raise ValueError(f"not a configuration: {root.tag}")
    text = lambda e: (e.text or "").strip()
    out = Config(stem=root.find("parse/stem") is not None)
    out.rules = [(text(f), f.get("class", ""), f.get("name", "")) for f in root.findall("rules/file")]
    out.entities = [text(f) for tag in ("entities", "entities2") for f in root.findall(f"{tag}/file")]
    out.dictionaries = [text(f) for f in root.findall("dict/file")]
    out.threads = int(text(root.find("instance/threads"))) if root.find("instance/threads") is not None else 1
    for u in root.findall("users/user"):
        user = User(int(u.get("id", 0)), flags=u.get("flags", ""))
        for t in u.findall("trieset/trie"):
            key = (t.get("class", ""), t.get("name", ""))
            user.grammars.append(key)
            needed = [(x.get("c"), x.get("s"), x.get("i"), float(x.get("w", 100))) for x in t.findall("topic")]
            if needed:
                user.topics[key] = needed
        for s in u.findall("spell"):
            user.spelling |= dict(s.attrib)
            user.dictionaries += [text(f) for f in s.findall("extra")]
        out.users[user.id] = user
    return out


@dataclass
class SideTables:
    """Rows that <mkent> elements leave beside the rules."""

    entities: list[tuple] = field(default_factory=list)  # cls, sub, id, name, relevance
    points: list[tuple] = field(default_factory=list)  # cls, sub, id, lon, lat
    properties: list[tuple] = field(default_factory=list)  # cls, sub, id, key, value
    documents: list[tuple] = field(default_factory=list)  # cls, sub, id, doc
    topics: list[tuple] = field(default_factory=list)  # cls, sub, id, topic_cls, topic_sub, topic_id, strength

    SCHEMAS = {
        "entities": "cls int, sub int, id string, name string, relevance int",
        "points": "cls int, sub int, id string, lon double, lat double",
        "properties": "cls int, sub int, id string, key string, value string",
        "documents": "cls int, sub int, id string, doc string",
        "topics": "cls int, sub int, id string, topic_cls int, topic_sub int, topic_id string, strength int",
    }

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {k: spark.createDataFrame(getattr(self, k), schema) for k, schema in self.SCHEMAS.items()}


def _int(value: str | None) -> int:
    return int(value) if value else 0


def _pattern_words(stmt: ET.Element) -> str:
    """The first words of a pattern as a name for what it makes."""
    pat = stmt.find("pat")
    return "" if pat is None else " ".join(w for t in pat.iter("t") for w in (t.text or "").split())


def side_tables(xml: str) -> SideTables:
    """What the <mkent> elements of a rule file say: entities, coordinates (p="lon,lat"), properties (v.name= and
    <nv n= v=/>), documents (zd="a|b"), topics (tc, ts, ti, tg).

    An entity without n= that is a statement's whole translation is named after its pattern's words.
    """
    root, out = ET.fromstring(xml), SideTables()
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    for stmt in root.iter("stmt"):
        tran = stmt.find("tran")
        for m in stmt.iter("mkent"):
            key = (_int(m.get("c")), _int(m.get("s")), m.get("i"))
            whole = tran is not None and len(tran) == 1 and tran[0] is m
            name = m.get("n") or (_pattern_words(stmt) if whole else "")
            out.entities.append((*key, name or None, _int(m.get("r"))))
            if m.get("p"):
                lon, lat = (float(x) for x in m.get("p").split(","))
                out.points.append((*key, lon, lat))
            out.properties += [(*key, k[2:], v) for k, v in m.attrib.items() if k.startswith("v.") and k[2:]]
            out.properties += [(*key, nv.get("n"), nv.get("v")) for nv in m.findall("nv")]
            out.documents += [(*key, d) for d in (m.get("zd") or "").split("|") if d]
            if any(k in m.attrib for k in ("tc", "ts", "ti")):
                out.topics.append((*key, _int(m.get("tc")), _int(m.get("ts")), m.get("ti"), _int(m.get("tg"))))
    return out
