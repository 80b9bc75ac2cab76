"""Requests: the XML of queries, their attributes, filters and flags, and a runner of whole request blocks.

One request is one row; `answered` runs a table of requests in one Arrow stage.
"""

from __future__ import annotations

import datetime
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers, library
from .rewriter import Grammar, chain_topics, parse

#: Letters of the flags of a query, of a search and of a user.
QUERY_FLAGS = {"t": ("topics", True), "T": ("topics", False)}
SEARCH_FLAGS = {
    "d": ("chunks", True), "D": ("chunks", False), "c": ("content", True), "C": ("content", False), "p": ("properties", True), "P": ("properties", False),
    "t": ("tags", True), "T": ("tags", False), "H": ("links", True), "g": ("smart", True),
}
USER_FLAGS = {"c": "canonical names off", "f": "fluff kept", "s": "segregation", "z": "search", "B": "names by text", "p": "spelling off"}
KINDS = ("query", "qblock", "autoc", "findents", "zurch")


@dataclass
class Request:
    kind: str
    text: str = ""
    user: int = 0
    qid: str | None = None
    now: datetime.date | None = None
    answer: str = "xml"  # xml, json, or sjson for the short form
    most: int | None = None
    flags: str = ""
    filters: list[tuple] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    variables: dict = field(default_factory=dict)
    topics: list[tuple] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)
    parts: list[Request] = field(default_factory=list)  # the queries of a block


def parse_filter(text: str) -> list[tuple]:
    """`i,o,name,1,2;d,r,price,1.5,9`: type (i, d or s), one of (o) or range (r), property, values.

    A filter of an unknown type or mode, or a range without two ends, is refused.
    """
    out = []
    for one in filter(None, text.split(";")):
        kind, mode, name, *values = [x.strip() for x in one.split(",")]
        if kind not in ("i", "d", "s") or mode not in ("o", "r") or mode == "r" and len(values) != 2:
            raise ValueError(f"filter {one}")
        out.append((name, mode, [{"i": int, "d": float, "s": str}[kind](v) for v in values]))
    return out


def filter_column(filters: list[tuple]) -> Column:
    """All filters over columns of the properties' names; a missing value is false, a range has both ends."""
    made = F.lit(True)
    for name, mode, values in filters:
        col = F.col(name)
        made = made & F.coalesce(col.isin(*values) if mode == "o" else col.between(*values), F.lit(False))
    return made


def flags_of(text: str, table: dict) -> dict[str, bool]:
    """Letters as named switches; unknown letters are refused."""
    out = {}
    for c in text:
        if c not in table:
            raise ValueError(f"flag {c}")
        name, value = table[c] if isinstance(table[c], tuple) else (table[c], True)
        out[name] = value
    return out


def _date(text: str | None) -> datetime.date | None:
    """YYYY-MM-DD or YYYYMMDD, with or without a time behind."""
    digits = "".join(c for c in (text or "") if c.isdigit())[:8]
    return datetime.date(int(digits[:4]), int(digits[4:6]), int(digits[6:])) if len(digits) == 8 else None


def _value(node: ET.Element) -> dict:
    """The value of a request variable: <var n=..> with a typed child or a text."""
    for c in node:
        if c.tag in ("num", "n"):
            text = (c.text or c.get("v") or "0").strip()
            return library.made("number", float(text) if "." in text else int(text))
        if c.tag in ("ent", "entity"):
            return library.made("entity", [c.get("c", c.get("class")), c.get("s", c.get("subclass")), c.get("i", c.get("id"))])
        if c.tag == "date":
            return library.made("date", int("".join(x for x in c.text or "" if x.isdigit())[:8]))
    return library.made("word", (node.text or node.get("v") or "").strip())


def parse_request(xml: str) -> Request:
    """A request element with its attributes; <var>, <topic>, <nameval> and <prop> inside give its parameters."""
    return _request(ET.fromstring(xml))


_OWN = {"u": "user", "qid": "qid", "ret": "answer", "max": "most", "flag": "flags"}
_KNOWN = ("as", "autoc", "beni", "byid", "extra", "route", "uname", "ukey", "zurch", "lon", "lat", "dist", "ec", "es")


def _request(node: ET.Element) -> Request:
    if node.tag not in KINDS:
        raise ValueError(f"unknown request {node.tag}")
    out = Request(node.tag)
    for k, v in node.attrib.items():
        if k in _OWN:
            setattr(out, _OWN[k], int(v) if k in ("u", "max") else v)
        elif k == "now":
            out.now = _date(v)
        elif k == "flt":
            out.filters = parse_filter(v)
        elif k == "zdtag":
            out.tags = [t for t in v.split("|") if t]
        elif k in _KNOWN or k.endswith("field"):
            out.extra[k] = v
        else:
            raise ValueError(f"unknown attribute {k} of {node.tag}")
    if out.answer not in ("xml", "json", "sjson"):
        raise ValueError(f"unknown answer form {out.answer}")
    for c in node:
        if c.tag == "var":
            out.variables[c.get("n", c.get("name"))] = _value(c)
        elif c.tag == "topic":
            out.topics.append((c.get("c"), c.get("s"), c.get("i")))
        elif c.tag == "nameval":
            out.extra[c.get("n")] = c.get("v")
        elif c.tag in ("prop", "pf"):
            out.properties.append(c.get("n"))
        elif node.tag == "qblock":
            inner = _request(c)
            inner.user, inner.now, inner.variables = inner.user or out.user, inner.now or out.now, out.variables | inner.variables
            out.parts.append(inner)
        else:
            raise ValueError(f"unknown element {c.tag} in {node.tag}")
    if node.tag == "qblock":
        for inner in out.parts:  # parameters may follow the queries
            inner.variables = out.variables | inner.variables
    out.text = (node.text or "").strip()
    return out


def answer(request: Request, grammars: list[Grammar], tables: library.Tables | None = None, now: datetime.date | None = None, stems=None) -> str:
    """The answer to a query or to every query of a block."""
    if request.kind == "qblock":
        return "<qblock>" + "".join(answer(r, grammars, tables, now, stems) for r in request.parts) + "</qblock>"
    if request.kind != "query":
        raise ValueError(f"{request.kind} is answered from tables")
    own = {k: v for k, v in request.variables.items()}
    chain, used = parse(request.text, grammars, request.now or now or datetime.date(1970, 1, 1), own, tables, stems)
    if request.answer == "xml":
        return answers.answer_xml(chain, tables, used, request.qid, request.user)
    topics = chain_topics(chain) if flags_of(request.flags, QUERY_FLAGS).get("topics") else None
    return answers.answer_json(chain, tables, used if request.answer == "json" else None, topics, request.qid, request.user, request.answer == "sjson")


def answered(requests: DataFrame, grammars: list[Grammar], key: str, xml: str = "request", tables: library.Tables | None = None, now: datetime.date | None = None) -> DataFrame:
    """(key, answer, error) of a table of request texts; what cannot be read gives an error, null gives nulls."""
    sent = requests.sparkSession.sparkContext.broadcast((grammars, tables, now))

    def run(batches):
        grammars, tables, now = sent.value
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[xml], strict=True):
                try:
                    rows.append((k, None if text is None else answer(parse_request(text), grammars, tables, now), None))
                except (ValueError, ET.ParseError) as e:
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, xml).mapInPandas(run, f"{key} {kind}, answer string, error string")
