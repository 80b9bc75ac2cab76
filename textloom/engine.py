"""The engine as a library: rule sets by name, users with their grammars, commands on rules, searches over tables."""

from __future__ import annotations

import datetime
import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import language_guess
from .functions.words import present, singular, to_latin, to_russian
from .operators import index, names
from .plans import answers, requests
from .plans.library import LIBRARY, Tables
from .plans.requests import Request
from .plans.rewriter import Grammar, parse
from .plans.rules import Rule, compile_rules, count, expand, load_macros, load_procedures, load_rules, parse_pattern
from .sources.rulefiles import Config, side_tables


@dataclass
class RuleStore:
    """Rules, procedures and macros of one named set."""

    rules: list[Rule] = field(default_factory=list)
    procedures: dict = field(default_factory=dict)
    macros: dict = field(default_factory=dict)


class Engine:
    """Holds compiled rules on the driver; everything over tables is a DataFrame."""

    def __init__(self, config: Config | None = None, stems=None):
        self.config = config or Config()
        self.stems = stems if self.config.stem or stems else None
        self.sets: dict[tuple[str, str], RuleStore] = {}
        self.tables = Tables()
        for path, cls, name in self.config.rules:
            with open(path, encoding="utf-8") as f:
                self.add_rules(f.read(), cls, name, path)

    def add_rules(self, xml: str, cls: str = "", name: str = "", source: str = "") -> int:
        """Adds statements to a set, and the entities that they make; the number of statements added."""
        held = self.sets.setdefault((cls, name), RuleStore())
        held.macros |= load_macros(xml)
        far = {(n, k): p for (_, n), s in self.sets.items() for k, p in s.macros.items()}
        more = load_rules(xml, macros=held.macros | far, stems=self.stems, source=source)
        compile_rules([*held.rules, *more])  # refuses what cannot be compiled before it is kept
        held.rules += more
        held.procedures |= load_procedures(xml)
        side = side_tables(xml)
        known = {(e["cls"], e["sub"], e["id"]) for e in self.tables.entities}
        self.tables.entities += [dict(zip(("cls", "sub", "id", "name", "relevance"), e, strict=True)) for e in dict.fromkeys(side.entities) if e[:3] not in known]
        for c, s, i, tc, ts, ti, _ in side.topics:
            self.tables.topics.setdefault((str(c), str(s), str(i)), []).append((str(tc), str(ts), str(ti)))
        return len(more)

    def remove_statement(self, source: str, number: int, cls: str = "", name: str = "") -> int:
        """Takes statements of a source out of a set; their number."""
        held = self.sets[cls, name]
        kept = [r for r in held.rules if (r.source, r.number) != (source, number)]
        gone, held.rules = len(held.rules) - len(kept), kept
        return gone

    def clear(self, cls: str = "", name: str = "") -> None:
        self.sets.pop((cls, name), None)

    def grammars(self, user: int = 0) -> list[Grammar]:
        """A user's rule sets in order, each behind its topics; of an unknown user all sets."""
        own = self.config.users.get(user)
        keys = own.grammars if own and own.grammars else list(self.sets)
        needed = own.topics if own else {}
        made = []
        for key in keys:
            if key in self.sets:
                held = self.sets[key]
                made.append(Grammar(compile_rules(held.rules, held.procedures), [((c, s, i), w) for c, s, i, w in needed.get(key, [])]))
        return made

    def parse(self, text: str, user: int = 0, now: datetime.date | None = None, variables: dict | None = None) -> tuple[list[dict], list[tuple]]:
        return parse(text, self.grammars(user), now or datetime.date(1970, 1, 1), variables, self.tables, self.stems)

    def answer(self, request: str | Request, now: datetime.date | None = None) -> str:
        """The answer to a request (XML or parsed)."""
        r = requests.parse_request(request) if isinstance(request, str) else request
        return requests.answer(r, self.grammars(r.user), self.tables, now, self.stems)

    def answers(self, table: DataFrame, key: str, xml: str = "request", now: datetime.date | None = None) -> DataFrame:
        return requests.answered(table, self.grammars(), key, xml, self.tables, now)

    def match_xml(self, text: str, pattern: str) -> bool:
        """Whether a pattern (XML) matches the whole text."""
        one = compile_rules([Rule(0, parse_pattern(ET.fromstring(pattern), {}, (), self.stems), ET.fromstring("<tran><ltrl>m</ltrl></tran>"))])
        chain, _ = parse(text, [Grammar(one)], tables=self.tables, stems=self.stems)
        return len(chain) == 1 and chain[0]["value"] == "m"

    @staticmethod
    def count_emits(pattern: str) -> int:
        """Number of sequences of a pattern (XML)."""
        return count(parse_pattern(ET.fromstring(pattern)))

    @staticmethod
    def emits(pattern: str) -> list[str]:
        """The sequences of a pattern: words as they are, other leaves by their kind in brackets."""
        shown = lambda leaf: leaf[1] if leaf[0] in ("t", "p") else f"[{leaf[0]}]"
        return [" ".join(shown(x) for x in seq if x[0] not in "<>") for seq in expand(parse_pattern(ET.fromstring(pattern)))]

    def entity_rules(self, cls: str, sub: str, id_: str) -> list[tuple[str, int]]:
        """(source, statement) of the rules that make an entity."""
        makes = lambda r: r.translation is not None and any((m.get("c"), m.get("s"), m.get("i")) == (cls, sub, id_) for m in r.translation.iter("mkent"))
        return [(r.source, r.number) for s in self.sets.values() for r in s.rules if makes(r)]

    COMMANDS = ("COUNT_EMIT", "EMIT", "ENTRULES", "EN2RU", "RU2EN", "ADD_STMSET", "STMT_REMOVE", "CLEAR_TRIE", "MATCH_XML", "HELP")

    def command(self, name: str, *args: str) -> str:
        """Commands by name, with their arguments as texts; the result as JSON."""
        todo = {
            "COUNT_EMIT": lambda: self.count_emits(*args), "EMIT": lambda: self.emits(*args), "ENTRULES": lambda: self.entity_rules(*args), "EN2RU": lambda: spelled(args[0], True), "RU2EN": lambda: spelled(args[0], False),
            "ADD_STMSET": lambda: self.add_rules(*args), "STMT_REMOVE": lambda: self.remove_statement(args[0], int(args[1]), *args[2:]), "CLEAR_TRIE": lambda: self.clear(*args), "MATCH_XML": lambda: self.match_xml(*args),
            "HELP": lambda: {"commands": list(self.COMMANDS), "routes": list(ROUTES), "functions": sorted(LIBRARY)},
        }
        if name not in todo:
            raise ValueError(f"unknown command {name}")
        return json.dumps(todo[name](), ensure_ascii=False)


def spelled(text: str, russian: bool) -> str:
    """One text in the other alphabet, by the tables of the column functions."""
    from .functions.words import LATIN_GROUPS, LATIN_SINGLE, RUSSIAN_LATIN, RUSSIAN_SINGLE

    out = text.lower()
    for a, b in LATIN_GROUPS if russian else RUSSIAN_LATIN.items():
        out = out.replace(a, b)
    single = dict(zip(LATIN_SINGLE, RUSSIAN_SINGLE, strict=True)) if russian else dict(zip("абвгдезийклмнопрстуфыь", "abvgdezijklmnoprstufy'", strict=True))
    return "".join(single.get(c, c) for c in out)


def normalised(words: DataFrame, column: str = "tok") -> DataFrame:
    """words with `stem`, `russian` and `latin` of a column."""
    w = F.col(column)
    return words.select("*", present(singular(w)).alias("stem"), to_russian(w).alias("russian"), to_latin(w).alias("latin"))


guess_language = language_guess

#: Views of an index by name: each takes postings and what it is asked for.
ROUTES = {
    "doc.features": lambda links, doc: links.filter(F.col("doc_id") == int(doc)).select("gram", "cnt"),
    "docid": lambda links, doc: links.filter(F.col("doc_id") == int(doc)).select("doc_id").distinct(),
    "feature.docs": lambda links, gram: links.filter(F.col("gram") == gram).select("doc_id", "cnt"),
}


def route(links: DataFrame, name: str, asked: str) -> DataFrame:
    """A view of postings (gram, doc_id, cnt) by its name."""
    if name not in ROUTES:
        raise ValueError(f"unknown route {name}")
    return ROUTES[name](links, asked)


def completion_json(completed: DataFrame) -> DataFrame:
    """(prefix, answer): completions (prefix, name, rank) of each prefix as a JSON object, best first."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("completions")
    return completed.groupBy("prefix").agg(listed).select("prefix", F.to_json(F.struct("prefix", "completions")).alias("answer"))


def found_entities(points: DataFrame, request: Request) -> DataFrame:
    """Entities (id, lon, lat, sub) near the place of a findents request, nearest first; es= keeps one subclass."""
    at = request.extra
    held = points if "es" not in at else points.filter(F.col("sub") == int(at["es"]))
    found = names.near(held, float(at["lon"]), float(at["lat"]), float(at["dist"]))
    return found.orderBy("dist", "id").limit(request.most) if request.most else found.orderBy("dist", "id")


def searched(docs: DataFrame, request: Request, tags: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank): the documents (doc_id, text, properties ..) that a zurch request asks for.

    Its filters and tags restrict the documents; the flag g takes the smart score.
    """
    held = docs.filter(requests.filter_column([f for f in request.filters if f[0] in docs.columns]))
    if tags is not None and request.tags:
        held = held.join(index.tagged_all(tags, request.tags), "doc_id", "left_semi")
    spark = docs.sparkSession
    grams = index.query_grams(spark.createDataFrame([(request.qid or "0", request.text)], "item_id string, text string"))
    smart = requests.flags_of(request.flags, requests.SEARCH_FLAGS).get("smart", False)
    return index.best_search(held, grams, smart, request.most or index.MAX_BACK)


__all__ = ["Engine", "answers", "completion_json", "found_entities", "guess_language", "normalised", "route", "searched", "spelled"]
