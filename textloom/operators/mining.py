"""Keywords of phrases, what rules understand of them, and which rules name or fill."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrases, token_array
from . import documents as D
from ..plans.answers import left_over
from ..plans.rewriter import Grammar, parse


def phrase_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number, text): phrases of documents, numbered from 0."""
    return docs.select(key, F.posexplode(phrases(F.col("text"))).alias("number", "text"))


def phrase_grams(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(gram, n): grams of a size and the number of phrases that have them."""
    t = F.transform(F.sequence(F.lit(0), F.size("t") - size), lambda i: F.array_join(F.slice("t", i + 1, size), " "))
    held = rows.select(token_array(F.col("text")).alias("t")).filter(F.size("t") >= size)
    return held.select(F.explode(F.array_distinct(t)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


COUNTS_MOST = 16_000_000  # words with a count that go to every task, 16 bytes each


def keyword_grams(rows: DataFrame, least: int = 2) -> DataFrame:
    """(gram, n): keywords of phrases (.., text): grams of `least` phrases or more.

    A trigram is one if each of its parts occurs in as many phrases as itself (and so in the same); a bigram if its words
    do and no such trigram has it; a word if some such bigram lacks it and no such trigram has it.
    """
    texts = rows.select(F.lit(0).alias("k"), F.coalesce(token_array(F.col("text")), F.array().cast("array<string>")).alias("t"))
    summed = lambda made: made.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).localCheckpoint()  # noqa: E731  each is read more than once
    one = summed(D.phrase_words(texts))
    if one.count() <= COUNTS_MOST:  # other grams than those of words with the same count are none, and are not shuffled
        sent = rows.sparkSession.sparkContext.broadcast(D.Counts(one))
        two, three = (summed(D.even_grams(texts, sent, k)) for k in (2, 3))
    else:
        two, three = (phrase_grams(rows, k).filter(F.col("n") >= least).localCheckpoint() for k in (2, 3))
    word = lambda k: F.split("gram", " ")[k]

    def whole(grams: DataFrame, parts: list) -> DataFrame:
        """Grams whose parts (expressions) all have their count."""
        own = grams.withColumn("parts", F.array_distinct(F.array(*parts)))
        named = own.select("gram", "n", F.size("parts").alias("w"), F.explode("parts").alias("part"))
        known = one.unionByName(two).select(F.col("gram").alias("part"), F.col("n").alias("m"))
        return named.join(known, "part").filter("n = m").groupBy("gram", "n", "w").agg(F.count("*").alias("k")).filter("k = w").select("gram", "n")

    pairs = [F.concat_ws(" ", word(0), word(1)), F.concat_ws(" ", word(1), word(2))]
    good3 = whole(three, [word(0), word(1), word(2), *pairs])
    inner = good3.select(F.explode(F.array(*pairs)).alias("gram")).distinct()
    good2 = whole(two, [word(0), word(1)]).join(inner, "gram", "left_anti")
    in3 = good3.select(F.explode(F.split("gram", " ")).alias("gram")).distinct()
    in2 = good2.select("gram", F.explode(F.array_distinct(F.split("gram", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("k")).withColumnRenamed("w", "gram")
    all2 = good2.agg(F.count("*").alias("all2"))
    good1 = one.join(in3, "gram", "left_anti").join(in2, "gram", "left").join(F.broadcast(all2)).filter(F.coalesce("k", F.lit(0)) < F.col("all2")).select("gram", "n")  # one row
    return reduce(DataFrame.unionByName, [good3, good2, good1])


def subtracted(rows: DataFrame, grammars: list[Grammar]) -> DataFrame:
    """(doc, section, number, text): what rules leave of phrases (doc, section, number, text), piece by piece.

    Entities are taken out; numbers and fluff go with what they stand beside, words stay.  number is `n.i` for the i-th
    piece of phrase n.
    """
    sent = rows.sparkSession.sparkContext.broadcast(grammars)

    def pieces(text: str) -> list[str]:
        chain, _ = parse(text, sent.value)
        cut, held = [], []
        for b in chain:
            kind = b["kind"]
            if kind in ("number", "fluff", "blank") or kind == "punct" and b["value"] not in "-.!,":
                held += b["at"]
                continue
            cut += held
            held = []
            if kind in ("entity", "entities", "erc", "evr"):
                cut += b["at"]
        out, end = [], 0
        for a, e in sorted([*cut, *held, [len(text), len(text)]]):
            if part := text[end:a].strip():
                out.append(part)
            end = max(end, e)
        return out

    def run(batches):
        for b in batches:
            made = [(d, s, f"{n}.{i}", p) for d, s, n, t in zip(b["doc"], b["section"], b["number"], b["text"], strict=True) for i, p in enumerate(pieces(t or ""))]
            yield pd.DataFrame(made, columns=["doc", "section", "number", "text"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "section", "number", "text").mapInPandas(run, f"doc {kind}, section string, number string, text string")


def understood(rows: DataFrame, grammars: list[Grammar], key: str = "doc_id") -> DataFrame:
    """(key, beads, rest): a batch of texts parsed: values as JSON, and the parts that no value covers."""
    sent = rows.sparkSession.sparkContext.broadcast(grammars)

    def run(batches):
        for b in batches:
            out = []
            for k, text in zip(b[key], b["text"], strict=True):
                chain, _ = parse(text or "", sent.value)
                out.append((k, json.dumps([[x["kind"], x["value"]] for x in chain], ensure_ascii=False, default=str), left_over(text or "", chain)["low"]))
            yield pd.DataFrame(out, columns=[key, "beads", "rest"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInPandas(run, f"{key} {kind}, beads string, rest array<string>")


#: Entities up to which a path names them; shares of all entities that bound names and fluff.
NAME_MOST, NAME_SHARE, FLUFF_SHARE = 8, 2001, 200


def path_kinds(paths: DataFrame) -> DataFrame:
    """(path, entities, kind): what a literal path of rules is, by the entities that it leads to.

    paths: (path, cls, id), a row per path and entity.  name: it leads to fewer than NAME_MOST entities, or to fewer
    than one in NAME_SHARE and one; or, class by class, to so few of some class that these stay under the bound for
    all.  fluff: it leads to one in FLUFF_SHARE of all at least, and to NAME_MOST and the bound of every class.
    """
    rows = paths.select("path", "cls", "id").distinct()
    total = rows.select("cls", "id").distinct()
    by_class = total.groupBy("cls").agg(F.count("*").alias("class_total"))
    bound = lambda n: 1 + F.floor(n / NAME_SHARE)
    all_ = total.agg(F.count("*").alias("total"))
    own = rows.groupBy("path", "cls").agg(F.count("*").alias("k")).join(by_class, "cls").withColumn("few", (F.col("k") < NAME_MOST) | (F.col("k") < bound(F.col("class_total"))))
    each = own.groupBy("path").agg(F.sum("k").alias("entities"), F.sum(F.when(F.col("few"), F.col("k")).otherwise(0)).alias("few"), F.max("few").alias("any_few"))
    rated = each.join(F.broadcast(all_))  # one row
    most = bound(F.col("total"))
    name = (F.col("entities") < NAME_MOST) | (F.col("entities") < most) | ((F.col("few") > 0) & (F.col("few") < most))
    fluff = ~F.col("any_few") & (F.col("entities") * FLUFF_SHARE >= F.col("total"))
    return rated.select("path", F.col("entities").cast("long").alias("entities"), F.when(name, "name").when(fluff, "fluff").otherwise("other").alias("kind"))


def entity_rules(paths: DataFrame) -> DataFrame:
    """(cls, id, rules): the rules that make an entity, of (rule, cls, id)."""
    return paths.groupBy("cls", "id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def compared(got: DataFrame, want: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, score): how far answers differ: weighted mismatches of columns, bent to 0 to 100; a missing answer is 100."""
    both = want.select(key, *[F.col(c).alias(f"w_{c}") for c in weights]).join(got.select(key, *weights, F.lit(True).alias("found")), key, "left")
    off = sum((F.when(F.col(c).eqNullSafe(F.col(f"w_{c}")), 0.0).otherwise(float(x)) for c, x in weights.items()), F.lit(0.0))
    score = F.when(F.col("found"), F.lit(200 / 3.141592653589793) * F.atan(off / 10)).otherwise(100.0)
    return both.select(key, F.round(score, 6).alias("score"))


def dump(postings: DataFrame, path: str, most: int | None = None) -> None:
    """Writes grams with their document frequency as tab-separated text, most frequent first."""
    counted = postings.groupBy("gram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "gram")
    (counted if most is None else counted.limit(most)).write.mode("overwrite").option("sep", "\t").csv(path)


def statistics(postings: DataFrame) -> DataFrame:
    """One row: grams, links, documents and the largest document frequency."""
    per = postings.groupBy("gram").agg(F.count("*").alias("df"))
    a = per.agg(F.count("*").alias("grams"), F.sum("df").alias("links"), F.max("df").alias("most"))
    return a.join(F.broadcast(postings.agg(F.countDistinct("doc_id").alias("documents"))))  # one row each


def ranked_keywords(grams: DataFrame, most: int) -> DataFrame:
    """The keywords of most phrases, with their places."""
    w = Window.orderBy(F.desc("n"), "gram")
    return grams.orderBy(F.desc("n"), "gram").limit(most).withColumn("place", F.row_number().over(w).cast("long"))
