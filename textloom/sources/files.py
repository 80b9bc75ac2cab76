"""Readers of the engine's text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight of a phrase by its section.
SECTION_WEIGHT = {"T0": 1, "T1": 3, "T2": 2, "T4": 2}


def _parts(spark: SparkSession, path: str, sep: str, most: int) -> DataFrame:
    """(p): lines split at the separator into at most `most` parts; quotes mean nothing, the last part keeps the rest.

    Empty lines and lines that begin with # are left out.
    """
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.split("value", re.escape(sep), most).alias("p"))


def _part(i: int, kind: str = "string") -> Column:
    """The i-th part, trimmed; null where it is empty, missing or not of the kind."""
    return F.expr(f"try_cast(nullif(trim(get(p, {i})), '') AS {kind})")


def entity_file(spark: SparkSession, path: str) -> DataFrame:
    """class|subclass|id|relevance|name|topic class|topic subclass|topic id; lines from # on are comments."""
    kinds = {"cls": "int", "sub": "int", "id": "string", "relevance": "int", "name": "string", "topic_cls": "int", "topic_sub": "int", "topic_id": "string"}
    raw = _parts(spark, path, "|", len(kinds)).select(*[_part(i, k).alias(n) for i, (n, k) in enumerate(kinds.items())])
    return raw.withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def entity_properties(spark: SparkSession, path: str) -> DataFrame:
    """(cls, sub, id, name, relevance) of class|subclass|id|relevance|name: the longest name and the largest
    relevance that lines give for an entity."""
    raw = _parts(spark, path, "|", 5).select(_part(0, "int").alias("cls"), _part(1, "int").alias("sub"), _part(2).alias("id"), _part(3, "int").alias("relevance"), _part(4).alias("name"))
    longest = F.max(F.struct(F.length("name").alias("n"), "name")).alias("b")
    return raw.groupBy("cls", "sub", "id").agg(longest, F.coalesce(F.max("relevance"), F.lit(0)).alias("relevance")).select("cls", "sub", "id", "b.name", "relevance")


def phrase_file(spark: SparkSession, path: str) -> DataFrame:
    """DOC|Tn|number|text, with the weight of the section; the first title phrase counts double.

    A text may hold bars; lines of fewer than four parts are left out.
    """
    raw = _parts(spark, path, "|", 4).filter(F.size("p") == 4).select(_part(0).alias("doc"), F.upper(_part(1)).alias("section"), F.coalesce(_part(2, "int"), F.lit(0)).alias("number"), F.expr("get(p, 3)").alias("text"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_WEIGHT.items() for x in kv]), F.col("section")), F.lit(1))
    return raw.withColumn("weight", weight * F.when((F.col("section") == "T1") & (F.col("number") == 0), 2).otherwise(1))


#: Attributes of a record and the section that each fills.
RECORD_SECTIONS = {"Content": 0, "DocName": 1, "Keywords": 2, "Rubrics": 4}


def faq_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc, title, content, keywords, rubrics, begins, sort_name) of <root><table ID= ModuleID= DocName= Content= ../>..</root>.

    A document's name is module.id; texts are the attributes' as they are.
    """
    names = ("ID", "ModuleID", "DocName", "Content", "Keywords", "Rubrics", "BegDate", "SortName")
    raw = spark.read.format("xml").option("rowTag", "table").schema(", ".join(f"_{n} string" for n in names)).load(path)
    own = {"title": "DocName", "content": "Content", "keywords": "Keywords", "rubrics": "Rubrics", "begins": "BegDate", "sort_name": "SortName"}
    return raw.select(F.concat_ws(".", "_ModuleID", "_ID").alias("doc"), *[F.col(f"_{n}").alias(k) for k, n in own.items()])


def faq_phrases(records: DataFrame) -> DataFrame:
    """(doc, section, number, text) of records: each section's text without markup, cut into phrases.

    Keywords and rubrics are cut at semicolons as well.  Phrases of fewer than two letters or digits are left out;
    numbers count from 0 in each section.
    """
    from ..functions.text import phrases

    columns = {0: "content", 1: "title", 2: "keywords", 4: "rubrics"}
    one = records.select("doc", F.explode(F.array(*[F.struct(F.lit(f"T{k}").alias("section"), phrases(html_content(F.coalesce(c, F.lit("")))).alias("ps")) for k, c in columns.items()])).alias("s"))
    clean = F.filter(F.transform("s.ps", lambda p: F.regexp_replace(p, r"^[^\p{L}\p{N}]+", "")), lambda p: F.length(F.regexp_replace(p, r"[^\p{L}\p{N}]", "")) >= 2)
    return one.select("doc", F.col("s.section").alias("section"), F.posexplode(clean).alias("number", "text"))


def meanings_xml(spark: SparkSession, path: str, priority: int = 100) -> DataFrame:
    """(meaning, priority, word) of <synonyms><m n= p=><w v=/>..</m>..</synonyms>."""
    raw = spark.read.format("xml").option("rowTag", "m").schema("_n string, _p int, w array<struct<_v:string,_VALUE:string>>").load(path)
    return raw.select(F.col("_n").alias("meaning"), F.coalesce("_p", F.lit(priority)).alias("priority"), F.explode("w._v").alias("word")).filter("word IS NOT NULL").withColumn("word", F.lower("word"))


def expandable(meanings: DataFrame, mode: str = "one", threshold: int = 10) -> DataFrame:
    """(word, meaning): the meaning that stands for a word in rules.

    one: the only meaning of a word, if its priority is at most the threshold.  dominant: the meaning of the least
    priority, if the next one is larger by the threshold at least (or there is none).
    """
    if mode == "none":
        return meanings.select("word", "meaning").limit(0)
    ranked = meanings.groupBy("word").agg(F.array_sort(F.collect_set(F.struct("priority", "meaning"))).alias("m"))
    if mode == "one":
        good = (F.size("m") == 1) & (F.col("m")[0]["priority"] <= threshold)
    else:
        good = (F.size("m") == 1) | (F.get("m", F.lit(1))["priority"] >= F.col("m")[0]["priority"] + threshold)
    return ranked.filter(good).select("word", F.col("m")[0]["meaning"].alias("meaning"))


def synonym_file(spark: SparkSession, path: str, stem=None) -> DataFrame:
    """(group, word): one group per line, blank-separated; groups of fewer than two words are left out.

    stem: a function of columns that gives a word's stem; without one, words stay as they are.
    """
    own = stem or (lambda w: w)
    lines = spark.read.text(path).select(F.array_distinct(F.transform(F.filter(F.split(F.lower("value"), r"\s+"), lambda w: w != ""), own)).alias("w"))
    return lines.filter(F.size("w") > 1).select(F.xxhash64(F.array_join("w", " ")).alias("group"), F.explode("w").alias("word"))


def text_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(name, text): whole files of a folder."""
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))


def plain_html(html: Column) -> Column:
    """Markup off, by tags."""
    return F.regexp_replace(html, "<[^>]*>", "")


def entity_xml(spark: SparkSession, path: str) -> DataFrame:
    """(cls, sub, id, relevance, name) of <entlist c= s=><e i= r= n=><n>name</n>..</e>..</entlist>, a row per name.

    An entity's own class comes before that of its list; an entity without names has one row with a null name.
    """
    entity = "_c:int,_s:int,_i:string,_r:int,_n:string,n:array<string>"
    raw = spark.read.format("xml").option("rowTag", "entlist").schema(f"_c int, _s int, e array<struct<{entity}>>").load(path)
    one = raw.select(F.col("_c").alias("c"), F.col("_s").alias("s"), F.explode("e").alias("e"))
    names = F.array_compact(F.concat(F.array("e._n"), F.coalesce("e.n", F.array().cast("array<string>"))))
    out = one.select(F.coalesce("e._c", "c").alias("cls"), F.coalesce("e._s", "s").alias("sub"), F.col("e._i").alias("id"), F.coalesce("e._r", F.lit(0)).alias("relevance"), names.alias("ns"))
    return out.select("cls", "sub", "id", "relevance", F.explode_outer("ns").alias("name"))


def link_xml(spark: SparkSession, path: str) -> DataFrame:
    """(cls, sub, id, doc, weight) of <E c= s= i= w=><D i= w=/>..</E>: a document's weight, else its entity's, else 1."""
    raw = spark.read.format("xml").option("rowTag", "E").schema("_c int, _s int, _i string, _w double, D array<struct<_i:string,_w:double,_VALUE:string>>").load(path)
    one = raw.select(F.col("_c").alias("cls"), F.col("_s").alias("sub"), F.col("_i").alias("id"), "_w", F.explode("D").alias("d"))
    return one.select("cls", "sub", "id", F.col("d._i").alias("doc"), F.coalesce("d._w", "_w", F.lit(1.0)).alias("weight"))


def formatted_file(spark: SparkSession, path: str, layout: str, sep: str = "\t") -> DataFrame:
    """Delimited entities by a layout such as `id=0;name=2;relevance=1`: name of the column and its place from 0."""
    places = {k.strip(): int(v) for k, v in (x.split("=") for x in layout.split(";") if x.strip())}
    fields = range(max(places.values()) + 1)
    raw = _parts(spark, path, sep, len(fields) + 1)
    out = raw.select(*[_part(i).alias(k) for k, i in places.items()])
    return out.withColumn("relevance", F.coalesce(F.expr("try_cast(relevance AS int)"), F.lit(0))) if "relevance" in places else out


def content_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((doc, text), (doc, kind, value)) of C_BEGIN|id, lines of text, C_END|id, and TITLE|, POP.WEIGHT|, DOC_TAGID| lines.

    The reader cuts the file at C_BEGIN|, so that blocks are read in parallel and no order over lines is needed.
    """
    blocks = spark.read.option("lineSep", "C_BEGIN|").text(path)
    parts = blocks.select(F.regexp_extract("value", r"^([^\n|]*)\n", 1).alias("doc"), "value")
    body = F.regexp_extract("value", r"(?s)^[^\n]*\n(.*?)\n?C_END\|", 1)
    texts = parts.filter(F.col("value").contains("C_END|")).select("doc", body.alias("text"))
    rest = F.when(F.col("value").contains("C_END|"), F.substring_index("value", "C_END|", -1)).otherwise(F.col("value"))
    lines = parts.select(F.explode(F.split(rest, "\n")).alias("line")).select(F.split("line", r"\|", 3).alias("p"))
    kinds = {"TITLE": "title", "POP.WEIGHT": "weight", "DOC_TAGID": "tag"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("p")[0])
    return texts, lines.filter((F.size("p") == 3) & F.col("p")[0].isin(*kinds)).select(F.col("p")[1].alias("doc"), kind.alias("kind"), F.trim(F.col("p")[2]).alias("value"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq): a word per line, with a frequency behind it or 1."""
    w = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.lower(w[0]).alias("word"), F.coalesce(F.expr(r"try_cast(get(split(trim(value), '\\s+'), 1) AS long)"), F.lit(1)).alias("freq")).groupBy("word").agg(F.sum("freq").alias("freq"))


#: Character references that texts hold most.
REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def html_content(html: Column) -> Column:
    """Text outside of tags, scripts, styles and comments; references resolved, the ampersand last."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", "")
    for k, v in REFERENCES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out
