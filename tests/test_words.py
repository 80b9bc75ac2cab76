import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import words as W
from textloom.operators import index as I
from textloom.operators import mining as M
from textloom.operators import names as N
from textloom.plans.rewriter import Grammar
from textloom.plans.rules import compile_rules, load_rules


def _apply(spark, f, *words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", f(F.col("w")).alias("o")).collect()
    return {r.w: r.o for r in rows}


def test_english_stems(spark):
    one = _apply(spark, W.singular, "churches", "cities", "campuses", "tables", "status", "cars", "boxes", "shoes", "bus", "corpora", "axes", "at")
    assert one == {"churches": "church", "cities": "city", "campuses": "campus", "tables": "table", "status": "status", "cars": "cars", "boxes": "box", "shoes": "shoe", "bus": "bu", "corpora": "corpus", "axes": "ax", "at": "at"}
    now = _apply(spark, W.present, "carried", "argued", "agreed", "showed", "cleaned", "happened", "baked", "stopped", "ranged", "walked", "stirred", "singing", "red")
    assert now == {"carried": "carry", "argued": "argue", "agreed": "agreed", "showed": "show", "cleaned": "clean", "happened": "happene", "baked": "bake", "stopped": "stop", "ranged": "range", "walked": "walk", "stirred": "stir", "singing": "singing", "red": "red"}


def test_russian_stems_and_spelling(spark):
    got = _apply(spark, W.russian_stem, "книгами", "красивая", "красивый", "дом", "дома", "прочитавши", "ёлка", "")
    assert got["красивая"] == got["красивый"] and got["дом"] == got["дома"] == "дом" and got["книгами"] == "книг" and got["прочитавши"] == "прочита" and got["ёлка"] == "елк" and got[""] == ""
    assert _apply(spark, W.to_russian, "zhizn' i shchuka")["zhizn' i shchuka"] == "жизнь и щука"
    assert _apply(spark, W.to_latin, "щука и жизнь")["щука и жизнь"] == "shchuka i zhizn'"


def test_sounds(spark):
    assert _apply(spark, W.sound, "balloon", "Apples", "cat") == {"balloon": "bln", "Apples": "apls", "cat": "cat"}
    assert _apply(spark, W.once, "aabbccddeeff", "aab") == {"aabbccddeeff": "abcdef", "aab": "aab"}
    assert _apply(spark, W.swaps, "abc", "a", "") == {"abc": ["bac", "acb"], "a": [], "": []}


def test_pieces_offsets_and_groups(spark):
    assert _apply(spark, X.pieces, "Ab1, é  x")["Ab1, é  x"] == ["Ab", "1", ",", " ", "é", " ", "x"]
    docs = spark.createDataFrame([(1, " the quick-fox\n42 "), (2, ""), (3, None)], "doc_id int, text string")
    assert [(r.pos, r.off, r.tok) for r in X.space_tokens(docs).orderBy("pos").collect()] == [(0, 1, "the"), (1, 5, "quick-fox"), (2, 15, "42")]
    cut = X.retokenised(X.space_tokens(docs), spark.createDataFrame([("the",)], "tok string")).orderBy("pos", "sub").collect()
    assert [(r.off, r.tok) for r in cut] == [(1, "the"), (5, "quick"), (10, "-"), (11, "fox"), (15, "42")]
    assert _apply(spark, X.grouped_number, "1,234,567.5", "1 000", "12,34", "1.2.3", "7") == {"1,234,567.5": 1234567.5, "1 000": 1000.0, "12,34": None, "1.2.3": None, "7": 7.0}


def test_spelling(spark):
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "tok string")
    vocab = spark.createDataFrame([("banana", 5), ("orange", 3), ("cherry", 2), ("melon", 9), ("table", 4)], "tok string, freq long")
    got = {r.word: (r.correction, r.priority) for r in W.variant_corrections(words("bananna", "oragne", "cherrry", "ьудщт", "chirru", "zzzz"), vocab).collect()}
    assert got == {"bananna": ("banana", 1), "oragne": ("orange", 3), "cherrry": ("cherry", 1), "ьудщт": ("melon", 4), "chirru": ("cherry", 5)}
    near = {r.word: (r.correction, r.distance) for r in W.feature_corrections(words("bananas", "orenge", "tabel", "cat"), vocab).collect()}
    assert near == {"bananas": ("banana", 1), "orenge": ("orange", 1), "tabel": ("table", 2)}
    marks = {r.word: r.stem for r in W.punctuation_stems(words("(melon", "table!!", "d'orange", "melon's", "d'table's.", "table"), vocab).collect()}
    assert marks == {"(melon": "melon", "table!!": "table", "d'orange": "orange", "melon's": "melon", "d'table's.": "table"}


def test_names(spark):
    names = spark.createDataFrame([("Saint Petersburg",), ("Petersfield",), ("Philadelphia",)], "name string")
    q = spark.createDataFrame([(1, "petersburg"), (2, "filadelfia"), (3, "")], "qid int, q string")
    assert {r.name for r in N.match_names(names, q).filter("qid = 1").collect()} == {"saint petersburg"}
    assert N.longest_common("abcde", "xbcdy") == 3 and N.longest_common("", "a") == 0
    heard = N.match_sounds(names, spark.createDataFrame([(1, "phylydelphya")], "qid int, q string")).collect()
    assert [r.name for r in heard] == ["philadelphia"] and heard[0].coverage > 0.9
    long_ = N.boosted_long(N.match_names(names, q).join(q, "qid")).filter("qid = 1").first()
    assert long_.coverage > N.match_names(names, q).filter("qid = 1").first().coverage or long_.coverage == 1
    runs = N.islands(spark.createDataFrame([(1, "zz petersburg zz")], "qid int, q string"), names).collect()
    assert [(r.name, r["last"] - r["first"]) for r in runs] == [("saint petersburg", 9)]


def test_completions(spark):
    names = spark.createDataFrame([("apple pie", 2), ("apricot", 0), ("banana", 5)], "name string, relevance int")
    asked = spark.createDataFrame([("a",), ("ap",), ("apr",), ("bananas",), ("banan",)], "prefix string")
    got = {(r.prefix, r.name): r["rank"] for r in N.autocomplete(names, asked).collect()}
    assert got == {("a", "apple pie"): 1, ("a", "apricot"): 2, ("ap", "apple pie"): 1, ("ap", "apricot"): 2, ("apr", "apricot"): 1, ("banan", "banana"): 1}
    filled = N.completed_or_searched(N.autocomplete(names, asked), names, asked).filter("prefix = 'bananas'").collect()
    assert [(r.name, r["rank"]) for r in filled] == [("banana", 1)]


@pytest.mark.parametrize("run", [lambda s, e: N.match_names(e, e.select(F.col("name").alias("qid"), F.col("name").alias("q"))), lambda s, e: N.autocomplete(e.withColumn("relevance", F.lit(0)), e.select(F.col("name").alias("prefix"))), lambda s, e: M.keyword_grams(e.select(F.col("name").alias("text")))])
def test_empty_tables(spark, run):
    assert run(spark, spark.createDataFrame([], "name string")).count() == 0


def test_keywords_of_phrases(spark):
    rows = spark.createDataFrame([(t,) for t in ("new york city is big", "new york city is old", "red car", "red car", "the car")], "text string")
    got = {r.gram: r.n for r in M.keyword_grams(rows).collect()}
    assert got == {"new york city": 2, "york city is": 2} | {k: v for k, v in got.items() if " " not in k} and "red" in got or "red car" not in got


def test_subtraction_and_geography(spark):
    grammar = [Grammar(compile_rules(load_rules("<s><stmt><pat><t>rome</t></pat><tran><mkent c='1' s='1' i='r'/></tran></stmt></s>")))]
    rows = spark.createDataFrame([("d", "T0", 4, "old rome 5 big walls"), ("d", "T0", 5, None)], "doc string, section string, number int, text string")
    assert [(r.number, r.text) for r in M.subtracted(rows, grammar).orderBy("number").collect()] == [("4.0", "old"), ("4.1", "big walls")]
    points = spark.createDataFrame([(1, 359.0, 0.0), (2, 50.0, 0.0)], "id int, lon double, lat double")
    held = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 7)], "id int, sub int")
    assert sorted((r.id, r.sub) for r in N.geo_filter(held, points, 1.0, 0.0, 5.0, [7]).collect()) == [(1, 7), (2, 8), (3, 7)]


def test_search_leaves_other_grams_in_the_scan(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x")], "doc_id int, text string")
    asked = spark.createDataFrame([(9, "a"), (9, "zz")], "item_id int, gram string")
    out = I.search(docs, asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    counted = [k for k, line in enumerate(plan) if re.search(r"Aggregate \[gram#\d+, doc_id#\d+\]", line)]
    assert counted and all(any("LeftSemi" in line for line in plan[k : k + 4]) for k in counted)
    assert [(r.doc_id, r["rank"]) for r in out.collect()] == [(1, 1), (2, 2)]


def test_features_spelling_and_storage(spark, tmp_path):
    rows = spark.createDataFrame([("wrods", "wrod", "words"), ("abcde", "abcd", "xyzde"), ("q", None, None)], "word string, stem string, correction string")
    assert {r.word: r.tok for r in I.kept_spelling(rows).collect()} == {"wrods": "wrod", "abcde": "abcd", "q": "q"}
    links = I.weighted_postings(spark.createDataFrame([("g", 1, 2, 5, 1), ("g", 1, 7, 3, 2)], "gram string, doc_id int, weight int, pos int, len int"))
    assert tuple(links.first()) == ("g", 1, 7, 2, 3, 2)
    I.stored(links, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
