"""What makes queries fail on large tables, seen on small ones."""

import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import queries as engine
from textloom.functions import words as W
from textloom.operators import documents as D
from textloom.operators.nearest import Index

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_no_tokens_join_to_null(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, "?! --"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r["head"], r.cut) for r in engine.QUERIES["truncated_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: ("one two", False), 2: (None, False), 3: (None, False), 4: (None, None)}


def test_class_words_are_made_once(spark):
    words = spark.createDataFrame([("babbies",), ("stopped",), ("Щётка",), ("aab",), ("",)], "tok string")
    out = words.select("tok", W.class_word(F.col("tok")).alias("word"), W.sound(F.col("tok")).alias("sound"))
    assert max(line.count("tok#") for line in _plan(out)) <= 12  # over 20,000 when each use makes the word anew
    assert {r.tok: r.word for r in out.collect()} == {"babbies": "baba", "stopped": "stap", "Щётка": "shchatka", "aab": "ab", "": ""}


def test_sounds_are_of_distinct_names(spark):
    lines = _plan(engine.QUERIES["name_sounds"](spark, SF))
    for k, line in enumerate(lines):
        if "Relation [" in line:  # from a table up to what makes its rows distinct, no pattern is tried
            depth, held = line.index("Relation"), []
            for above in reversed(lines[:k]):
                if "Aggregate" in above:
                    break
                held.append(above)
            assert not any("regexp_replace" in x for x in held), (depth, held)


def test_equal_texts_are_rewritten_once(spark):
    lines = _plan(engine.QUERIES["rule_functions"](spark, SF))
    at = next(k for k, line in enumerate(lines) if "MapInPandas" in line)
    assert any("Aggregate [text" in line for line in lines[at:])
    assert engine.QUERIES["rule_functions"](spark, SF).count() == 16 * spark.read.parquet(f"{SF}/part.parquet").count()


IN_ROWS = ("postings", "postings_bigrams", "postings_trigrams", "top_feature", "feature_positions", "term_shares", "weighted_postings", "bead_features", "best_chunk", "chunk_ranks", "language_guess")


@pytest.mark.parametrize("name", IN_ROWS)
def test_documents_are_not_shuffled(spark, name):
    plan = engine.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ("search_default", "search_smart", "json_answers"))
def test_search_passes_on_the_best_only(spark, name):
    lines = _plan(engine.QUERIES[name](spark, SF))
    assert any("MapInArrow" in x for x in lines) and not any("Generate" in x or "Join" in x for x in lines)


def test_rare_features_shuffle_counts_only(spark):
    assert not any("Join" in x for x in _plan(engine.QUERIES["rare_features"](spark, SF)))


REPEATED = ("postings", "document_frequency", "rare_features", "top_feature", "feature_positions", "term_shares", "search_default", "search_smart", "best_chunk", "tag_centroids")


@pytest.mark.parametrize(("name", "again"), [(n, True) for n in REPEATED] + [(n, False) for n in (*REPEATED, *IN_ROWS, "truncated_tokens", "keyword_grams", "retokenised_words", "tokens_space") if n != "chunk_ranks"])
def test_odd_documents_equal_sql(spark, tmp_path, name, again):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["the", "The", "of", "éa", "a", "12", "0012", "1234567890123", "x1y", "zz", f"w{rng.randrange(9)}", rng.choice("bcdfghjk") + rng.choice("lmnpqrst") * 2]) for _ in range(n))
    rows = [(k, text(rng.randrange(90)), rng.choice(["en", "de", "fr"]), "s") for k in range(40)] + [(90, "", "en", "s"), (91, None, "de", "s"), (92, "?!", "de", "s"), (93, "a", "fr", "s")]
    rows += [(k, text(30), "en", "s") for k in (3, 3, 7, 90)] if again else []
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string"), "labels": ([(k, k % 2, 0) for k in range(0, 40, 3)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(5, "the zz of"), (1, "A éa 12 w1 w2"), (2, "?"), (8, "nothing here w3")], "item_id long, text string"), "part": ([("The", "m1"), ("zz", "m2"), ("zz", "m3"), ("12", "m4")], "p_brand string, p_type string"),
    }
    con = duckdb.connect()
    for t, (held, schema) in tables.items():
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = engine.QUERIES[name](spark, str(tmp_path))
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = con.execute(engine.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert got == sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall()), key=str) and got


def test_slices_give_the_same(monkeypatch):
    rng = random.Random(2)
    texts = [[rng.choice("abcdefgh") for _ in range(n)] for n in (40, 0, 3, 300, 7, 90)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "t"])
    asked = D.Asked(pa.table({"item_id": [i for i in range(9) for _ in range(3)], "gram": [g for i in range(9) for g in rng.sample("abcdexyz", 3)]}))

    class Rows:
        schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: sorted(tuple(r.values()) for b in run([batch, batch]) for r in b.to_pylist())

    held = SimpleNamespace(value=asked)
    made = lambda: [D.chunks(Rows(), held, 20, "bigint", first) for first in (True, False)] + [D.best_documents(Rows(), held, lambda code, n: 0.1 * (code + n), 2, "bigint")]
    want = made()
    for slice_, cells in ((20, 9), (1, 1), (500, 18)):
        monkeypatch.setattr(D, "SLICE", slice_)
        monkeypatch.setattr(D, "CELLS", cells)
        assert made() == want
    assert len(want[0]) > 40 and len(want[1]) > 100 and len(want[2]) == 18


@pytest.mark.parametrize("most", (3, 40, 2048))
def test_nearest_word_equals_brute_force(most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 70])))
    known = sorted({word() for _ in range(300)} | {"a" * 69 + "b"})
    grams = lambda w: list(dict.fromkeys(f" {w} "[i : i + 3] for i in range(len(w))))
    index = Index(pa.array(known), pa.array([grams(w) for w in known]))
    place = {g: k for k, g in enumerate(index.gram.to_pylist())}
    df = {g: sum(g in grams(w) for w in known) for g in place}

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for w in {word() for _ in range(150)} - set(known) | {"a" * 70}:
        weight = {x: sum(1 / df[g] ** 2 for g in set(grams(w)) & set(grams(x))) for x in known if abs(len(x) - len(w)) <= 3 and set(grams(w)) & set(grams(x))}
        tried = sorted(weight, key=lambda x: (-round(weight[x], 9), x))[:most]
        near = [(far(w, x), -len(x), x) for x in tried]
        want = min([x for x in near if x[0] == 1 or x[0] == 2 and len(w) >= 5 or x[0] == 3 and len(w) >= 7], default=None)
        got = index.nearest(w, np.array([place[g] for g in grams(w) if g in place], np.int64), len(grams(w)), most, 3)
        assert got == (want and (want[2], want[0])), w


def test_spelling_joins_no_pairs(spark):
    assert not any("Join" in x for x in _plan(engine.QUERIES["feature_spelling"](spark, SF)))


def test_only_even_grams_are_shuffled(spark):
    rows = spark.createDataFrame([(0, t.split()) for t in ("new york is big", "new york is old", "is it", "new york")], "k int, t array<string>")
    one = D.phrase_words(rows).groupBy("gram").agg(F.sum("n").alias("n")).filter("n >= 2")
    counts = D.Counts(one)
    made = lambda k: {r.gram for r in D.even_grams(rows, spark.sparkContext.broadcast(counts), k).collect()}
    assert counts.of(pa.array(["new", "big", "york"])).tolist() == [3, 0, 3] and counts.n.tolist().count(3) == 3
    assert made(2) == {"new york", "york is"} and made(3) == {"new york is"}
    counts.n = np.where(counts.n == counts.of(pa.array(["york"]))[0], -1, counts.n)  # as of equal hashes: nothing is dropped for them
    assert made(2) == {"new york", "york is"}
