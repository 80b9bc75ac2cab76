"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, jaccard, media, mixing, ngram, pii, quality, suffixes, toxicity
from textloom.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_t", "_w", "_l", "_s", "_n", "_p", "_k", "_ctx", "_key", "_leaks", "_row", "score", "y", "slot", "set", "component", "size", "row")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


def _items(spark, rows=None):
    rows = [(1, "what is the capital of france it is paris of course"), (2, None), (None, "x y z"), (3, "")] if rows is None else rows
    return spark.createDataFrame(rows, "item_id long, text string")


def _rows():
    good = "the quiet river runs past the old stone mill and the people of the town walk there"
    rows = [(i, f"{good} w{i} x{i % 5} " * (1 + i % 3) if i % 2 else f"BUY %% !!! $$$ ||| k{i} " * 6, ["en", "de"][i % 2], "s", 0) for i in range(40)]
    rows += [(None, good, "en", None, None), (50, None, "en", "s", 0), (51, "", None, "s", 0), (52, " \t\n", "de", "s", 0), (1, rows[1][1], "en", "s", 0), (53, "long " * 60_000, "en", "s", 0), (54, "x" * 300_000, "en", "s", 0)]
    return [*rows, (55, "so what is the capital of france it is paris of course they said and mail me at a.b@c.de", "en", "s", 0)]


OPERATORS = {
    "op1": lambda s, d: quality.quality(d, _labels(s)),
    "op3": lambda s, d: mixing.mix(d, _labels(s)),
    "op4": lambda s, d: toxicity.toxicity(d, _labels(s)),
    "op5": lambda s, d: media.media_columns(d),
    "op6": lambda s, d: pii.pii(d),
    "op7": lambda s, d: suffixes.remove_repeats(d),
    "op9": lambda s, d: ngram.lm_scores(d),
    "op10": lambda s, d: jaccard.jaccard_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_whatever_its_columns(spark, name):
    rows = _rows()
    plain = spark.createDataFrame(rows, SCHEMA)
    out = OPERATORS[name](spark, plain).toPandas()
    assert len(out) == len(rows) and out["doc_id"].isna().sum() == 1
    clashing = plain
    for c in CLASHING:
        clashing = clashing.withColumn(c, F.lit("own"))
    more = OPERATORS[name](spark, clashing).toPandas()
    key = [c for c in out.columns if c not in ("posteriors",)]
    same = lambda p: sorted(map(tuple, p[key].astype(str).to_numpy().tolist()))
    assert same(out) == same(more)
    twice = out[out["doc_id"] == 1][key].astype(str)
    assert len(twice) == 2 and (twice.iloc[0] == twice.iloc[1]).all()
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


STAGES = {
    "quality": lambda s, d: quality.keep_good(d, quality.fit(d, _labels(s))),
    "jaccard": lambda s, d: jaccard.one_of_each(d),
    "leaks": lambda s, d: decontaminate.clean(d, _items(s)),
    "pii": lambda s, d: pii.redacted(d),
    "mixing": lambda s, d: mixing.mixed(d, _labels(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("own"))
    out = STAGES[name](spark, docs)
    assert [c for c in out.columns if c not in ("rate", "copies")] == docs.columns
    got = out.toPandas()
    assert 0 < len(got) <= len(_rows()) and all((got[c] == "own").all() for c in CLASHING)
    empty = STAGES[name](spark, spark.createDataFrame([], docs.schema))
    assert empty.count() == 0
    if name == "leaks":
        assert 55 not in set(got["doc_id"].dropna()) and len(got) == len(_rows()) - 1
    if name == "pii":
        assert "[EMAIL]" in got[got["doc_id"] == 55]["text"].iloc[0] and got["text"].isna().sum() == 1


def test_leaks_with_empty_tables(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    assert decontaminate.leaks(docs, _items(spark, [])).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], SCHEMA), _items(spark)).count() == 0
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, _items(spark)).collect()] == [(55, 1)]


def test_the_pipeline_runs_its_stages_in_turn(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    _items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test-stage")
        sizes.append(docs.count())
    assert all(b <= a for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) == sizes[-1] and list(out.columns) == [*corpus_pipeline.COLUMNS, "rate", "copies"]
    assert not out["text"].fillna("").str.contains("capital of france").any() and not out["text"].fillna("").str.contains("%% !!!").any()


def test_rules_equal_their_columns(spark):
    """The compiled column gives what the rules give in plain Python on the same statistics."""
    docs = spark.createDataFrame(_rows(), SCHEMA)
    model = quality.fit(docs, _labels(spark))
    stats = quality.with_statistics(docs.select("doc_id", "text")).select("_s.*").toPandas()
    want = []
    for _, row in stats.iterrows():
        total = model.bias
        for rule, weight in model.rules:
            if all((row[quality.STATS[j]] <= cut) if mark == "<=" else (row[quality.STATS[j]] > cut) for j, mark, cut in rule):
                total += weight
        want.append(1 / (1 + math.exp(-total)))
    got = quality.score(docs, model).toPandas()["score"]
    assert np.allclose(sorted(want), sorted(got))
    words = (_rows()[1][1] or "").split()
    one = stats.iloc[1]
    assert one["n_words"] == len(words) and one["distinct_words"] == len(set(words)) / len(words) and one["bangs"] == 0


@pytest.mark.parametrize("unrolled", [16, 0])
def test_posteriors_equal_plain_bayes(spark, monkeypatch, unrolled):
    monkeypatch.setattr(mixing, "UNROLLED", unrolled)
    docs = spark.createDataFrame(_rows(), SCHEMA)
    model = mixing.fit(docs, _labels(spark))
    out = {r.doc_id: r for r in mixing.mix(docs, _labels(spark)).collect() if r.doc_id is not None}
    for i, text, *_ in _rows():
        if i is None or i == 54:
            continue
        words = (text or "").lower().translate(str.maketrans(".,", "  ")).split()
        k = [words.count(w) for w in model.words]
        n = len((text or "").split())
        scale = min(1.0, mixing.MOST_EVIDENCE / max(n, 1))
        logs = [p + scale * (sum(c * model.weights[j][d] for j, c in enumerate(k)) + max(n - sum(k), 0) * model.other[d]) for d, p in enumerate(model.priors)]
        e = [math.exp(x - max(logs)) for x in logs]
        for d, name in enumerate(model.domains):
            assert math.isclose(out[i].posteriors[name], e[d] / sum(e), rel_tol=1e-6, abs_tol=1e-9), (i, name)


def test_all_domains_are_kept_and_unknown_targets_refused(spark):
    rows = [(i, f"word{i % 40} " * 20 + f"other{i}", f"d{i % 40}", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    out = mixing.mix(docs, lab)
    first = out.first()
    assert len(first.posteriors) == 40
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mix(docs, lab, {"d1": 0.5, "nowhere": 0.5})


def test_media_equal_brute_force(spark):
    rows = _rows()
    got = {r.doc_id: r for r in media.media_columns(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == __import__("zlib").crc32(payload[-64:]) and r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


def test_bm25_bound_hides_no_passage(spark):
    """Every passage that the exact score lets through is also found behind the matrix bound and the block maxima."""
    rng = np.random.default_rng(5)
    vocab = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab, 12))) for k in range(30)]
    texts = [" ".join([*rng.choice(vocab, 15), *items[k % 30][1].split(), *rng.choice(vocab, 15)]) for k in range(60)]
    texts += [" ".join(rng.choice(vocab, 40)) for _ in range(60)]
    index = decontaminate.ItemIndex(items)
    found = index.leaks(texts)
    assert all(k % 30 in found[k] for k in range(60)) and len(found) == 120
    alone = [index.leaks([t])[0] for t in texts]
    assert [set(a) for a in alone] == [set(f) for f in found]


def test_near_copies_do_not_teach_toxicity(spark):
    """A cluster of near copies of one toxic text must not make its plain words insults."""
    rng = np.random.default_rng(2)
    plain = [f"word{k}" for k in range(400)]
    text = lambda n=40: " ".join(rng.choice(plain, n))
    cluster = " ".join(f"rare{k}" for k in range(30)) + " gribblefink"
    texts = [text() for _ in range(150)] + [text(20) + " gribblefink " + text(20) for _ in range(40)] + [cluster + f" {text(2)}" for _ in range(30)]
    y = np.array([0] * 150 + [1] * 70)
    model, cache = toxicity.train(texts, y), {}
    p = lambda t: float(model.probability(model.text_margin(t, cache)))
    assert p(text() + " gribblefink") > 0.5 and p(text() + " grib-blefink") > 0.5 and p(text() + " g r i b b l e f i n k") > 0.5
    assert p(text()) < 0.5 and p(" ".join(f"rare{k}" for k in range(5)) + " " + text()) < 0.5


