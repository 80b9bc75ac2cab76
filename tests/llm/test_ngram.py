"""The language model against exact counts, on both ways of probing the filters."""

import random
import time
import zlib
from collections import Counter
from math import isclose, log10
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from textloom.llm import ngram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)


def _docs():
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{i}x{k} the" if k % 9 == 0 else f"w{i}x{k}" for k in range(150)) + " the end of it") for i in range(6)]
    docs += [(6, docs[0][1]), (7, None), (8, " ".join(docs[1][1].split()[::-1])), (9, ""), (10, " \t"), (11, "The THE \x00 \u00c4b \x0bthe")]
    docs += [(20 + k, " ".join(rng.choice(["the", "end", "of", "it", "a", f"r{rng.randrange(40)}"]) for _ in range(rng.randint(1, 300)))) for k in range(30)]
    return [*docs, (99, " ".join(f"long{k % 5000} of the" for k in range(30_000)))]


def _tokens(text):
    return (text or "").encode().lower().split() + [b" "]


@pytest.mark.parametrize("near", [1 << 27, 0])
@pytest.mark.parametrize("flush", [2_000_000, 500])
def test_scores_equal_exact_counts(spark, monkeypatch, near, flush):
    monkeypatch.setattr(ngram, "BROADCAST_TEXT", near)
    monkeypatch.setattr(ngram, "FLUSH_TOKENS", flush)
    monkeypatch.setattr(ngram, "BITS_PER_ENTRY", 512)  # no chance hits
    tune, weights = ngram._tune, []
    monkeypatch.setattr(ngram, "_tune", lambda *a: (weights.append((tune(*a), a[2].sum())), np.full(ngram.CLASSES, 0.5))[1])
    tok = {i: _tokens(t) for i, t in _docs()}
    train = [ws for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip([None, *ws], ws))  # noqa: B905
    assert min(pairs.values()) == 1
    n, total = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)

    def middle(k, levels):
        return ngram.middle(levels)[np.searchsorted(levels, k, side="right")]

    rows = ngram.lm_scores(_frame(spark, _docs())).collect()
    assert len(rows) == len(tok)
    for r in rows:
        ws = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert isclose(r.base_score, sum(log10((c[w] + 0.5) / total) for w in ws), rel_tol=1e-9)
        want = 0.0
        for a, b in zip([None, *ws], ws):  # noqa: B905
            now, before = middle(c[b], ngram.WORD_LEVELS), middle(c[b" " if a is None else a], ngram.WORD_LEVELS)
            w = 0.5 if before >= 1 else 0.0
            want += np.log10((1 - w) * (now + 0.5) / total + w * min(middle(pairs[a, b], ngram.PAIR_LEVELS), before) / max(before, 1))
        assert isclose(r.score, want, rel_tol=1e-9), (r.doc_id, r.score, want)
    # the weights are fitted on all training tokens whose word before is known well enough
    assert (weights[0][0] > 0).any() and weights[0][1] == sum(middle(c[b" " if a is None else a], ngram.WORD_LEVELS) >= 1.5 for ws in train for a, _ in zip([None, *ws], ws))  # noqa: B905


def test_both_ways_give_the_same(spark, monkeypatch):
    want = ngram.lm_scores(_frame(spark, _docs())).toPandas().sort_values("doc_id", ignore_index=True)
    monkeypatch.setattr(ngram, "BROADCAST_TEXT", 0)
    got = ngram.lm_scores(_frame(spark, _docs())).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want)


def test_the_model_beats_the_base_on_held_out_documents(spark):
    rng = random.Random(7)
    follow = {k: [rng.randrange(60) for _ in range(3)] for k in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(120):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    rows = ngram.lm_scores(_frame(spark, [(i, text()) for i in range(150)])).filter("held_out").toPandas()
    assert rows["score"].sum() > 0.8 * rows["base_score"].sum()


@pytest.mark.parametrize("near", [1 << 27, 0])
def test_edges(spark, monkeypatch, near):
    monkeypatch.setattr(ngram, "BROADCAST_TEXT", near)
    assert ngram.lm_scores(_frame(spark, [])).count() == 0
    rows = [(None, "a b c d " * 30), (2**63 - 1, "a b c d " * 30), (1, "a b c d " * 30), (1, "a b c d " * 30), (None, None)]
    table = _frame(spark, rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "bucket").withColumnRenamed("n_chars", "score")
    out = ngram.lm_scores(table).toPandas()
    assert len(out) == 5 and out["doc_id"].isna().sum() == 2 and (out["doc_id"] == 2**63 - 1).sum() == 1
    held = ngram.lm_scores(_frame(spark, [(k, "x y") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1])).toPandas()
    assert len(held) and (held["score"] == 0).all() and (held["train_tokens"] == 0).all()


def test_bloom_counts_round_trip():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    level = np.random.default_rng(3).integers(1, 9, len(keys))
    bloom = ngram.BloomCounts.of(keys[:3000], level[:3000])
    found = bloom.level_of(keys)
    assert (found[:3000] >= level[:3000]).all() and (found[:3000] == level[:3000]).mean() > 0.9
    assert (found[3000:] == 0).mean() > 0.9


@pytest.mark.parametrize("near", [1 << 27, 0])
def test_each_step_leaves_no_shuffle_files_to_the_next(spark, monkeypatch, near):
    """Else the disk of a run depends on when the driver collects its garbage."""
    monkeypatch.setattr(ngram, "BROADCAST_TEXT", near)
    folders = [Path(d.getPath()) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.glob("*/shuffle_*.data")}
    real, left = ngram.materialize, {}

    def watched(df, tag, *more):
        before, out = files(), real(df, tag, *more)
        for _ in range(40):  # they are deleted in the background
            if not (own := files() - before):
                break
            time.sleep(0.1)
        left[tag] = len(own)
        return out

    monkeypatch.setattr(ngram, "materialize", watched)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    assert ngram.lm_scores(_frame(spark, _docs())).count() == len(_docs())
    assert left == {"ngram": 0, "ngram-blocks": 0} and spark.conf.get(key) == setting
