"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and long texts."""

import hashlib
import os
import random
import re
import zlib

import pandas as pd
import pytest

from textloom.llm import chat, common, components, decontaminate, jaccard, media, mixing, ngram, pii, quality, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "se") for b in ("n", "r", "t") for c in ("a", "eo", "ul")]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, _text(rng, rng.randint(20, 120))) for i in range(60)]
    base = rows[3][1]
    words = base.split()
    rows += [(100 + k, " ".join([*words[:k], "odd", *words[k + 1 :]])) for k in range(0, len(words), 9)]
    rows += [(200, base), (201, base), (202, None), (203, ""), (204, " \t"), (205, "one two"), (206, "one two")]
    rows += [(207, rows[7][1] + " " + rows[8][1]), (208, "ab" * 400), (209, _text(rng, 30000)), (210, "x" * 300 + " mail a.b@c.de; 10.0.0.1; 4111 1111 1111 1111; +1 (555) 010-9999; 1.2.3.400")]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, docs):
    return _frame(spark, docs).cache()


def test_jaccard_components(spark, docs, table):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len(set(v for _, v in got.values())) < len(docs) - 3
    kept = jaccard.one_of_each(table)
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if find(i) == i}
    assert kept.columns == table.columns


def test_results_do_not_depend_on_slots(spark, docs, table, monkeypatch):
    want = {r.doc_id for r in jaccard.one_of_each(table).collect()}
    monkeypatch.setattr(jaccard, "SLOTS", 64)  # nearly every slot holds ids of both kinds
    extra = _frame(spark, [(None, docs[0][1]), (docs[3][0], docs[3][1])])
    kept = jaccard.one_of_each(table.unionByName(extra)).collect()
    assert {r.doc_id for r in kept} == want | {None} and len(kept) == len(want) + 1


def test_discard_keeps_inputs(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "textloom-input"))
    given = spark.read.parquet(str(tmp_path / "textloom-input"))
    made = common.materialize(given, "test")
    folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    common.discard(given, made)
    assert given.count() == 5 and not os.path.exists(folder)


def test_bitmap(spark):
    packed = common.bitmap(spark.range(50).withColumnRenamed("id", "doc_id"), 1 << 12)
    slots = spark.range(1000).withColumnRenamed("id", "doc_id").select(common.slot_of(1 << 12).alias("s")).toPandas()["s"].to_numpy()
    hit = common.in_bitmap(packed, slots)
    assert hit[:50].all() and hit.sum() == len([s for s in slots if s in set(slots[:50])])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_components_cost_few_steps(spark, monkeypatch, chunk):
    """Edges that fit in a chunk are written twice, however long their chains are; more chunks give the same."""
    monkeypatch.setattr(components, "CHUNK", chunk, raising=False)
    real, written = components.materialize, []
    monkeypatch.setattr(components, "materialize", lambda df, tag, *more: written.append(tag) or real(df, tag, *more))
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(200) if i % 40] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5] + [(-(1 << 62), 1 << 62), (999, 999)]
    least = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(least.items())
    assert chunk == 7 or len(written) == 2
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()


def test_suffix_repeats(docs, table):
    seen, want = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(c for c, v in zip(b, cover, strict=True) if not v)
        want[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(table).collect()}
    assert got == want


def test_tuple_queue_spills():
    import numpy as np

    rng = np.random.default_rng(1)
    q, all_ = suffixes.TupleQueue(500), []
    for _ in range(9):
        k, v = rng.integers(0, 300, 200), rng.integers(0, 9, 200)
        q.push(k, v)
        all_ += list(zip(k.tolist(), v.tolist(), strict=True))
    blocks = [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in q.pop()]
    assert [x for b in blocks for x in b] == sorted(all_)
    assert all(b[-1] <= c[0] for b, c in zip(blocks, blocks[1:], strict=False)) and max(map(len, blocks)) <= 1000


def test_pii_spans(docs, table):
    rows = {r.doc_id: r for r in pii.pii(table).collect()}
    r = rows[210]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert len(rows) == len(docs) and rows[202].spans == ""
    text = {i: t for i, t in docs}[210]
    assert "a.b@c.de" not in pii.redact(text, pii.base_spans(text)) and pii.redact("x", []) == "x"
    assert pii.redacted(table).columns == table.columns


def test_pii_patterns_find_new_identifiers(spark):
    seeds = [(i, f"badge id is u{i}@x.org now") for i in range(12)]
    found = pii.pii(_frame(spark, [*seeds, (99, "badge id is QX-77123-4 now"), (98, "see 77-123-99 here")]))
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert spans[99].startswith("ctx:12:") and spans[98] == ""


def test_pii_patterns_are_rated_over_all_instances(spark):
    mails = [(i, f"write me at u{i}@x.org now") for i in range(9)]
    codes = [(100 + i, f"meet q{chr(97 + i % 26)}{chr(97 + i // 26)} at QX-{77000 + i}-4 now") for i in range(300)]
    spans = {r.doc_id: r.spans for r in pii.pii(_frame(spark, [*mails, *codes])).collect()}
    assert all(spans[i] == "" for i, _ in codes) and all(spans[i].startswith("email:") for i, _ in mails)


def test_pii_patterns_spread_from_found_identifiers(spark):
    rows = [(i, f"badge id u{i}@x.org now") for i in range(40)]
    rows += [(100 + i, f"badge id QX-{77000 + i}-4 now") for i in range(6)]
    rows += [(200 + i, f"pass no QX-{77000 + i}-4 now") for i in range(6)] + [(300, "pass no ZK-55123-9 now")]
    spans = {r.doc_id: r.spans for r in pii.pii(_frame(spark, rows)).collect()}
    assert spans[100].startswith("ctx:9:") and spans[300].startswith("ctx:8:")


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_pii_applies_all_patterns(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "PATTERNS_MOST", 3, raising=False)
    monkeypatch.setattr(pii, "PATTERN_BYTES", most, raising=False)
    names = [chr(97 + k) * 4 for k in range(8)]
    rows = [(100 * k + i, f"{w} {w} u{i}@x.org now") for k, w in enumerate(names) for i in range(9)]
    rows += [(100 * k + 50, f"{w} {w} QX-77123-{k} now") for k, w in enumerate(names)] + [(None, None)]
    spans = {r.doc_id: r.spans for r in pii.pii(_frame(spark, rows)).collect()}
    assert len(spans) == len(rows) and all(spans[100 * k + 50] == "ctx:10:20" for k in range(8))
    texts = {r.doc_id: r.text for r in pii.redacted(_frame(spark, rows)).collect()}
    assert all(texts[100 * k + 50] == f"{w} {w} [CTX] now" for k, w in enumerate(names)) and texts[None] is None


def test_media_round_trip(docs, table):
    for r in media.media_columns(table).collect():
        b = ({i: t for i, t in docs}[r.doc_id] or "").encode()
        p = media.padded(b)
        assert len(p) % 64 == 0 and p
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    items = media.sequence_of("<p>Hi &amp; you<img src='media:d' alt='a'>there<figure><img src='media:e'><figcaption>cap</figcaption></figure>")
    assert [(k, t, d, c) for _, k, t, d, c in items] == [("text", "Hi & you", None, None), ("media", None, "d", "a"), ("text", "there", None, None), ("media", None, "e", "cap")]


def test_chat_formatting(spark):
    rows = [(1, 0, "message", "user", "a <|im_end|> <\\|b", "m0"), (1, 1, "message", "assistant", "one", "m1"), (1, 2, "delta", "assistant", " two", None), (1, 3, "edit", "user", "new", "m0"), (1, 4, "regenerate", "assistant", "again", None), (2, 0, "message", None, None, None)]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string, target string")
    pieces = [r.piece for r in chat.format_log(log).orderBy("conv_id", "pos").collect()]
    assert pieces == ["<|im_start|>user\nnew<|im_end|>\n", "<|im_start|>assistant\nagain<|im_end|>\n", "<|im_start|>\n<|im_end|>\n"]
    for s in ("<|im_end|>", "<\\|x", "<\\\\|", "a|b<", ""):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
    for s in ("ro\nle", "\\n", "<|\\"):
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_decontamination(spark, docs, table):
    by_id = dict(docs)
    items = spark.createDataFrame([(1, " ".join(by_id[10].split()[:15])), (2, "nothing of this kind is anywhere here at all"), (3, None), (None, "x")], "item_id long, text string")
    rows = [(i, t) for i, t in docs] + [(300, _text(random.Random(9), 90) + " " + " ".join(by_id[10].split()[:15]) + " " + _text(random.Random(8), 90))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(_frame(spark, rows), items).collect()}
    assert got == {(10, 1), (300, 1)}
    kept = decontaminate.clean(table, items)
    assert kept.count() == len(docs) - 1 and kept.columns == table.columns


def test_short_items_are_found():
    items = {n: [f"q{n}w{k}" for k in range(n)] for n in range(1, 9)}
    index = decontaminate.ItemIndex([(n, " ".join(w)) for n, w in items.items()])
    rest = _text(random.Random(3), 20)
    assert [set(x) for x in index.leaks([f"{rest} {' '.join(w)} {rest}" for w in items.values()])] == [{n} for n in items]
    apart = [" ".join([*w[: -(-6 * len(w) // 10)], rest]) for n, w in items.items() if n > 2]
    assert index.leaks(apart) == [{}] * len(apart)


def test_wand_equals_full_scoring():
    rng = random.Random(4)
    index = decontaminate.ItemIndex([(i, _text(rng, 25)) for i in range(120)])
    for _ in range(20):
        terms = sorted({index.terms[w] for w in _text(rng, 40).split()})
        score = [0.0] * len(index.ids)
        for t in terms:
            for k, x in zip(*index.postings[t][:2], strict=True):
                score[k] += x
        want = {k for k, s in enumerate(score) if s >= 0.4}
        assert {k for k, _ in index.search(terms, 0.4)} == want


def test_quality_and_toxicity_learn(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 3 == 0, i % 4 == 1
        t = _text(rng, 40)
        if bad:
            t = t.replace(" ", "!! ").upper()
        if toxic:
            t += " " + rng.choice(["zgromkin", "vexhull"])
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    docs = _frame(spark, [*rows, (999, None), (998, ""), (997, "zgro.mkin zgrom-kin")])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality.quality(docs, lab).collect()}
    assert len(q) == 243 and all(q[i].predicted == y for i, y, _ in labels)
    x = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert sum(x[i].predicted != y for i, _, y in labels) <= 2
    assert all(0 <= r.score <= 1 for r in x.values()) and x[999].score == x[998].score
    none = lab.limit(0)
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}


def test_mixing_meets_targets(spark):
    words = {"en": "the of and", "de": "der die und", "fr": "le la et"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[d].split()) for _ in range(30)), d, "s", 1) for i, d in enumerate(["en"] * 60 + ["de"] * 25 + ["fr"] * 15)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    out = mixing.mix(docs, labels, {"en": 0.2, "de": 0.3, "fr": 0.5}).collect()
    total = sum(r.n_tokens for r in out)
    share = {d: sum(r.posteriors[d] * r.n_tokens * r.rate for r in out) / total for d in words}
    assert len(out) == 102 and all(r.rate >= 0 for r in out)
    assert all(abs(share[d] - t) < 2e-3 for d, t in (("en", 0.2), ("de", 0.3), ("fr", 0.5)))


@pytest.mark.parametrize("run", [jaccard.jaccard_components, suffixes.remove_repeats, ngram.lm_scores, pii.pii, media.media_columns, lambda d: jaccard.one_of_each(d)])
def test_empty_table(spark, run):
    assert run(_frame(spark, [])).count() == 0


@pytest.mark.parametrize("run", [jaccard.jaccard_components, suffixes.remove_repeats, ngram.lm_scores, pii.pii, media.media_columns])
def test_null_and_repeated_ids(spark, run):
    rows = [(None, "a b c d e f g h " * 30), (1, "a b c d e f g h " * 30), (1, "a b c d e f g h " * 30), (None, None)]
    out = run(_frame(spark, rows)).toPandas()
    assert len(out) == 4 and pd.isna(out["doc_id"]).sum() == 2
