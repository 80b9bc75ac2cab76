"""The n-gram Jaccard join against brute force: groups of all sizes, parts, stars, hot n-grams."""

import random

import numpy as np
import pytest

from textloom.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _true(sets):
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 4 * len(set(sets[i]) & set(sets[j])) >= 3 * len(set(sets[i]) | set(sets[j]))}


def _components(n, links):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(k) for k in range(n)]


def _sets(seed, n=40):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 70, rng.integers(1, 60))).astype(np.uint64) for _ in range(n)]
    sets += [np.unique(np.append(s[2:], 99).astype(np.uint64)) for s in sets[:15]]
    return list({s.tobytes(): s for s in sets}.values())


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_pairs(seed):
    sets = _sets(seed)
    ids = np.arange(len(sets))
    place = np.arange(0, 70, 7, dtype=np.uint64), np.arange(10, 0, -1)
    for order in (NONE, place):
        grams = np.unique(np.concatenate(sets))
        _, places = jaccard.in_order(grams, *order, False)
        rank = np.empty(len(grams), int)
        rank[np.lexsort((grams, places))] = np.arange(len(grams))
        local = [np.sort(rank[np.searchsorted(grams, s)]) for s in sets]
        tree, inside, found = jaccard.SetTree(local), np.zeros(len(grams), bool), set()
        for k, s in enumerate(local):
            found |= {tuple(sorted((k, tree.order[p]))) for p in tree.links(s, inside) if tree.order[p] != k}
            assert not inside.any()
        assert found == _true(sets)
        for queries in (None, np.ones(len(sets), bool)):
            links = jaccard.tree_links(ids, sets, *order, queries)
            assert {tuple(sorted(x)) for x in links} <= _true(sets)
            assert _components(len(sets), links) == _components(len(sets), _true(sets))


def test_pruned_subtrees_cost_nothing():
    """A thousand sets behind a shared path, none of which the query can link: the node above them is left at once."""
    sets = [np.array([*range(15), *range(20 + 40 * k, 60 + 40 * k)]) for k in range(1000)]
    tree = jaccard.SetTree(sets)
    inside = np.zeros(50_000, bool)
    query = np.array([0, *range(45_000, 45_054)])
    assert tree.links(query, inside) == [] and tree.visited <= 1
    first = tree.links(sets[0], inside)
    assert [tree.order[p] for p in first] == [0]


def test_queries_give_a_forest():
    sets = [np.array(sorted({*range(40)} - {k} | {100 + k}), np.uint64) for k in range(30)]
    links = jaccard.tree_links(np.arange(30), sets, *NONE, np.arange(30) < 20)
    assert len(links) == 29 and set(_components(30, links)) == {0}


@pytest.mark.parametrize("most", [1 << 16, 64])
def test_bitmaps_never_hide_a_link(monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_BITS", most)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.append(s[max(1, len(s) // 6) :], rng.integers(0, 1 << 62, len(s) // 16).astype(np.uint64))) for s in sets]
    bound = jaccard.Bound(np.array([len(s) for s in sets]), [jaccard.parity(s) for s in sets])
    for i, j in _true(sets):
        assert bound.partners(i)[j] and bound.partners(j)[i]
    edges = jaccard.forest(bound.n, [jaccard.parity(s) for s in sets])
    assert len(edges) < len(sets)
    whole = _components(len(sets), edges)
    assert all(whole[i] == whole[j] for i, j in _true(sets))


def _texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    base = [rng.choice(words) for _ in range(90)]
    for k in range(60):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + " " + line for _ in range(60)]  # a shared passage
    for k in range(20):  # copies at the edge of the threshold, of differing sizes
        w = rows[60 + k].split()
        rows.append(" ".join(w[: len(w) - len(w) // 5]))
        rows.append(" ".join(["odd", *w[1:]]))
    return list(enumerate([*rows, None, "", " ", "one two", "One TWO"]))


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 8, "PIVOTS": 2, "LOCAL": 16}, {"BLOCK": 8, "LOCAL": 4, "HOT": 10, "SLOTS": 64}])
def test_components_of_texts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = _texts()
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    want = _components(len(sets), links)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("limits", [{}, {"ORDER_MOST": 50, "COUNTED": 700}])
def test_the_order_counts_all_documents(spark, monkeypatch, limits):
    for name, value in {"HOT": 100, **limits}.items():
        monkeypatch.setattr(jaccard, name, value, raising=False)
    text = lambda k: " ".join(f"{c}{k}" for c in "abcde")
    rows = [text(k) for k in range(150) for _ in range(k + 1)]  # an n-gram of 1, one of 2, ..., one of 150 documents
    rows += [text(k) for k in range(150, 150 + 20_000 - len(rows))]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    frequent, rank, huge = jaccard.order_of(frame)
    grams = [int(s[0]) for s in jaccard.shingles([text(k) for k in range(150)], jaccard.WordHasher())]
    placed = grams[2:][-limits.get("ORDER_MOST", 150) :]
    assert dict(zip(frequent.tolist(), rank.tolist(), strict=True)) == {g: place for place, g in enumerate(placed, 1)}
    assert (frequent[1:] > frequent[:-1]).all() and huge == max(0, len(placed) - 51) + 1  # 51 have 100 documents or more


@pytest.mark.parametrize("hot", [8_192, 12])
def test_groups_become_memberships_once(spark, monkeypatch, hot):
    """Equal groups of many buckets are one before their members are told apart: more buckets make no more memberships."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    real, met, got = jaccard.materialize, [], []

    def watched(df, tag, *more):
        out = real(df, tag, *more)
        if tag == "jaccard-met":
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    words = [f"w{k}" for k in range(400)]
    rows = [" ".join([*words, f"end{k}"]) for k in range(20)] + [" ".join([f"own{k}", *words[:100]]) for k in range(10)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    grams = {g: [] for s in jaccard.shingles(rows, jaccard.WordHasher()) for g in s.tolist()}
    prefixes, order = 0, jaccard.order_of(frame)
    for s in jaccard.shingles(rows, jaccard.WordHasher()):
        p, prefixes = jaccard.prefix_length(len(s)), prefixes + jaccard.prefix_length(len(s))
        for g in jaccard.in_order(s, *order[:2])[0][:p].tolist():
            grams[g].append(jaccard.set_id(s))
    want = {tuple(sorted(x)) for x in grams.values() if len(x) > 1}
    for buckets in (1, 64):
        monkeypatch.setattr(jaccard, "bucket_count", lambda *_, n=buckets: n)
        found = {}
        for r in jaccard._groups(frame, *order).collect():
            found.setdefault((r["group"], r["size"]), []).append(r["set"])
        assert all(len(x) == size for (_, size), x in found.items())
        got.append(sorted(tuple(sorted(x)) for x in found.values()))
    assert got[0] == got[1] == sorted(want)
    if hot == 8_192:
        assert met[0] == len(want) and met[1] <= sum(len(x) > 1 for x in grams.values()) < sum(map(len, grams.values())) / 4
