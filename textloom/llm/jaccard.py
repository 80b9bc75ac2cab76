"""N-gram Jaccard join by a prefix tree over globally ordered n-gram sets.

The global order puts n-grams that many documents have last, counted over all documents, the rest by hash; the order
decides cost, never results.  Two sets reach the threshold only if their prefixes in this order share an n-gram.

1. Memberships (prefix n-gram, set) are dealt by hash in binary blocks.  The sets of one n-gram are a group; groups of
   the same members are one.  Groups of every size take the same way, those of more than BLOCK sets in parts.
2. Every set carries a folded parity bitmap of its n-grams, an exact lower bound of the difference of two sets.  In each
   group a forest over the sets that the bound allows to link is made: fewer rows than members, never pairs.  The
   trees of a forest are the clusters of a group; clusters of the same members are one.
3. The sets of each component of all forests go into one prefix tree (`SetTree`), which decides the links.  A traversal
   shares partial overlaps along a path and leaves a subtree whose remaining lengths cannot reach the overlap needed.
4. Clusters whose members are not all connected by then, and in which the bound still allows links between the
   components, go into prefix trees of their own.  So no link between components is missed.

Equal sets are one class from the start; classes are linked, never expanded into pairs of copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bucket_count, discard, in_bitmap, materialize, slot_of, small_batches, text_bytes, whole_text
from .components import components
from .words import WordHasher

WORDS = 5
NUM, DEN = 3, 4  # the threshold as a fraction: 0.75
FREQUENT = 3  # documents from which an n-gram counts as frequent
ORDER_MOST = 200_000  # n-grams with an own place in the order, at most (3 MB)
COUNTED = 2_000_000  # n-grams that are counted at once before they are dealt
HOT = 8_192  # n-grams of so many documents are dealt by set, not by n-gram
BLOCK = 2_048  # sets of a group that meet in one task; larger groups are cut into parts
PIVOTS = 16  # one in so many sets of a part meets all other parts
LOCAL = 4_096  # sets of a component in one tree; larger components are cut into stars
BUCKET_BYTES = 12e6
SLOTS = 1 << 26  # bits of a bitmap over hashed ids (8 MB): more documents cost more false hits, never results
MOST_BITS = 1 << 16  # of a set's parity bitmap
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(texts: list[str], hasher: WordHasher, n: int = WORDS):
    """Of each text the sorted distinct 64-bit hashes of its n-word shingles; of the whole sequence if it is shorter.

    Empty for a text without words.  Texts are hashed about a megabyte at a time.
    """
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= 1_000_000:
            yield from _shingles(held, hasher, n)
            held, size = [], 0
    if held:
        yield from _shingles(held, hasher, n)


def _shingles(texts: list[str], hasher: WordHasher, n: int):
    h, counts = hasher.words(texts)
    ends = counts.cumsum()

    def mixed(k: int, at: np.ndarray | slice, m: int) -> np.ndarray:
        x = h[:m][at] * _MIX[0] + np.uint64(k)
        for i in range(1, k):
            x = (x ^ (x >> np.uint64(29))) * _MIX[i % 5] + h[i : m + i][at]
        x ^= x >> np.uint64(32)
        x *= _MIX[0]
        return x ^ (x >> np.uint64(29))

    full = mixed(n, slice(None), max(0, len(h) - n + 1)) if len(h) >= n else h[:0]
    for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if c >= n:
            yield np.unique(full[e - c : e - n + 1])
        else:
            yield mixed(c, np.array([e - c]), len(h) - c + 1) if c else h[:0]


def set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def in_order(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, sort: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(set in the global order, place of each n-gram: 0 for rare ones, which the hash orders); unsorted if asked."""
    if not len(frequent):
        return s, np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    place = np.where(frequent[at] == s, rank[at], 0)
    if not sort:
        return s, place
    order = np.argsort(place, kind="stable")
    return s[order], place[order]


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def parity(s: np.ndarray) -> bytes:
    """Bit j: whether an odd number of n-grams falls into slot j.  One to two slots for each n-gram, up to MOST_BITS.

    Two sets differ in at least as many n-grams as their bitmaps differ in bits; folding a bitmap (exclusive or of its
    halves) gives the bitmap of half the slots.
    """
    bits = min(MOST_BITS, 1 << max(6, (len(s) - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(11)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def document_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set, bits): set and bits are null for documents without words."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            sets = [(len(s), set_id(s) if len(s) else None, parity(s) if len(s) else None) for s in shingles(b["text"], hasher)]
            n, ids, bits = ([x[k] for x in sets] for k in range(3))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": n, "set": pd.array(ids, "Int64"), "bits": bits})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", whole_text().alias("text")).mapInPandas(run, f"doc_id {kind}, n_shingles long, set long, bits binary")


def order_of(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent n-grams, sorted by hash, and their places (from 1, those of more documents later).

    All documents are counted: sorted n-grams with their counts are dealt by hash ranges in binary blocks.  From the
    third value on, places are of n-grams that HOT documents or more have.
    """
    buckets = bucket_count(1.4 * text_bytes(documents), BUCKET_BYTES)  # 8 bytes a word
    cuts = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1))

    def block(sets: list[np.ndarray]) -> pd.DataFrame:
        u, c = np.unique(np.concatenate(sets), return_counts=True)
        at = np.searchsorted(u, cuts).tolist()
        rows = [(k, u[x:y].tobytes(), c[x:y].astype(np.int32).tobytes()) for k, (x, y) in enumerate(zip([0, *at], [*at, len(u)], strict=True)) if x < y]
        return pd.DataFrame(rows, columns=["bucket", "grams", "counts"])

    def run(batches):
        hasher, held, size = WordHasher(), [], 0
        for b in batches:
            for s in shingles(b["text"], hasher):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        u, index = np.unique(np.frombuffer(b"".join(pdf["grams"]), np.uint64), return_inverse=True)
        c = np.bincount(index, np.frombuffer(b"".join(pdf["counts"]), np.int32), len(u)).astype(np.int64)
        keep = c >= FREQUENT
        return pd.DataFrame({"gram": u[keep].view(np.int64), "c": c[keep]})

    blocks = documents.select(whole_text().alias("text")).mapInPandas(run, "bucket int, grams binary, counts binary")
    counted = materialize(blocks.groupBy("bucket").applyInPandas(count, "gram long, c long"), "jaccard-order", True)
    # only counts that reach the most frequent ORDER_MOST are sorted
    by_count = counted.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    reach = by_count["c"][by_count["n"].cumsum() >= ORDER_MOST]
    least = int(reach.iloc[0]) if len(reach) else FREQUENT
    top = counted.filter(F.col("c") >= least).orderBy(F.desc("c"), "gram").limit(ORDER_MOST).toPandas()
    discard(counted)
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    rank = np.arange(len(top), 0, -1)
    order = np.argsort(grams)
    huge = int((top["c"] < HOT).sum()) + 1
    return grams[order], rank[order], huge


def _prefix_blocks(documents: DataFrame, frequent: np.ndarray, rank: np.ndarray, huge: int, buckets: int) -> DataFrame:
    """(bucket, grams, sets): prefix n-grams in binary, dealt by hash; hot ones' by set, to buckets below 0."""
    low = np.uint64(buckets - 1)  # prefixes hold the least hashes: their high bits are uneven

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            seen, grams, ids, places = set(), [], [], []
            for s in shingles(b["text"], hasher):
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                p = prefix_length(len(s))
                g, place = in_order(s, frequent, rank)
                grams.append(g[:p].copy())
                places.append(place[:p].astype(np.int32))
                ids.append(np.full(p, i, np.int64))
            if not grams:
                continue
            g, i, place = map(np.concatenate, (grams, ids, places))
            to = np.where(place >= huge, -1 - (i & (buckets - 1)), (g & low).astype(np.int64))
            order = np.argsort(to, kind="stable")
            to, g, i = to[order], g[order], i[order]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            ends = np.append(cut[1:], len(to))
            rows = [(int(to[x]), g[x:y].tobytes(), i[x:y].tobytes()) for x, y in zip(cut.tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "grams", "sets"])

    return documents.select(whole_text().alias("text")).mapInPandas(run, "bucket int, grams binary, sets binary")


_MET = "group long, members array<long>, size long"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """(group, members, size): a bucket's groups of two sets or more, one row each, equal groups once.

    Equal groups come from many buckets, the more the more buckets there are, so members are told apart into rows only
    after groups of all buckets are one.  Of a bucket below 0: (n-gram, its sets in this bucket, 0).
    """
    g = np.frombuffer(b"".join(pdf["grams"]), np.uint64)
    i = np.frombuffer(b"".join(pdf["sets"]), np.int64)
    order = np.lexsort((i, g))
    g, i = g[order], i[order]
    keep = np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])) if len(g) else np.zeros(0, bool)
    g, i = g[keep], i[keep]
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    size = np.diff(np.append(cut, len(g)))
    if len(pdf) and pdf["bucket"].iloc[0] < 0:
        return pd.DataFrame({"group": g[cut].view(np.int64), "members": pd.Series(np.split(i, cut[1:]) if len(cut) else [], dtype=object), "size": 0})
    groups = {}
    for x, k in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = i[x : x + k]
        groups.setdefault(xxhash.xxh3_64_intdigest(members.tobytes()), members)
    names = np.array(list(groups), np.uint64).view(np.int64)
    sizes = np.array([len(m) for m in groups.values()], np.int64)
    return pd.DataFrame({"group": names, "members": pd.Series(list(groups.values()), dtype=object), "size": sizes})


class Bound:
    """Which sets of a group the bitmaps allow to link."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n = n
        held = np.array([len(b) for b in bits])
        self.levels = np.unique(held).tolist()
        self.at = {}  # by level: members of this level and, folded, of the next one; their bitmaps as words
        for level in self.levels:
            rows, mats = [], []
            for own in (level, 2 * level):
                if len(k := np.flatnonzero(held == own)):
                    m = np.frombuffer(b"".join(bits[j] for j in k.tolist()), np.uint64).reshape(len(k), -1)
                    half = level // 8
                    mats.append(m if own == level else m[:, :half] ^ m[:, half:])
                    rows.append(k)
            self.at[level] = np.concatenate(rows), np.concatenate(mats), len(rows[0])
        self.held = held

    def partners(self, i: int, sure: bool = False) -> np.ndarray:
        """Mask over the members: sizes and bitmaps allow a link with i.  Sure: chance meetings in the bitmap, too."""
        out = np.zeros(len(self.n), bool)
        own = int(self.held[i])
        for level in (own // 2, own):
            if level not in self.at:
                continue
            rows, mat, first = self.at[level]
            mine = mat[np.flatnonzero(rows == i)[0]]
            if level != own:  # folded: only with members of the lower level
                rows, mat = rows[:first], mat[:first]
            differ = np.bitwise_count(mat ^ mine).sum(1, dtype=np.int64)
            n, m = self.n[rows], int(self.n[i])
            most, slots = (DEN - NUM) / (NUM + DEN) * (n + m), 64 * mat.shape[1]
            if sure:  # so many bits differ on average where so many n-grams do
                most = slots / 2 * (1 - np.exp(-2 * most / slots))
            fits = (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (differ <= most + 1e-6)
            out[rows[fits]] = True
        out[i] = False
        return out


def forest(n: np.ndarray, bits: list[bytes]) -> list[tuple[int, int]]:
    """Edges (positions) of a forest over one group that spans what the bound allows to link; surer edges first."""
    k = len(n)
    if k == 2 and len(bits[0]) == len(bits[1]):
        differ = (int.from_bytes(bits[0]) ^ int.from_bytes(bits[1])).bit_count()
        fits = min(n) * DEN >= max(n) * NUM and (NUM + DEN) * differ <= (DEN - NUM) * (n[0] + n[1])
        return [(0, 1)] if fits else []
    bound, label, edges = Bound(n, bits), np.full(k, -1), []
    for start in range(k):
        if label[start] >= 0:
            continue
        label[start] = start
        queue = [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(bound.partners(i, True) & (label < 0))
            label[new] = start
            edges += [(i, j) for j in new.tolist()]
            queue += new.tolist()
    if len(np.unique(label)) > 1:
        for i in range(k):
            open_ = np.flatnonzero(bound.partners(i) & (label != label[i]))
            while len(open_):
                j = int(open_[0])
                edges.append((i, j))
                label[label == label[j]] = label[i]
                open_ = open_[label[open_] != label[i]]
    return edges


def _slices(pdf: pd.DataFrame, by: list[str]):
    """The frame's runs of equal keys, after a sort, with repeated sets dropped."""
    pdf = pdf.sort_values([*by, "set"]).drop_duplicates([*by, "set"])
    key = pdf[by].to_numpy()
    cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(pdf) else np.zeros(0, int)
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(pdf)], strict=True):
        if y - x > 1:
            yield pdf.iloc[x:y]


def _clusters(pdf: pd.DataFrame) -> pd.DataFrame:
    """Forest edges (cluster, a, b) of the groups (or parts of groups) of one bucket; clusters of equal members once."""
    out = {}
    for one in _slices(pdf, ["group", "part"]):
        ids, edges = one["set"].to_numpy(np.int64), forest(one["n"].to_numpy(np.int64), list(one["bits"]))
        root = list(range(len(ids)))
        for i, j in edges:  # at most one edge less than members
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            root[max(i, j)] = min(i, j)
        for k in range(len(ids)):
            root[k] = root[root[k]]
        members, own = {}, {}
        for k, r in enumerate(root):
            members.setdefault(r, []).append(k)
        for i, j in edges:
            own.setdefault(root[i], []).append((i, j))
        for r, found in own.items():
            name = xxhash.xxh3_64_intdigest(ids[members[r]].tobytes())
            out.setdefault(name, [(int(ids[i]), int(ids[j])) if ids[i] < ids[j] else (int(ids[j]), int(ids[i])) for i, j in found])
    rows = [(np.int64(np.uint64(name)), a, b) for name, found in out.items() for a, b in found]
    return pd.DataFrame(rows, columns=["cluster", "a", "b"], dtype="int64")


def _still_open(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each task's members those that the bound allows to link with another component; query: outside the main one."""
    out = []
    for one in _slices(pdf, ["task"]):
        component = one["component"].to_numpy(np.int64)
        names, size = np.unique(component, return_counts=True)
        if len(names) == 1:
            continue
        bound, live, query = Bound(one["n"].to_numpy(np.int64), list(one["bits"])), np.zeros(len(one), bool), np.zeros(len(one), bool)
        for i in np.flatnonzero(component != names[size.argmax()]).tolist():
            mates = bound.partners(i) & (component != component[i])
            if mates.any():
                query[i] = True
                live |= mates
        live |= query
        out.append(pd.DataFrame({"task": one["task"].to_numpy()[live], "set": one["set"].to_numpy()[live], "query": query[live]}))
    return pd.concat(out) if out else pd.DataFrame({"task": pd.array([], "int64"), "set": pd.array([], "int64"), "query": pd.array([], "bool")})


class SetTree:
    """Prefix tree of distinct sets of ranks in the global order, with path compression.

    A node is a run of the sorted sequences that share their first `stop` ranks; it knows the shortest and longest set
    below it and how many of them are live.  A traversal computes the overlap along a node's label once for all sets
    below and never enters a node whose bound fails.
    """

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda k: sequences[k].astype(">u4").tobytes())
        self.seq = [sequences[k] for k in self.order]
        self.size = np.array([len(s) for s in self.seq])
        common = np.zeros(len(self.seq), np.int64)
        for k in range(1, len(self.seq)):
            a, b = self.seq[k - 1], self.seq[k]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            first = int(differ.argmax()) if m else 0
            common[k] = first if m and differ[first] else m
        self.live = np.ones(len(self.seq), bool)
        self.start, self.stop, self.first, self.children, self.parent, self.ends = [], [], [], [], [], []
        self.least, self.most, self.alive, self.leaf = [], [], [], [0] * len(self.seq)
        waiting = [(0, len(self.seq), 0, -1)]
        while waiting:
            lo, hi, start, up = waiting.pop()
            stop = int(common[lo + 1 : hi].min()) if hi - lo > 1 else len(self.seq[lo])
            node = len(self.start)
            inner = lo + int(len(self.seq[lo]) == stop)  # a set that ends here comes first
            for name, x in (("start", start), ("stop", stop), ("first", lo), ("children", []), ("parent", up), ("ends", inner > lo), ("alive", hi - lo)):
                getattr(self, name).append(x)
            self.least.append(int(self.size[lo:hi].min()))
            self.most.append(int(self.size[lo:hi].max()))
            if inner > lo:
                self.leaf[lo] = node
            if up >= 0:
                self.children[up].append(node)
            if inner < hi:
                cut = [inner, *(inner + 1 + np.flatnonzero(common[inner + 1 : hi] == stop)).tolist(), hi]
                waiting += [(x, y, stop, node) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        self.visited = 0  # nodes whose label was read, for tests

    def remove(self, k: int) -> None:
        self.live[k] = False
        node = self.leaf[k]
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def links(self, query: np.ndarray, inside: np.ndarray) -> list[int]:
        """Positions of live sets (in self.order) that reach the threshold with the query; they stay live.

        inside: an all-false mask over the ranks, all false again afterwards.
        """
        inside[query] = True
        nq, found, waiting = len(query), [], [(0, 0)]
        shortest, longest = -(-NUM * nq // DEN), DEN * nq // NUM
        while waiting:
            node, got = waiting.pop()
            if not self.alive[node] or self.least[node] > longest or self.most[node] < shortest:
                continue
            self.visited += 1
            s, stop = self.seq[self.first[node]], self.stop[node]
            label = s[self.start[node] : stop]
            got += int(inside[label].sum())
            left = nq - int(np.searchsorted(query, label[-1], side="right")) if len(label) else nq
            # what the shortest allowed set below needs; a set of n ranks has at most n - stop more
            need = -(-NUM * (max(shortest, self.least[node]) + nq) // (NUM + DEN))
            if got + min(left, min(longest, self.most[node]) - stop) < need:
                continue
            if self.ends[node] and self.live[k := self.first[node]] and DEN * got >= NUM * (stop + nq - got):
                found.append(k)
            waiting += [(c, got) for c in self.children[node]]
        inside[query] = False
        return found


def tree_links(ids: np.ndarray, sets: list[np.ndarray], frequent: np.ndarray, rank: np.ndarray, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets (or between queries and all sets): a forest.

    sets: sorted distinct hashes.  Sets found from a query are taken out of the tree and then searched from in turn,
    so that a group in which one set links to all others costs one traversal.
    """
    grams, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    _, place = in_order(grams, frequent, rank, False)
    to = np.empty(len(grams), np.int64)
    to[np.lexsort((grams, place))] = np.arange(len(grams))
    local = [np.sort(x) for x in np.split(to[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    tree, inside, out = SetTree(local), np.zeros(len(grams), bool), []
    where = {k: pos for pos, k in enumerate(tree.order)}
    if queries is not None:  # each query against all sets
        root = list(range(len(sets)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k in np.flatnonzero(queries).tolist():
            tree.remove(where[k])
            for p in tree.links(local[k], inside):
                x, y = find(k), find(tree.order[p])
                if x != y:  # a link inside what is connected already adds nothing
                    root[x] = y
                    out.append((int(ids[k]), int(ids[tree.order[p]])))
        return out
    for start in range(len(sets)):
        if not tree.live[where[start]]:
            continue
        tree.remove(where[start])
        queue = [start]
        while queue and tree.alive[0]:
            k = queue.pop()
            for p in tree.links(local[k], inside):
                tree.remove(p)
                out.append((int(ids[k]), int(ids[tree.order[p]])))
                queue.append(tree.order[p])
    return out


_LINKS = "a long, b long"


def _compare(tasks: DataFrame, first: DataFrame, contents: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """tasks: (task, set, query); one tree per task; links (a, b).  query marks sets that are compared with all.

    first: (set, doc_id) names the document whose contents stand for the set.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, links = pdf.sort_values(["task", "set", "query"], ascending=[True, True, False]), []
        for one in _slices(pdf, ["task"]):
            sets = [np.frombuffer(x, np.uint64) for x in one["grams"]]
            queries = one["query"].to_numpy(bool)
            links += tree_links(one["set"].to_numpy(np.int64), sets, frequent, rank, queries if queries.any() else None)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    placed = tasks.join(first.select("set", "doc_id"), "set").join(contents, ["set", "doc_id"])
    size = contents.agg(F.avg(F.octet_length("grams"))).first()[0] or 0
    buckets = bucket_count(size * tasks.count(), BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("task", F.lit(11)), F.lit(buckets)).cast("int").alias("bucket")
    return placed.select(bucket, "task", "set", "query", "grams").groupBy("bucket").applyInPandas(run, _LINKS)


def _contents(documents: DataFrame, needed: DataFrame) -> DataFrame:
    """(set, doc_id, grams) of the needed sets: sorted hashes in binary.

    needed: (set, doc_id).  A bitmap of SLOTS bits over hashed ids picks the documents to read anew; what it lets
    through by chance matches no (set, doc_id) in the joins and is dropped there.
    """
    marks = bitmap(needed, SLOTS)
    kind = documents.schema["doc_id"].dataType.simpleString()
    flagged = documents.select("doc_id", whole_text().alias("text"), slot_of(SLOTS).alias("slot"))

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            b = b[in_bitmap(marks, b["slot"].to_numpy(np.int64))]
            rows = [(set_id(x), d, x.tobytes()) for d, x in zip(b["doc_id"], shingles(b["text"], hasher), strict=True) if len(x)]
            yield pd.DataFrame(rows, columns=["set", "doc_id", "grams"])

    found = flagged.filter("doc_id IS NOT NULL").mapInPandas(run, f"set long, doc_id {kind}, grams binary")
    return materialize(found, "jaccard-sets")


def _groups(documents: DataFrame, frequent: np.ndarray, rank: np.ndarray, huge: int) -> DataFrame:
    """(group, set, size): the groups of sets that share a prefix n-gram, each once."""
    buckets = bucket_count(0.6 * text_bytes(documents), BUCKET_BYTES)
    blocks = _prefix_blocks(documents, frequent, rank, huge, buckets)
    met = materialize(blocks.groupBy("bucket").applyInPandas(_gather, _MET), "jaccard-met")
    each = F.explode("members").alias("set")
    dealt = met.filter("size > 0").distinct().select("group", each, "size")
    # hot n-grams (at most ORDER_MOST of them): one of those with the same sets stands for all
    hot, mark = met.filter("size = 0").select("group", each, "size"), F.xxhash64("set")
    named = hot.groupBy("group").agg(F.count("*").alias("size"), F.sum(mark.cast("decimal(38,0)")).alias("s"), F.bit_xor(mark).alias("x"))
    named = named.filter("size > 1").groupBy("size", "s", "x").agg(F.min("group").alias("group")).select("group", "size")
    hot = hot.drop("size").join(F.broadcast(named), "group")
    out = materialize(dealt.unionByName(hot), "jaccard-groups")
    discard(met)
    return out


def _joined(tasks: DataFrame) -> DataFrame:
    """tasks (task, set, query) with those that share sets as one, so that a set travels once; beyond LOCAL sets, as given."""
    head = tasks.groupBy("task").agg(F.min("set").alias("a"))
    found = components(tasks.join(head, "task").select("a", F.col("set").alias("b")), "jaccard-open-cc").withColumnRenamed("node", "set")
    sized = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component")
    placed = tasks.join(sized, "set").withColumn("task", F.when(F.col("size") <= LOCAL, F.col("component")).otherwise(F.col("task")))
    return placed.groupBy("task", "set").agg(F.max("query").alias("query"))


def set_links(documents: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different sets that reach the threshold: enough of them to connect all that is connected."""
    docs = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    frequent, rank, huge = order_of(docs)
    groups = _groups(docs, frequent, rank, huge)
    named = sets.filter("set IS NOT NULL AND doc_id IS NOT NULL")
    first = named.groupBy("set").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "bits")).alias("d")).select("set", "d.*")

    # the clusters of each group, or of each part of it, which some pivots of the other parts join
    parts = F.ceil(F.col("size") / BLOCK)
    own = groups.select("group", F.pmod(F.xxhash64("set"), parts).alias("part"), "set")
    pivots = groups.filter((parts > 1) & (F.pmod(F.xxhash64("set", F.lit(7)), parts * PIVOTS) == 0))
    pivots = pivots.select("group", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "set")
    bits = sets.agg(F.avg(F.octet_length("bits"))).first()[0] or 0
    buckets = bucket_count((bits + 40) * groups.count(), BUCKET_BYTES)
    deal = lambda *by: F.pmod(F.xxhash64(*by, F.lit(11)), F.lit(buckets)).cast("int").alias("bucket")
    placed = own.unionByName(pivots).join(first.drop("doc_id"), "set").withColumn("bucket", deal("group", "part"))
    clusters = placed.groupBy("bucket").applyInPandas(_clusters, "cluster long, a long, b long")
    clusters = materialize(clusters.distinct(), "jaccard-clusters")
    edges = materialize(clusters.select("a", "b").distinct(), "jaccard-forest")

    ends = lambda e, *keep: e.select(*keep, F.col("a").alias("set")).unionByName(e.select(*keep, F.col("b").alias("set"))).distinct()
    wanted = materialize(first.select("set", "doc_id").join(ends(edges), "set", "left_semi"), "jaccard-first")
    contents = _contents(docs, wanted)

    # a tree for each component of the forests, so that a set travels once; for a component beyond LOCAL, a tree for
    # each star around a first set
    found = components(edges, "jaccard-local")
    local = materialize(found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component"), "jaccard-blocks")
    discard(found)
    no = F.lit(False).alias("query")
    tasks = local.filter(F.col("size") <= LOCAL).select(F.col("component").alias("task"), F.col("node").alias("set"), no)
    star = edges.join(local.filter(F.col("size") > LOCAL).select(F.col("node").alias("a")), "a")
    star = star.join(star.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "a")
    name = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")), F.lit("star")).alias("task")
    tasks = tasks.unionByName(star.select(name, F.col("b").alias("set"), no)).unionByName(star.select(name, F.col("a").alias("set"), F.lit(True).alias("query")).distinct())
    links = materialize(_compare(tasks, wanted, contents, frequent, rank), "jaccard-links")
    known = components(links, "jaccard-cc")

    # clusters that an edge without a link holds together
    end = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    apart = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    open_ = clusters.join(apart, ["a", "b"]).select("cluster").distinct()
    small = ends(clusters.join(open_, "cluster", "left_semi"), F.col("cluster").alias("task"))
    # of groups in several parts, the sets outside the component of most of the group against all parts
    component = known.withColumnRenamed("node", "set")
    large = groups.filter(parts > 1).withColumn("part", F.pmod(F.xxhash64("set"), parts)).join(component, "set", "left").withColumn("component", F.coalesce("component", "set"))
    most = large.groupBy("group", "component").agg(F.count("*").alias("k")).groupBy("group").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all"))
    most = most.filter("all > m.k").select("group", F.col("m.component").alias("main"), F.ceil((F.col("all") - F.col("m.k")) / BLOCK).alias("uparts"))
    large = large.join(most, "group")
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    task = F.xxhash64("group", "upart", "part", F.lit("part")).alias("task")
    asks = large.filter("component <> main").withColumn("upart", F.pmod(F.xxhash64("set", F.lit(7)), F.col("uparts")))
    asks = asks.drop("part").withColumn("part", count(F.ceil(F.col("size") / BLOCK)))
    asked = large.withColumn("upart", count(F.col("uparts")))
    again = small.unionByName(asks.select(task, "set")).unionByName(asked.select(task, "set"))
    again = again.join(component, "set", "left").withColumn("component", F.coalesce("component", "set")).join(first.drop("doc_id"), "set")
    still = again.withColumn("bucket", deal("task")).groupBy("bucket").applyInPandas(_still_open, "task long, set long, query boolean")
    still = materialize(still, "jaccard-open")
    out = links
    if still.limit(1).count():
        wanted2 = materialize(first.select("set", "doc_id").join(still.select("set").distinct(), "set", "left_semi"), "jaccard-first")
        contents2 = _contents(docs, wanted2)
        joined = materialize(_joined(still), "jaccard-joined")
        out = materialize(links.unionByName(_compare(joined, wanted2, contents2, frequent, rank)), "jaccard-all")
        discard(wanted2, contents2, links, joined)
    discard(contents, wanted, known, groups, clusters, edges, local, still)
    return out


def jaccard_components(documents: DataFrame) -> DataFrame:
    """The op10 query: one row per row of documents: doc_id, n_shingles, component_id.

    Texts without words (null, empty, blank) are linked with nothing: their component is their own id.  Repeated rows
    are copies of each other.  Rows without a doc_id take no part in linking and have a null component.  An empty
    table gives an empty result.
    """
    small_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    sets = materialize(document_sets(docs), "jaccard-docs")
    links = set_links(docs, sets)
    known = components(links, "jaccard-cc").withColumnRenamed("node", "set")
    discard(links)
    first = sets.filter("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    labelled = first.join(known, "set", "left").withColumn("component", F.coalesce("component", "set"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = labelled.join(ids, "component").select("set", "component_id")
    out = sets.join(by_set, "set", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """documents with one row of each component: that of the component's id (any one of repeated rows).

    Rows without a doc_id stay.  Two bitmaps over hashed ids tell which rows stay and which go without moving texts;
    only rows whose slot holds ids of both kinds are joined with the list of what goes.
    """
    found = materialize(jaccard_components(documents), "jaccard-keep")
    gone, kept = F.col("doc_id") != F.col("component_id"), F.col("doc_id") == F.col("component_id")
    drop = found.filter(gone).select("doc_id").distinct()
    out_of, stay = bitmap(found.filter(gone), SLOTS), bitmap(found.filter(kept), SLOTS)

    def fate(slots: pd.Series) -> pd.Series:
        """0: stays, 1: goes, 2: the slot holds both kinds."""
        s = slots.to_numpy(np.int64)
        goes = in_bitmap(out_of, s)
        return pd.Series(goes.astype(np.int32) + (goes & in_bitmap(stay, s)))

    state = F.pandas_udf(fate, "int")(slot_of(SLOTS))
    named = documents.filter("doc_id IS NOT NULL")
    doubtful = named.filter(state == 2).join(drop, "doc_id", "left_anti")
    out = named.filter(state == 0).unionByName(doubtful.select(*documents.columns)).unionByName(documents.filter("doc_id IS NULL"))
    if found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        named = out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        out = named.unionByName(out.filter("doc_id IS NULL"))
    return out
