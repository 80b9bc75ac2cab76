"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts common subsequences of three characters, at most two characters stretched beyond contiguity, each
weighted by DECAY per skipped character, between two words (with start and end marks), so gapped and
inserted-character spellings of an insult stay close to it.  A sentence is a bag of words (single characters in a
row are also read as one word); its margin is that of its worst word, a document's that of its worst sentence.
Landmark coefficients are folded into one weight per subsequence, so scoring needs one table lookup per subsequence
of each distinct word.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, fold_of, whole_text

#: Labelled rows used for fitting, at most; labelled texts of more characters are not used for it (all are scored).
FIT_ROWS, FIT_CHARS = 12_000, 16_000
DECAY = 0.5
#: Offsets of the second and third character, and the weight of the gap.
SHAPES = [(a, b, DECAY ** (b - 2)) for b in (2, 3, 4) for a in range(1, b)]
BITS = 18
SURE = 0.8  # least share of toxic texts, after a margin for chance, on which every such word is an insult
HARD_AMONG = 300_000  # clean words of the sample among which the hardest are sought in every round
PURE = 0.9  # from this share of toxic texts on a word is no clean one, though some clean text has it
COST = 400.0  # of all insults' errors together, and of all clean words', against the margin's width
BENT = 0.3  # cost of bent spellings of insults, against 1 for the insults
WIDTH = 34  # a longer word is read in overlapping windows of this many characters
_END = re.compile(r"[.!?\n]+\s")


def units(sentence: str) -> list[str]:
    """Words; runs of single characters are also joined; words beyond WIDTH are cut into overlapping windows."""
    words, out, run = sentence.lower().split(), [], []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            joined = "".join(run)
            out += [joined[i : i + WIDTH] for i in range(0, max(1, len(joined) - WIDTH // 2), WIDTH // 2)]
        if run:
            run = []
        if len(w) > WIDTH:
            out += [w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2)]
        elif w:
            out.append(w)
    return out


def _codes(words: list[str]):
    """For each shape: (codes by word and start, where valid, weight)."""
    wide = max(map(len, words)) + 2
    a = np.zeros((len(words), wide + 4), np.uint32)
    size = np.array([len(w) + 2 for w in words])
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    a[row, np.arange(len(flat)) - np.repeat(size.cumsum() - size, size)] = flat
    with np.errstate(over="ignore"):
        for p, q, weight in SHAPES:
            x = a[:, :wide] * np.uint32(2654435761)
            x = (x ^ (x >> np.uint32(15))) + a[:, p : p + wide] * np.uint32(2246822519)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(3266489917) + a[:, q : q + wide] * np.uint32(668265263)
            x = (x ^ (x >> np.uint32(16))) * np.uint32(374761393)
            yield x >> np.uint32(32 - BITS), a[:, q : q + wide] > 0, weight


def features(words: list[str]) -> np.ndarray:
    """Dense normalised feature vectors (fitting only)."""
    out = np.zeros((len(words), 1 << BITS), np.float32)
    for codes, ok, weight in _codes(words):
        r, c = np.nonzero(ok)
        np.add.at(out, (r, codes[r, c]), weight)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def sparse_features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, values) of each word, normalised."""
    parts: list = [[] for _ in words]
    shapes = [(c, ok, w) for c, ok, w in _codes(words)]
    for i in range(len(words)):
        codes = np.concatenate([c[i][ok[i]] for c, ok, _ in shapes])
        vals = np.concatenate([np.full(int(ok[i].sum()), w) for _, ok, w in shapes])
        u, inv = np.unique(codes, return_inverse=True)
        v = np.bincount(inv, vals, len(u))
        parts[i] = (u, v / max(np.linalg.norm(v), 1e-9))
    return parts


@dataclass
class KernelMachine:
    weights: np.ndarray | None = None  # by code
    bias: float = -1.0
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        if self.weights is None or not words:
            return np.full(len(words), self.bias)
        total, norm = np.zeros(len(words)), np.zeros(len(words))
        for codes, ok, weight in _codes(words):
            total += weight * (self.weights[codes] * ok).sum(1)
            norm += weight * weight * ok.sum(1)
        return total / np.sqrt(np.maximum(norm, 1e-9)) + self.bias

    def text_margin(self, text: str, cache: dict[str, float]) -> float:
        """Worst word of the worst sentence; a text without words has the bias's margin."""
        words = _plain(text) | set(units(text)) if _has_runs(text) else _plain(text)
        new = [w for w in words if w not in cache]
        if new:
            if len(cache) > 400_000:
                cache.clear()
                new = list(words)
            new.sort(key=len)
            for k in range(0, len(new), 2048):
                part = new[k : k + 2048]
                cache.update(zip(part, self.margins(part).tolist(), strict=True))
        return max(map(cache.__getitem__, words), default=self.bias)

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.offset, -30, 30)))


_MARKS = re.compile(r"[\W_]+")
_INNER = re.compile(r"[^\W_][\W_]+[^\W_]")  # a word with marks inside is also read without them
_RUN = re.compile(r"(?:^|\s)\S\s\S\s\S(?:\s|$)")


def _has_runs(text: str) -> bool:
    return bool(_RUN.search(text))


def _plain(text: str) -> set[str]:
    words = set(text.lower().split())
    long = [w for w in words if len(w) > WIDTH]
    if long:
        words.difference_update(long)
        for w in long:
            words.update(w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2))
    marked = [w for w in words if not w.isalnum()]
    words.update(x for w in marked if len(x := _MARKS.sub("", w)) > 3 and _INNER.search(w))
    return {w for w in words if len(w) > 1}


def _newton_svm(z: np.ndarray, t: np.ndarray, cost: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Primal squared-hinge SVM; z has a last column of ones, t is -1 or 1."""
    w = np.zeros(z.shape[1])
    reg = ridge * np.eye(z.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        out = t * (z @ w) < 1
        zo = z[out] * cost[out, None]
        new = np.linalg.solve(reg + zo.T @ z[out], zo.T @ t[out])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _dense(parts: list, rows: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(parts), len(rows)), np.float32)
    for i, (u, v) in enumerate(parts):
        for c, x in zip(u.tolist(), v.tolist(), strict=True):
            j = rows.get(c)
            if j is not None:
                out[i, j] = x
    return out


def _kernel(words: list[str], rows: dict[int, int], lm: np.ndarray) -> np.ndarray:
    """Kernel values of the words against the landmarks, a thousand words at a time: dense rows are wide."""
    parts = [_dense(sparse_features(words[i : i + 1024]), rows) @ lm.T for i in range(0, len(words), 1024)]
    return np.concatenate(parts)


def _stretched(words: list[str], rng) -> list[str]:
    """Each word with one mark, one double of its letters and one other letter inserted: variants that share its label."""
    out = []
    for w in words:
        if len(w) > 3:
            i, j, k = rng.integers(1, len(w), 3)
            letter = "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
            out += [w[:i] + "*-._1"[int(rng.integers(5))] + w[i:], w[:j] + w[j - 1] + w[j:], w[:k] + letter + w[k:]]
    return out


def _spread(words: list[str], most: int) -> list[str]:
    """The first word, then again and again the one least like those taken before."""
    parts = sparse_features(words)
    rows = {c: i for i, c in enumerate(sorted({int(c) for u, _ in parts for c in u}))}
    flat = [np.array([rows[int(c)] for c in u], np.int64) for u, _ in parts]
    near, taken = np.zeros(len(words)), [0]
    while len(taken) < min(most, len(words)):
        vector = np.zeros(len(rows))
        vector[flat[taken[-1]]] = parts[taken[-1]][1]
        near = np.maximum(near, [float(vector[f] @ v) for f, (_, v) in zip(flat, parts, strict=True)])
        near[taken] = 2.0
        taken.append(int(near.argmin()))
    return [words[k] for k in taken]


def _one_of_copies(texts: list[str], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """One text of those whose least hashed run of three words is the same: near copies count a word but once."""
    seen: dict[tuple, int] = {}
    for k, t in enumerate(texts):
        w = t.lower().split()
        least = min((zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2))), default=0)
        seen.setdefault((least, int(y[k])), k)
    kept = list(seen.values())
    return [texts[k] for k in kept], y[kept]


def train(texts: list[str], y: np.ndarray, landmarks: int = 192, rounds: int = 4) -> KernelMachine:
    """Multiple-instance fit: a toxic text has at least one toxic word, a clean text none.

    With no texts, or one class only, the machine gives every text the smoothed share of ones.
    """
    y = np.asarray(y, int)
    share = (y.sum() + 1) / (len(y) + 2)
    flat = KernelMachine(bias=0.0, slope=1.0, offset=float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return flat
    texts, y = _one_of_copies(texts, y)
    one_of: dict[str, str] = {}  # texts share words: each is held once
    # tuples, not sets: a tenth of the memory
    bags = [tuple(one_of.setdefault(w, w) for w in sorted(_plain(t) | {u for s in _END.split(t) if _has_runs(s) for u in units(s)})) for t in texts]
    clean_words: dict[str, int] = {}
    toxic_words: dict[str, int] = {}
    for b, label in zip(bags, y, strict=True):
        into = toxic_words if label else clean_words
        for w in b:
            into[w] = into.get(w, 0) + 1
    # Starting witnesses: words that toxic texts share and clean ones never have, judged by the word itself and by its
    # first four characters.
    stem_t: dict[str, int] = {}
    stem_c: dict[str, int] = {}
    for b, label in zip(bags, y, strict=True):  # texts that have a beginning, not words
        into = stem_t if label else stem_c
        for stem in {w[:4] for w in b}:
            into[stem] = into.get(stem, 0) + 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))

    def purity(t: float, c: float) -> float:
        """Share of toxic texts among those with a word, were both kinds equally many."""
        a, b = (t + 0.1) / n1, (c + 0.1) / n0
        return a / (a + b)

    # labels err: a word, or the words of one beginning, that toxic texts have far more often is no clean word
    for w in [w for w in clean_words if w in toxic_words or w[:4] in stem_t]:
        own = toxic_words.get(w, 0) > 2 and purity(toxic_words[w], clean_words[w]) > PURE
        if own or stem_t.get(w[:4], 0) > 4 and purity(stem_t[w[:4]], stem_c.get(w[:4], 0)) > PURE:
            del clean_words[w]

    def sure(w: str) -> bool:
        """Whether the word, or the words of its beginning, are so much of toxic texts that chance is no reason."""
        some = lambda t, c: t > 4 and purity(t - 1.6 * np.sqrt(t), c + 1) > SURE
        return w not in clean_words and (some(toxic_words[w], 0) or some(stem_t[w[:4]], stem_c.get(w[:4], 0)))

    def odds(w: str) -> float:
        one = np.log((toxic_words.get(w, 0) + 0.1) / n1) - np.log((clean_words.get(w, 0) + 0.1) / n0)
        stem = np.log((stem_t.get(w[:4], 0) + 0.1) / n1) - np.log((stem_c.get(w[:4], 0) + 0.1) / n0)
        return float(max(one, stem))

    rating = {w: odds(w) for w in toxic_words}
    toxic_bags = [b for b, label in zip(bags, y, strict=True) if label and b]
    # every word that is surely one, or else the likeliest word of a text
    certain = {w for w in toxic_words if sure(w)}
    witnesses: dict[str, int] = {}
    for b in toxic_bags:
        own = certain.intersection(b)
        if not own:
            w = max(b, key=lambda w: (rating[w], w))
            own = {w} if rating[w] > 1.5 and max(toxic_words[w], stem_t[w[:4]]) > 2 else own
        for w in own:
            witnesses[w] = witnesses.get(w, 0) + 1
    rng = np.random.default_rng(11)
    pool = sorted(clean_words, key=lambda w: (-clean_words[w], w))
    negatives = list(dict.fromkeys(pool[:3000] + [pool[i] for i in rng.permutation(len(pool))[:5000].tolist()]))
    every = pool if len(pool) <= HARD_AMONG else [pool[i] for i in rng.permutation(len(pool))[:HARD_AMONG].tolist()]
    machine = flat
    for _ in range(rounds):
        positives = sorted(witnesses, key=lambda w: (-witnesses[w], w))[:4000]
        if not positives or not negatives:
            return flat
        hit = set(positives)
        negatives = [w for w in dict.fromkeys(negatives) if w not in hit] or negatives
        # Landmarks: witnesses that lie far from each other, and clean words.
        marks = _spread(positives[:2000], landmarks * 2 // 3) + [negatives[i] for i in rng.permutation(len(negatives))[: landmarks // 3].tolist()]
        lp = sparse_features(marks)
        rows = {c: i for i, c in enumerate(sorted({int(c) for u, _ in lp for c in u}))}
        lm = _dense(lp, rows).astype(float)
        gram = lm @ lm.T
        val, vec = np.linalg.eigh(gram)
        good = val > 1e-6 * val.max()
        root = vec[:, good] / np.sqrt(val[good])
        bent, straight = _stretched(positives[:1500], rng), _stretched(negatives[:1500], rng)
        bent = [w for w in bent if w not in clean_words]
        words = positives + bent + negatives + straight
        z = np.hstack([_kernel(words, rows, lm) @ root, np.ones((len(words), 1))])
        t = np.array([1.0] * (len(positives) + len(bent)) + [-1.0] * (len(negatives) + len(straight)))
        mass = np.array([float(min(witnesses[w], 200)) for w in positives])
        share_of = lambda n, part: np.full(n, part / max(1, n))
        often = np.sqrt([float(clean_words[w]) for w in negatives])  # a frequent clean word spoils many texts
        cost = COST * np.concatenate([mass / mass.sum(), share_of(len(bent), BENT), often / often.sum(), share_of(len(straight), 0.1)])
        v = _newton_svm(z, t, cost)
        gamma = lm.T @ (root @ v[:-1])
        weights = np.zeros(1 << BITS, np.float32)
        weights[np.fromiter(rows, np.int64)] = gamma
        machine = KernelMachine(weights, float(v[-1]))
        # Next round: new witnesses by margin, and the clean words that the machine gets most wrong.
        cache: dict[str, float] = {}
        witnesses = {}
        for b in toxic_bags:
            new = [w for w in b if w not in cache]
            cache.update(zip(new, machine.margins(new).tolist(), strict=True) if new else ())
            own = certain.intersection(b) or {w for w in b if w not in clean_words and cache[w] > 0 and cache[w] == max(map(cache.__getitem__, b))}
            for w in own:
                witnesses[w] = witnesses.get(w, 0) + 1
        wrong = []
        for i in range(0, len(every), 4096):
            part = every[i : i + 4096]
            m = machine.margins(part)
            wrong += [(float(m[j]), part[j]) for j in np.argsort(-m)[:400].tolist() if m[j] > -0.7]
        wrong.sort(reverse=True)
        hard = [w for _, w in wrong[:3000]]
        negatives = hard + [w for w in negatives if w in clean_words][: 9000 - len(hard)]
    cache = {}
    m = np.array([machine.text_margin(t, cache) for t in texts])
    # Platt scaling of the documents' margins gives the slope; one half lies where both kinds err least together.
    x, ab = np.stack([m, np.ones(len(m))], 1), np.array([3.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.3, 0.01])
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (p - y) + np.array([0.3 * (ab[0] - 3.0), 0.01 * ab[1]])), -2, 2)
    machine.slope = float(max(ab[0], 0.1))
    machine.offset = -machine.slope * _threshold(m, y)
    return machine


def _threshold(m: np.ndarray, y: np.ndarray) -> float:
    """The margin that parts the kinds with the least sum of their error rates."""
    order = np.argsort(m)
    m, y = m[order], y[order]
    missed, alarms = np.append(0, y.cumsum()) / y.sum(), 1 - np.append(0, (1 - y).cumsum()) / (1 - y).sum()
    ends = np.append(np.append(m[0] - 1, m), m[-1] + 1)
    cost = np.where(ends[1:] > ends[:-1], missed + alarms, 2.0)
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    k = best[(ends[1:] - ends[:-1])[best].argmax()]
    return float((ends[k] + ends[k + 1]) / 2)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> KernelMachine:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; `rows` bounds them, half of it toxic at most."""
    train_fold = fold_of(5) != 0
    toxic = bounded_labels(labels.filter(F.col("toxic") > 0), "toxic", train_fold, rows // 3)
    clean = bounded_labels(labels.filter(F.col("toxic") <= 0), "toxic", train_fold, rows - rows // 3)
    sample = toxic.unionByName(clean).groupBy("doc_id").agg(F.max("y").alias("y"))
    got = documents.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= FIT_CHARS).join(F.broadcast(sample), "doc_id").select("text", "y").dropDuplicates().toPandas()
    got = got.sort_values(["text", "y"])
    return train(got["text"].tolist(), got["y"].to_numpy())


def score(documents: DataFrame, model: KernelMachine, key: str = "doc_id") -> DataFrame:
    """(key, score) per row: a projection in Arrow batches; the model (1 MB) goes with the closure."""

    def run(batches):
        cache: dict[str, float] = {}
        for b in batches:
            m = [model.text_margin(t or "", cache) for t in b["text"]]
            yield pd.DataFrame({key: b[key], "score": model.probability(m).astype(float)})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInPandas(run, f"{key} {kind}, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, held_out, score, predicted.

    Null and empty texts score like a text without words; repeated rows are scored alike; an empty table gives an
    empty result; with no labels, or one class only, the score is the smoothed share of ones.
    """
    out = score(documents.select("doc_id", "text"), fit(documents, labels))
    return out.select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
