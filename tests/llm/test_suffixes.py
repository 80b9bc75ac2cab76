"""Hot strings in the suffix queue, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from textloom.llm import suffixes

SCHEMA = "doc_id long, text string"


def _want(docs, window=100):
    seen, out = {}, {}
    for i, t in sorted(docs):
        data = t.encode()
        dead = bytearray(len(data))
        for k in range(len(data) - window + 1):
            w = data[k : k + window]
            if w in seen:
                dead[k : k + window] = b"\x01" * window
            else:
                seen[w] = (i, k)
        kept = bytes(x for x, gone in zip(data, dead, strict=True) if not gone)
        runs = sum(1 for k, gone in enumerate(dead) if gone and (k == 0 or not dead[k - 1]))
        out[i] = (len(data), sum(dead), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("rows", [64, 1_000_000])
def test_a_hot_string_is_never_held_as_a_whole(spark, monkeypatch, rows):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, warm = noise(130), noise(220)
    docs = [(i, noise(rng.randrange(60)) + (hot if i % 3 else warm[: 100 + i % 90]) + noise(rng.randrange(60))) for i in range(400)]
    docs += [(1000 + i, "z" * (90 + 7 * i)) for i in range(12)]
    monkeypatch.setattr(suffixes, "QUEUE_ROWS", rows)
    monkeypatch.setattr(suffixes.TupleQueue.__init__, "__defaults__", (rows,))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == _want(docs)


def test_blocks_of_the_queue_are_bounded():
    """A hundred thousand tuples of one anchor come out in blocks of about the queue's size, in order."""
    queue, rng = suffixes.TupleQueue(1000), np.random.default_rng(1)
    place = rng.permutation(100_000).astype(np.int64)
    for k in range(0, 100_000, 700):
        part = place[k : k + 700]
        queue.push(np.full(len(part), 7, np.uint64), np.full(len(part), 9, np.uint64), part)
    sizes, seen = [], []
    for a, m, d in queue.pop():
        sizes.append(len(a))
        seen.append(d)
        assert (a == 7).all() and (m == 9).all()
    assert max(sizes) <= 2000 and (np.concatenate(seen) == np.arange(100_000)).all()
