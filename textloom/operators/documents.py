"""What groups by document, made inside the document's row: tokens go to Arrow stages once, and nothing is shuffled.

A document of several rows (the same id again) has no row of its own; its rows are put together, or grouped, first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_array

BATCH_ROWS = 2_000  # texts of an Arrow batch at most
SLICE = 1_000_000  # tokens that a step holds at once, but for a longer document


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _repeated(docs: DataFrame, key: str) -> DataFrame | None:
    """Keys of several rows, none if there are none; only keys are read for it."""
    again = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_again"))
    return None if again.isEmpty() else again


def by_document(docs: DataFrame, inside: Callable[[DataFrame], DataFrame], grouped: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """inside(documents of one row each) and grouped(the others)."""
    small_batches(docs.sparkSession)
    again = _repeated(docs, key)
    if again is None:
        return inside(docs)
    same = docs[key].eqNullSafe(again["_again"])
    return inside(docs.join(again, same, "left_anti")).unionByName(grouped(docs.join(again, same, "left_semi")))


def token_rows(docs: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """(key, t, more): a row a document, with its tokens; those of repeated keys follow each other."""
    t = F.coalesce(token_array(F.col("text")), F.array().cast("array<string>")).alias("t")
    one = docs.select(key, t, *more)
    return by_document(one, lambda d: d, lambda d: d.groupBy(key, *more).agg(F.flatten(F.collect_list("t")).alias("t")).select(key, "t", *more), key)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(first row, rows, values, offsets) of a batch's second column, lists, SLICE values at a time."""
    t = batch.column(1)
    ends = t.offsets.to_numpy()
    a = 0
    while a < len(t):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        part = t.slice(a, b - a)
        off = part.offsets.to_numpy().astype(np.int64)
        yield a, b - a, part.flatten(), off - off[0]
        a = b


def _rows_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def _grams(vals: pa.Array, off: np.ndarray, size: int) -> tuple:
    """(grams, row, pos) of so many neighbouring tokens of a row."""
    row = _rows_of(off)
    if size > 1:
        n = max(0, len(vals) - size + 1)
        held = np.flatnonzero(row[:n] == row[size - 1 :][:n]) if n else np.zeros(0, np.int64)
        vals = pc.binary_join_element_wise(*[vals.take(pa.array(held + k)) for k in range(size)], " ")
        row, at = row[held], held
    else:
        at = np.arange(len(row))
    return vals, row, at - off[:-1][row]


def _groups(vals: pa.Array, row: np.ndarray) -> tuple:
    """(words, code, order, first): equal values of a row together, in their order; first are the groups' starts."""
    coded = vals.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    key = row * max(1, len(coded.dictionary)) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return coded.dictionary, code, order, first


def _stage(rows: DataFrame, schema: str, made: Callable) -> DataFrame:
    """made(batch, first row, rows, values, offsets) -> columns in the schema's order."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            for part in _slices(b):
                yield pa.record_batch(list(made(b, *part)), names)

    return rows.mapInArrow(run, schema)


def _kind(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def listed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.coalesce(token_array(F.col("text")), F.array().cast("array<string>")).alias("t"))


def postings(docs: DataFrame, size: int = 1) -> DataFrame:
    """(gram, doc_id, cnt, pos) of documents of one row each."""
    def made(b, a, n, vals, off):
        grams, row, pos = _grams(vals, off, size)
        words, code, order, first = _groups(grams, row)
        at = order[first]
        return words.take(pa.array(code[at])), b.column(0).take(pa.array(a + row[at])), pa.array(np.diff(np.r_[first, len(order)])), pa.array(pos[at])

    return _stage(listed(docs), f"gram string, doc_id {_kind(docs, 'doc_id')}, cnt bigint, pos bigint", made)


def places(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, places) of documents of one row each: the positions in order, joined by commas."""
    def made(b, a, n, vals, off):
        row = _rows_of(off)
        words, code, order, first = _groups(vals, row)
        pos = pa.array(order - off[:-1][row[order]]).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pos)
        at = order[first]
        return words.take(pa.array(code[at])), b.column(0).take(pa.array(a + row[at])), pc.binary_join(lists, ",")

    return _stage(listed(docs), f"gram string, doc_id {_kind(docs, 'doc_id')}, places string", made)


def space_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, off, tok) as of text.space_tokens, of documents of one row each."""
    parts = F.coalesce(F.regexp_extract_all("text", F.lit(r"\s+|\S+"), F.lit(0)), F.array().cast("array<string>"))

    def made(b, a, n, vals, off):
        row = _rows_of(off)
        before = np.r_[0, np.cumsum(pc.utf8_length(vals).to_numpy().astype(np.int64))]
        word = pc.invert(pc.is_in(pc.utf8_slice_codeunits(vals, 0, 1), pa.array(list(" \t\n\v\f\r")))).to_numpy(zero_copy_only=False)
        words, at = np.r_[0, np.cumsum(word)], np.flatnonzero(word)
        start = off[:-1][row[at]]
        return b.column(0).take(pa.array(a + row[at])), pa.array(words[at] - words[start]), pa.array(before[at] - before[start]), vals.take(pa.array(at))

    return _stage(docs.select(key, parts.alias("t")), f"{key} {_kind(docs, key)}, pos bigint, off bigint, tok string", made)


def placed_pieces(words: DataFrame, key: str) -> DataFrame:
    """(key, pos, sub, off, tok): pieces of words (key, ps, pos, off), each where the ones before it end."""
    def made(b, a, n, vals, off):
        row = _rows_of(off)
        before = np.r_[0, np.cumsum(pc.utf8_length(vals).to_numpy().astype(np.int64))]
        of, start = pa.array(a + row), off[:-1][row]
        return b.column(0).take(of), b.column(2).take(of), pa.array(np.arange(len(row)) - start), pc.add(b.column(3).take(of), pa.array(before[:-1] - before[start])), vals

    return _stage(words, f"{key} {_kind(words, key)}, pos bigint, sub bigint, off bigint, tok string", made)


def top_feature(docs: DataFrame) -> DataFrame:
    """(doc_id, gram, topcnt): the most frequent token of each document; the least among equals."""
    def made(b, a, n, vals, off):
        row = _rows_of(off)
        words, code, order, first = _groups(vals, row)
        cnt, at = np.diff(np.r_[first, len(order)]), order[first]
        most = np.zeros(n, np.int64)
        np.maximum.at(most, row[at], cnt)
        best = np.flatnonzero(cnt == most[row[at]])
        rows, grams = row[at][best], words.take(pa.array(code[at][best]))
        by = pc.sort_indices(pa.table({"r": rows, "g": grams}), [("r", "ascending"), ("g", "ascending")]).to_numpy()
        one = by[np.flatnonzero(np.r_[True, np.diff(rows[by]) != 0])] if len(by) else by
        return b.column(0).take(pa.array(a + rows[one])), grams.take(pa.array(one)), pa.array(cnt[best][one])

    return _stage(token_rows(docs), f"doc_id {_kind(docs, 'doc_id')}, gram string, topcnt bigint", made)


def term_shares(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, tok, tf, more): share of the document's tokens."""
    rows = token_rows(docs, "doc_id", *more)

    def made(b, a, n, vals, off):
        row = _rows_of(off)
        words, code, order, first = _groups(vals, row)
        at = order[first]
        of = pa.array(a + row[at])
        tf = np.diff(np.r_[first, len(order)]) / np.diff(off)[row[at]]
        return b.column(0).take(of), words.take(pa.array(code[at])), pa.array(tf), *[b.column(2 + k).take(of) for k in range(len(more))]

    return _stage(rows, f"doc_id {_kind(docs, 'doc_id')}, tok string, tf double" + "".join(f", {c} {_kind(docs, c)}" for c in more), made)


def _most(values: pa.Array, order: np.ndarray, first: np.ndarray) -> pa.Array:
    """The largest value of each group that is not null."""
    if not len(first):
        return values.slice(0, 0)
    known = values.is_valid().to_numpy(zero_copy_only=False)[order]
    held = pc.fill_null(values, 0).to_numpy()[order]
    least = np.iinfo(held.dtype).min if held.dtype.kind in "iu" else -np.inf
    out = np.maximum.reduceat(np.where(known, held, least), first)
    return pa.array(out, values.type, mask=~np.logical_or.reduceat(known, first))


def weighted_postings(docs: DataFrame, counted: bool = True) -> DataFrame:
    """(gram, doc_id, weight, cnt, pos, len) as of index.weighted_postings, of documents (doc_id, rows) of one row each:
    rows are structs of gram, weight, pos, len, override and pinned."""
    f = {x.name: x.dataType.simpleString() for x in docs.schema["rows"].dataType.elementType.fields}

    def made(b, a, n, vals, off):
        row, part = _rows_of(off), dict(zip([x.name for x in vals.type], vals.flatten(), strict=True))
        words, code, order, first = _groups(part["gram"], row)
        pos = part["pos"].to_numpy()
        order = np.lexsort((pos, row * max(1, len(words)) + code))  # ends of groups are the same
        at = order[first]
        pinned = pc.fill_null(part["pinned"], False).to_numpy(zero_copy_only=False)[order].astype(np.int64)
        cnt = np.add.reduceat(1 - pinned, first) + np.maximum.reduceat(pinned, first) if len(first) else first
        weight = pc.coalesce(_most(part["override"], order, first), _most(part["weight"], order, first))
        of = pa.array(at)
        return words.take(pa.array(code[at])), b.column(0).take(pa.array(a + row[at])), weight, pa.array(cnt if counted else np.ones(len(first), np.int64)), part["pos"].take(of), part["len"].take(of)

    return _stage(docs.select("doc_id", F.coalesce("rows", F.array().cast(docs.schema["rows"].dataType)).alias("rows")), f"gram string, doc_id {_kind(docs, 'doc_id')}, weight {f['weight']}, cnt bigint, pos {f['pos']}, len {f['len']}", made)


def bead_features(docs: DataFrame, number: str, stop: pa.Array, words_of: dict[str, str], most: int = 3) -> DataFrame:
    """(doc_id, gram, size, pos) as of index.bead_features, of documents (doc_id, text) of one row each; all tokens count.

    number: pattern of whole numbers; stop: words that end no gram; words_of: word to its only meaning.
    """
    sent = docs.sparkSession.sparkContext.broadcast((stop, pa.array(list(words_of), pa.string()), pa.array([f"@{v}" for v in words_of.values()], pa.string())))

    def made(b, a, n, vals, off):
        stop, word, meaning = sent.value
        coded = vals.dictionary_encode()
        own, code = coded.dictionary, coded.indices
        digits = pc.match_substring_regex(own, number)
        in_thousandths = pc.binary_join_element_wise("#", pc.multiply(pc.if_else(digits, own, "0").cast(pa.int64()), 1000).cast(pa.string()), "")
        feature = pc.coalesce(meaning.take(pc.index_in(own, word)), pc.if_else(digits, in_thousandths, own))
        beads, ends = feature.take(code), pc.invert(pc.is_in(own, stop)).take(code).to_numpy(zero_copy_only=False)
        out = []
        for size in range(1, most + 1):
            grams, row, pos = _grams(beads, off, size)
            held = np.flatnonzero(ends[off[:-1][row] + pos + size - 1])
            out.append((b.column(0).take(pa.array(a + row[held])), grams.take(pa.array(held)), pa.array(np.full(len(held), size, np.int32)), pa.array(pos[held])))
        return [pa.concat_arrays(x) for x in zip(*out, strict=True)]

    return _stage(listed(docs), f"doc_id {_kind(docs, 'doc_id')}, gram string, size int, pos bigint", made)


LANGUAGE_WORDS = 300_000  # words whose shares a task keeps at once


def language_scores(docs: DataFrame, model: pa.Table) -> DataFrame:
    """(doc_id, guess) as of text.language_guess: model (g, shares) goes to every task, and a document's tokens are
    added up in its row."""
    langs = sorted({s["lang"] for x in model.column("shares").to_pylist() for s in x})
    place = {lang: k for k, lang in enumerate(langs)}
    shares = {g: [(place[s["lang"]], s["p"]) for s in x] for g, x in zip(model.column("g").to_pylist(), model.column("shares").to_pylist(), strict=True)}
    sent = docs.sparkSession.sparkContext.broadcast(shares)

    def of_word(word: str) -> np.ndarray:
        """Summed shares by language, and of how many trigrams."""
        out = np.zeros(2 * len(langs))
        padded = f" {word} "
        for g in {padded[i : i + 3] for i in range(len(padded) - 2)}:
            for k, p in sent.value.get(g, ()):
                out[k] += p
                out[len(langs) + k] += 1
        return out

    def run(batches):
        known: dict[str, np.ndarray] = {}
        for b in batches:
            for a, n, vals, off in _slices(b):
                coded = vals.dictionary_encode()
                if len(known) > LANGUAGE_WORDS:
                    known.clear()
                table = np.zeros((len(coded.dictionary), 2 * len(langs)))
                for k, w in enumerate(coded.dictionary.to_pylist()):
                    if w not in known:
                        known[w] = of_word(w)
                    table[k] = known[w]
                full = np.flatnonzero(np.diff(off))
                if not len(full) or not langs:
                    continue
                total = np.add.reduceat(table[coded.indices.to_numpy()], off[:-1][full])
                score = np.where(total[:, len(langs) :] > 0, np.floor(total[:, : len(langs)] * 1e6 + 0.5), -1.0)
                best = len(langs) - 1 - np.argmax(score[:, ::-1], axis=1)  # the last language among equals
                held = np.flatnonzero(score.max(axis=1) >= 0)
                yield pa.record_batch([b.column(0).take(pa.array(a + full[held])), pa.array(langs, pa.string()).take(pa.array(best[held]))], ["doc_id", "guess"])

    return token_rows(docs).mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, guess string")


def phrase_words(rows: DataFrame) -> DataFrame:
    """(gram, n): words and in how many phrases (k, t) they are, a row a batch."""
    def run(batches):
        for b in batches:
            for _, _, vals, off in _slices(b):
                words, code, order, first = _groups(vals, _rows_of(off))
                n = np.bincount(code[order[first]], minlength=len(words))
                yield pa.record_batch([words, pa.array(n)], ["gram", "n"])

    return rows.mapInArrow(run, "gram string, n bigint")


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class Counts:
    """Counts of words by 64-bit hash; -1 where two words share one."""

    def __init__(self, words: DataFrame) -> None:
        """words: (gram, n)."""
        def run(batches):
            for b in batches:
                yield pa.record_batch([pa.array(_hashes(b.column(0)).view(np.int64)), b.column(1)], ["h", "n"])

        got = words.select("gram", "n").mapInArrow(run, "h bigint, n bigint").toArrow()
        h = got.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, n = h[order], got.column("n").to_numpy()[order].copy()
        again = np.flatnonzero(h[1:] == h[:-1])
        n[again] = n[again + 1] = -1
        self.hash, self.n = h, n

    def of(self, words: pa.Array) -> np.ndarray:
        """A count of each word; 0 for those that are not held."""
        if not len(self.hash) or not len(words):
            return np.zeros(len(words), np.int64)
        h = _hashes(words)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.n[at], 0)


def even_grams(rows: DataFrame, counts, size: int) -> DataFrame:
    """(gram, n): grams of a size and in how many phrases (k, t) they are, a row a batch, but for those whose words are
    in different numbers of phrases (counts: a broadcast of Counts) or are not held."""
    def run(batches):
        for b in batches:
            for _, _, vals, off in _slices(b):
                coded = vals.dictionary_encode()
                n = counts.value.of(coded.dictionary)[coded.indices.to_numpy()]
                row = _rows_of(off)
                last = max(0, len(vals) - size + 1)
                parts = [n[k : k + last] for k in range(size)]
                even = (row[:last] == row[size - 1 :][:last]) & np.all([x != 0 for x in parts], axis=0) if last else np.zeros(0, bool)
                for x in parts[1:]:
                    even &= (x == parts[0]) | (x < 0) | (parts[0] < 0)
                at = np.flatnonzero(even)
                grams = pc.binary_join_element_wise(*[vals.take(pa.array(at + k)) for k in range(size)], " ")
                words, code, order, first = _groups(grams, row[at])
                yield pa.record_batch([words, pa.array(np.bincount(code[order[first]], minlength=len(words)))], ["gram", "n"])

    return rows.mapInArrow(run, "gram string, n bigint")


class Asked:
    """Queries (item, gram) as arrays: for each gram of the vocabulary the items that have it."""

    def __init__(self, queries: pa.Table) -> None:
        gram = queries.column("gram").combine_chunks().dictionary_encode()
        item = queries.column("item_id").combine_chunks().dictionary_encode()
        self.vocabulary, self.items = gram.dictionary, item.dictionary
        order = np.argsort(gram.indices.to_numpy(), kind="stable")
        self.item = item.indices.to_numpy().astype(np.int64)[order]
        self.start = np.r_[0, np.cumsum(np.bincount(gram.indices.to_numpy(), minlength=len(self.vocabulary)))]

    def within(self, a: int, b: int) -> Asked:
        """Only the items a to b."""
        out = object.__new__(Asked)
        held = (self.item >= a) & (self.item < b)
        out.vocabulary, out.items, out.item = self.vocabulary, self.items, self.item[held]
        out.start = np.r_[0, np.cumsum(held)][self.start]
        return out

    def met(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into code, item) of each item of each code."""
        n = (self.start[1:] - self.start[:-1])[code]
        which = np.repeat(np.arange(len(code)), n)
        return which, self.item[np.arange(len(which)) - (np.cumsum(n) - n)[which] + self.start[code][which]]


CELLS = 4_000_000  # documents times items that a step holds at once


def frequencies(rows: DataFrame, asked) -> np.ndarray:
    """For each gram of the vocabulary (asked: a broadcast of Asked) the number of documents (doc_id, t) that have it."""
    def run(batches):
        total = np.zeros(len(asked.value.vocabulary), np.int64)
        for b in batches:
            for _, _, vals, off in _slices(b):
                code = pc.fill_null(pc.index_in(vals, asked.value.vocabulary), -1).to_numpy().astype(np.int64)
                pairs = np.unique((_rows_of(off) * len(total) + code)[code >= 0])
                total += np.bincount(pairs % max(1, len(total)), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["code", "n"])

    got = rows.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(asked.value.vocabulary), np.int64)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out


def best_documents(rows: DataFrame, asked, score: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int, item_kind: str) -> DataFrame:
    """(item_id, doc_id, score): the best `most` documents (doc_id, t) of each task, by score to six places, then id.

    score(code, count): of a gram of the vocabulary that a document has so often.
    """
    def run(batches):
        own, held = asked.value, None
        items = len(own.items)
        worst = np.full(items, -np.inf)  # what a document must reach to be among the best so far
        for b in batches:
            for a, n, vals, off in _slices(b):
                code = pc.fill_null(pc.index_in(vals, own.vocabulary), -1).to_numpy().astype(np.int64)
                pairs, count = np.unique((_rows_of(off) * len(own.vocabulary) + code)[code >= 0], return_counts=True)
                row, code = pairs // max(1, len(own.vocabulary)), pairs % max(1, len(own.vocabulary))
                weight = score(code, count)
                step = max(1, CELLS // max(1, items))
                for lo in range(0, n, step):
                    k0, k1 = np.searchsorted(row, [lo, lo + step])
                    which, item = own.met(code[k0:k1])
                    if not len(which):
                        continue
                    of = min(step, n - lo)
                    cells = np.bincount((row[k0:k1][which] - lo) * items + item, weight[k0:k1][which], of * items).reshape(of, items)
                    cells = np.where(cells > 0, np.floor(cells * 1e6 + 0.5) / 1e6, -1.0)
                    if of > most and (cells >= worst).sum() > 4 * most * items:
                        worst = np.maximum(worst, np.partition(cells, of - most, axis=0)[of - most])
                    r, i = np.nonzero((cells >= worst) & (cells >= 0))
                    new = pa.table({"i": i, "s": cells[r, i], "d": b.column(0).take(pa.array(a + lo + r))})
                    held = new if held is None else pa.concat_tables([held, new])
                    if held.num_rows > 4 * most * items:
                        held = _first(held, most)
                        full = np.bincount(held.column("i").to_numpy(), minlength=items) >= most
                        low = np.full(items, np.inf)
                        np.minimum.at(low, held.column("i").to_numpy(), held.column("s").to_numpy())
                        worst = np.where(full, np.maximum(worst, low), worst)
        if held is not None and held.num_rows:
            held = _first(held, most).combine_chunks()
            for x in held.to_batches():
                yield pa.record_batch([own.items.take(x.column(0)), x.column(2), x.column(1)], ["item_id", "doc_id", "score"])

    return rows.select("doc_id", "t").mapInArrow(run, f"item_id {item_kind}, doc_id {_kind(rows, 'doc_id')}, score double")


def _first(held: pa.Table, most: int) -> pa.Table:
    """The best `most` rows of each item: by score, then id, null ids first."""
    by = pc.sort_indices(held, [("i", "ascending"), ("s", "descending"), ("d", "ascending")], null_placement="at_start")
    held = held.take(by)
    i = held.column("i").to_numpy()
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    return held.filter(pa.array(np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < most))


def chunks(rows: DataFrame, asked, width: int, item_kind: str, first_only: bool = False) -> DataFrame:
    """(item_id, doc_id, rank, pos, weight) as of names.chunks, of documents (doc_id, t) of one row each."""
    half = width // 2

    def spots(own: Asked, row, pos, code):
        """Places of a slice's tokens: document and item, place, weight; in pieces of about SLICE."""
        size = np.cumsum((own.start[1:] - own.start[:-1])[code])
        if not len(size) or not size[-1]:
            return
        if size[-1] > 2 * SLICE:
            middle = row[np.searchsorted(size, size[-1] // 2)]
            cut = np.searchsorted(row, middle) or np.searchsorted(row, middle, "right")
            if 0 < cut < len(row):
                yield from spots(own, row[:cut], pos[:cut], code[:cut])
                yield from spots(own, row[cut:], pos[cut:], code[cut:])
                return
            lo, hi = own.item.min(), own.item.max() + 1
            if hi - lo > 1:  # one long document: items in two halves
                yield from spots(own.within(lo, (lo + hi) // 2), row, pos, code)
                yield from spots(own.within((lo + hi) // 2, hi), row, pos, code)
                return
        which, item = own.met(code)
        pair = row[which] * len(own.items) + item
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], pos[which][order]
        far = int(at.max()) + width + 1
        line = np.cumsum(np.r_[0, pair[1:] != pair[:-1]]) * far + at  # pairs in a row on one line, out of reach of each other
        weight = np.ones(len(line), np.int64)
        for s in range(1, half + 1):
            near = line[s:] - line[:-s] <= half
            if not near.any():
                break
            weight[s:] += near
            weight[:-s] += near
        yield pair, at, line, weight

    def choose(line, weight):
        """Indices that the greedy choice keeps: whoever is the best within reach is chosen, its neighbours go."""
        alive, out = np.arange(len(line)), []
        while len(alive):
            x, w = line[alive], weight[alive]
            lost = np.zeros(len(x), bool)
            for s in range(1, width):
                near = x[s:] - x[:-s] < width
                if not near.any():
                    break
                later = w[s:] > w[:-s]
                lost[:-s] |= near & later
                lost[s:] |= near & ~later
            out.append(alive[~lost])
            none = -(1 << 60)
            before = np.maximum.accumulate(np.where(lost, none, x))
            after = -np.maximum.accumulate(np.where(lost, none, -x)[::-1])[::-1]
            alive = alive[(x - before >= width) & (after - x >= width)]
        return np.sort(np.concatenate(out)) if out else alive

    def run(batches):
        own = asked.value
        items = len(own.items)
        for b in batches:
            for a, _, vals, off in _slices(b):
                code = pc.fill_null(pc.index_in(vals, own.vocabulary), -1).to_numpy().astype(np.int64)
                held = np.flatnonzero(code >= 0)
                row = _rows_of(off)[held]
                for pair, at, line, weight in spots(own, row, held - off[:-1][row], code[held]):
                    if first_only:
                        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                        far = int(at.max()) + 1
                        best = np.maximum.reduceat(weight * far + (far - 1 - at), start)
                        pair, weight, at, rank = pair[start], best // far, far - 1 - best % far, np.ones(len(start), np.int64)
                    else:
                        kept = choose(line, weight)
                        kept = kept[np.lexsort((at[kept], -weight[kept], pair[kept]))]
                        pair, weight, at = pair[kept], weight[kept], at[kept]
                        start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                        rank = np.arange(len(pair)) - np.repeat(start, np.diff(np.r_[start, len(pair)])) + 1
                    yield pa.record_batch([own.items.take(pa.array(pair % items)), b.column(0).take(pa.array(a + pair // items)), pa.array(rank), pa.array(at), pa.array(weight)], ["item_id", "doc_id", "rank", "pos", "weight"])

    return rows.mapInArrow(run, f"item_id {item_kind}, doc_id {_kind(rows, 'doc_id')}, rank bigint, pos bigint, weight bigint")
