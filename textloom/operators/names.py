"""Fuzzy entity-name search by character trigrams, autocomplete, topics, geography, tag classifier."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, trigrams
from ..functions.words import sound, to_latin
from . import documents as D

COVERAGE_LEAST, COVERAGE_DROP, RANK_DROP, NAMES_MOST = 0.3, 0.1, 0.15, 64
CIRCUMFERENCE_KM = 40000.0
QUERY_GRAMS_MOST = 1_000_000  # grams of all queries that go to every task; more are joined


def normalised(name: Column) -> Column:
    """Lower case; digits and letters apart; punctuation and space as one blank; the word `and` left out."""
    x = F.regexp_replace(F.lower(name), "([0-9])([a-z])", "$1 $2")
    x = F.regexp_replace(x, "([a-z])([0-9])", "$1 $2")
    x = F.regexp_replace(x, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), " and ", " "))


def one_each(rows: DataFrame) -> DataFrame:
    """Distinct rows, before anything is made of them.

    Not distinct(): the optimizer drops one that another distinct follows, and tests for null of what is made of the
    rows go below it; then what is costly to make is made for every row.  Values that need a count stay above it.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return counted.select(*[F.when(F.col("_n") > 0, F.col(c)).alias(c) for c in rows.columns])


def name_grams(names: DataFrame) -> DataFrame:
    """(name, gram) of distinct normalised names."""
    return one_each(names.select("name")).select(normalised(F.col("name")).alias("name")).distinct().select("name", F.explode(trigrams(F.col("name"))).alias("gram"))


def match_names(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, name, shared, relevance, coverage): at least COVERAGE_LEAST, within COVERAGE_DROP of the best.

    queries: (qid, q).  A name that covers so much of a query has one of its rarest grams, all but so many: only these
    are joined, so a gram that most names have meets only queries that have nothing rarer.  Relevance is the sum of
    1/df^2 over the shared grams.
    """
    held = one_each(one_each(names.select("name")).select(normalised(F.col("name")).alias("name"))).withColumn("gs", trigrams(F.col("name")))
    df = held.select(F.explode("gs").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    asked = queries.select("qid", trigrams(normalised(F.col("q"))).alias("gs")).select("qid", F.size("gs").alias("nq"), F.explode("gs").alias("gram"))
    asked = asked.join(df, "gram", "left").groupBy("qid", "nq").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("qs"))
    rare = F.slice("qs", F.lit(1), (F.col("nq") - F.ceil(F.col("nq") * COVERAGE_LEAST - 1e-9) + 1).cast("int"))
    probes = asked.select("qid", "nq", "qs", F.explode(rare).alias("p")).select("qid", "nq", "qs", F.col("p.gram").alias("gram"))
    met = probes.join(held.select("name", "gs", F.explode("gs").alias("gram")), "gram").groupBy("qid", "name").agg(F.any_value("nq").alias("nq"), F.any_value("qs").alias("qs"), F.any_value("gs").alias("gs"))
    shared = F.filter("qs", lambda x: F.array_contains("gs", x["gram"]))
    weight = F.aggregate("shared_grams", F.lit(0.0), lambda acc, x: acc + 1 / (x["df"] * x["df"]))
    hits = met.withColumn("shared_grams", shared).select("qid", "nq", "name", F.size("shared_grams").cast("long").alias("shared"), F.round(weight, 6).alias("relevance"))
    hits = hits.withColumn("coverage", F.round(F.col("shared") / F.col("nq"), 6)).filter(F.col("coverage") >= COVERAGE_LEAST)
    top = F.max("coverage").over(Window.partitionBy("qid"))
    return hits.withColumn("best", top).filter(F.col("best") - F.col("coverage") <= COVERAGE_DROP + 1e-9).select("qid", "name", "shared", "relevance", "coverage")


SOUND_SHARE, SOUND_BELOW = 0.98, 0.85


def match_sounds(names: DataFrame, queries: DataFrame) -> DataFrame:
    """As match_names, and for queries whose best coverage is below SOUND_BELOW (or that have none) also by sound.

    By sound, the words of names and queries are compared as they sound, with SOUND_SHARE of the coverage; a name that
    matches both ways counts with its larger coverage.
    """
    straight = match_names(names, queries)
    sounds = lambda c: F.array_join(F.transform(F.split(normalised(to_latin(c)), " "), lambda w: sound(w, 4)), " ")
    poor = straight.groupBy("qid").agg(F.max("coverage").alias("best")).filter(F.col("best") >= SOUND_BELOW)
    asked = queries.join(poor, "qid", "left_anti").select("qid", sounds(F.col("q")).alias("q"))
    own = one_each(one_each(names.select("name")).select(normalised(F.col("name")).alias("name")))
    heard = match_names(own.select(sounds(F.col("name")).alias("name")), asked).withColumnRenamed("name", "s")
    back = heard.join(own.withColumn("s", normalised(sounds(F.col("name")))), "s").withColumn("coverage", F.round(F.col("coverage") * SOUND_SHARE, 6))
    both = straight.unionByName(back.select(*straight.columns))
    best = both.groupBy("qid", "name").agg(F.max(F.struct("coverage", "shared", "relevance")).alias("b")).select("qid", "name", "b.*")
    top = F.max("coverage").over(Window.partitionBy("qid"))
    return best.withColumn("top", top).filter(F.col("top") - F.col("coverage") <= COVERAGE_DROP + 1e-9).select(*straight.columns)


#: From this length on a query's longest common part with a name counts; the curve of its weight.
LONG_QUERY, CURVE_AT, CURVE_WIDTH, CURVE_SHARE = 10, 0.5, 0.1, 0.7


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def boosted_long(hits: DataFrame) -> DataFrame:
    """hits (qid, q, name, coverage, ..) of queries of LONG_QUERY letters and more with a coverage raised by the share of
    the query that its longest common part with the name has: 1 - (1 - coverage) * (1 - CURVE_SHARE * curve(share))."""
    @F.pandas_udf("double")
    def common(q: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([longest_common(a, b) / len(a) if a else 0.0 for a, b in zip(q, name, strict=True)], dtype="float64")

    share = common(normalised(F.col("q")), F.col("name"))
    curve = 1 / (1 + F.exp(-(share - CURVE_AT) / CURVE_WIDTH))
    raised = F.round(1 - (1 - F.col("coverage")) * (1 - CURVE_SHARE * curve), 6)
    return hits.withColumn("coverage", F.when(F.length("q") >= LONG_QUERY, raised).otherwise(F.col("coverage")))


STEP_DROP = 0.8


def ranked_names(hits: DataFrame, rank: DataFrame, cut: bool = True) -> DataFrame:
    """(qid, name, score, rank): coverage * (1 + popularity), shorter names first.

    rank: (name, pop).  The list ends where the score is RANK_DROP below the first or STEP_DROP below the one before,
    unless cut is false; NAMES_MOST at most.
    """
    scored = hits.join(rank, "name").withColumn("score", F.round(F.col("coverage") * (1 + F.col("pop")), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.length("name"), "name")
    out = scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= NAMES_MOST)
    if cut:
        drop = (F.first("score").over(w) - F.col("score") > RANK_DROP) | (F.coalesce(F.lag("score").over(w), F.col("score")) - F.col("score") > STEP_DROP)
        out = out.withColumn("over", drop.cast("int")).withColumn("over", F.max("over").over(w)).filter("over = 0")
    return out.select("qid", "name", "score", "rank")


def rewritten_query(q: Column, rules: list[tuple[str, str]]) -> Column:
    """A query after mandatory replacements (pattern, replacement), one after the other."""
    for pattern, replacement in rules:
        q = F.regexp_replace(q, pattern, replacement)
    return q


def id_search(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, cls, sub, id, coverage): trigram search of queries (qid, cls, sub, q) over the ids of their class.

    entities: (cls, sub, id).
    """
    ids = entities.select("cls", "sub", "id", F.concat_ws("|", "cls", "sub").alias("k")).distinct()
    grams = ids.select("k", "cls", "sub", "id", F.explode(trigrams(F.lower("id"))).alias("g"))
    asked = queries.select("qid", F.concat_ws("|", "cls", "sub").alias("k"), trigrams(F.lower("q")).alias("gs")).select("qid", "k", F.size("gs").alias("n"), F.explode("gs").alias("g"))
    met = asked.join(grams, ["k", "g"]).groupBy("qid", "n", "cls", "sub", "id").agg(F.count("*").alias("shared"))
    rated = met.withColumn("coverage", F.round(F.col("shared") / F.col("n"), 6)).filter(F.col("coverage") >= COVERAGE_LEAST)
    return rated.select("qid", "cls", "sub", "id", "coverage")


def post_parse_queries(beads: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, q): a query's text with every named entity by each of its names in turn.

    beads: (qid, pos, word, cls, sub, id): words, or entities.  names: (cls, sub, id, name).  A query has as many texts
    as the product of the numbers of names, so it is cut at NAMES_MOST texts, in the order of names.
    """
    keyed = beads.join(names, ["cls", "sub", "id"], "left").groupBy("qid", "pos").agg(F.array_sort(F.collect_set(F.coalesce("name", "word"))).alias("alts"))
    parts = keyed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "alts"))).alias("parts"))
    one = F.expr("array('')")
    grown = lambda acc, p: F.slice(F.flatten(F.transform(acc, lambda t: F.transform(p["alts"], lambda a: F.trim(F.concat(t, F.lit(" "), a))))), 1, NAMES_MOST)
    return parts.select("qid", F.explode(F.aggregate("parts", one, grown)).alias("q"))


#: Fixed value: letters up to which a query is searched among names unasked.
SEARCHED_LENGTH = 34


def searched(q: Column, mode: str = "auto") -> Column:
    """Whether a query is searched among names: always, never, or (auto) by its length or when it looks like an id:
    one word of four characters or more with a digit."""
    looks = q.rlike(r"^\S*[0-9]\S*$") & (F.length(q) >= 4)
    return {"always": F.lit(True), "never": F.lit(False)}.get(mode, (F.length(q) < SEARCHED_LENGTH) | looks)


def islands(queries: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """(qid, name, first, last): longest runs of a query's trigrams that one name has, with one gap of a gram allowed.

    Positions are those of the grams in the query; runs of fewer than `least` grams are left out.  A run is a maximal
    stretch of positions whose neighbours are at most two apart, with at most one gap.
    """
    padded = F.concat(F.lit(" "), normalised(F.col("q")), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("p") - 2, F.lit(1))), lambda i: F.substr("p", i, F.lit(3)))
    asked = queries.select("qid", padded.alias("p")).select("qid", F.posexplode(grams).alias("pos", "gram"))
    hits = asked.join(name_grams(names), "gram").select("qid", "name", "pos").distinct()
    at = F.array_sort(F.collect_set("pos"))
    empty = F.expr("cast(array() as array<struct<first:int,last:int,n:int,gap:int>>)")
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: x - last(acc)["last"] - 1
    put = lambda first, x, n, gap: F.struct(first.alias("first"), x.alias("last"), n.alias("n"), gap.alias("gap"))
    joins = lambda acc, x: (F.size(acc) > 0) & (step(acc, x) + last(acc)["gap"] <= 1)
    longer = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(put(last(acc)["first"], x, last(acc)["n"] + 1, last(acc)["gap"] + step(acc, x))))
    fold = lambda acc, x: F.when(joins(acc, x), longer(acc, x)).otherwise(F.concat(acc, F.array(put(x, x, F.lit(1), F.lit(0)))))
    runs = hits.groupBy("qid", "name").agg(at.alias("at")).select("qid", "name", F.explode(F.aggregate("at", empty, fold)).alias("r")).filter(F.col("r.n") >= least)
    return runs.withColumn("k", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("r.n")))).filter("k = 1").select("qid", "name", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


PREFIX_KEY = 3  # letters by which names and prefixes meet before the prefix test


def autocomplete(names: DataFrame, prefixes: DataFrame, most: int = 10) -> DataFrame:
    """(prefix, name, rank): names that start with the prefix, shortest path less relevance first.

    Names and prefixes meet by their first letters, shorter prefixes by as many as they have.
    """
    key = F.sequence(F.lit(1), F.lit(PREFIX_KEY))
    named = names.select("*", F.explode(F.transform(key, lambda n: F.when(F.length("name") >= n, F.substr("name", F.lit(1), n)))).alias("k")).filter("k IS NOT NULL")
    asked = prefixes.withColumn("k", F.substring("prefix", 1, PREFIX_KEY))
    hits = named.join(asked, "k").filter(F.col("name").startswith(F.col("prefix")))
    return best_names(hits.groupBy("prefix", "name").agg(F.min(F.length("name") - F.col("relevance")).alias("w")), most)


def best_names(rated: DataFrame, most: int = 10) -> DataFrame:
    """(prefix, name, rank) of rated (prefix, name, w): the least w first."""
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("w", "name"))
    return rated.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("prefix", "name", "rank")


def completions(paths: DataFrame, prefixes: DataFrame, most: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(prefix, name, rank): entities of rule paths that a prefix begins; 100 a further word plus the rest of the word
    begun, less relevance, is the length of the way.

    paths: (path, name, cls, relevance): a path's words joined by blanks.  allowed: (cls) of classes that are asked for.
    """
    own = paths if allowed is None else paths.join(allowed.select("cls").distinct(), "cls", "left_semi")
    key = F.sequence(F.lit(1), F.lit(PREFIX_KEY))
    keyed = own.select("*", F.explode(F.transform(key, lambda n: F.when(F.length("path") >= n, F.substr("path", F.lit(1), n)))).alias("k")).filter("k IS NOT NULL")
    hits = keyed.join(prefixes.withColumn("k", F.substring("prefix", 1, PREFIX_KEY)), "k").filter(F.col("path").startswith(F.col("prefix")))
    rest = F.substr("path", F.length("prefix") + 1)
    words = F.size(F.split(F.trim(rest), " ")) - F.when(F.trim(rest) == "", 1).otherwise(0)
    begun = F.length(F.substring_index(rest, " ", 1))
    return best_names(hits.groupBy("prefix", "name").agg(F.min(words * 100 + begun - F.col("relevance")).alias("w")), most)


def completed_or_searched(completed: DataFrame, names: DataFrame, prefixes: DataFrame, most: int = 10, least: int = 4) -> DataFrame:
    """completed (prefix, name, rank), filled up to `most` by name search for prefixes of `least` letters and more.

    names: (name, relevance): the search's names follow, best coverage times popularity first.
    """
    held = completed.groupBy("prefix").agg(F.count("*").alias("n"))
    short = prefixes.filter(F.length("prefix") >= least).join(held, "prefix", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < most)
    found = match_names(names, short.select(F.col("prefix").alias("qid"), F.col("prefix").alias("q"))).withColumnRenamed("qid", "prefix")
    popular = names.groupBy(normalised(F.col("name")).alias("name")).agg(F.max("relevance").alias("popularity"))
    more = found.join(popular, "name").join(completed.select("prefix", normalised(F.col("name")).alias("name")), ["prefix", "name"], "left_anti").join(short, "prefix")
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc(F.round(F.col("coverage") * (1 + F.col("popularity")), 6)), F.length("name"), "name"))
    filled = more.withColumn("rank", (F.col("n") + place).cast("long")).filter(F.col("rank") <= most).select("prefix", "name", "rank")
    return completed.unionByName(filled)


def topics(links: DataFrame, weight: float = 100.0) -> DataFrame:
    """(id, topic, weight): each linked entity adds `weight` to its topic."""
    return links.groupBy("id", "topic").agg((F.count("*") * weight).alias("weight"))


def top_topics(weighted: DataFrame) -> DataFrame:
    """Topics tied at the largest weight."""
    r = F.rank().over(Window.partitionBy("id").orderBy(F.desc("weight")))
    return weighted.withColumn("r", r).filter("r = 1").drop("r")


def segregated(entities: DataFrame) -> DataFrame:
    """(key, cls, ids): entities regrouped into one sorted list per class."""
    return entities.groupBy("key", "cls").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


def near(points: DataFrame, lon: float, lat: float, degrees: float) -> DataFrame:
    """Points closer than so many degrees in the plane, x wrapping around; a box test first, then the distance."""
    dx = F.abs(F.col("lon") - lon)
    dx = F.least(dx, 360 - dx)
    dy = F.abs(F.col("lat") - lat)
    return points.filter((dy < degrees) & (dx < degrees)).withColumn("dist", F.round(F.sqrt(dx * dx + dy * dy), 6)).filter(F.col("dist") < degrees)


def geo_filter(entities: DataFrame, points: DataFrame, lon: float, lat: float, degrees: float, subs: list[int] | None = None) -> DataFrame:
    """Entities (.., sub, id, ..) but for those with coordinates farther away; without coordinates, or of other
    subclasses than `subs` names, they stay."""
    inside = near(points, lon, lat, degrees).select("id", F.lit(True).alias("inside"))
    known = points.select("id", F.lit(True).alias("known")).distinct()
    rated = entities.join(known, "id", "left").join(inside.distinct(), "id", "left")
    concerned = F.lit(True) if subs is None else F.col("sub").isin(subs)
    return rated.filter(~(concerned & F.coalesce("known", F.lit(False)) & ~F.coalesce("inside", F.lit(False)))).select(*entities.columns)


def to_degrees(value: Column, unit: str) -> Column:
    """Kilometres, metres or miles along the equator as degrees."""
    per = {"deg": 1.0, "km": 360 / CIRCUMFERENCE_KM, "m": 0.36 / CIRCUMFERENCE_KM, "mile": 1.609344 * 360 / CIRCUMFERENCE_KM}[unit]
    return value * per


def term_shares(toks: DataFrame) -> DataFrame:
    """(doc_id, tok, tf): share of the document's tokens."""
    counted = toks.groupBy("doc_id", "tok").agg(F.count("*").alias("c"))
    return counted.select("doc_id", "tok", (F.col("c") / F.sum("c").over(Window.partitionBy("doc_id"))).alias("tf"))


def centroids(shares: DataFrame, tags: DataFrame) -> DataFrame:
    """(has, tok, mean, sd, docs): over the documents in which the word occurs."""
    stats = shares.join(tags, "doc_id").groupBy("has", "tok").agg(F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("sd"), F.count("*").alias("docs"))
    return stats


def tagged_centroids(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """As centroids of the shares of documents (doc_id, text).  A document takes its tags (doc_id, has) along, so that
    its words are counted by tag where they are made."""
    held = tags.groupBy("doc_id").agg(F.collect_list(F.struct("has")).alias("tags"))
    shares = D.term_shares(docs.select("doc_id", "text").join(held, "doc_id"), "tags")
    each = shares.select("tok", "tf", F.explode("tags").alias("t")).select(F.col("t.has").alias("has"), "tok", "tf")
    return each.groupBy("has", "tok").agg(F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("sd"), F.count("*").alias("docs"))


FREQUENT_MOST = 100_000  # words of both sides, those of most documents, that are broadcast; the others are joined


def tag_probability(shares: DataFrame, centers: DataFrame) -> DataFrame:
    """(doc_id, p): distance to `no` over the sum of both distances, on words that both sides have.

    A word that the document lacks adds its mean squared to both distances: that part is one sum per side, so only
    the document's own words are joined.
    """
    side = lambda has, c, name: F.max(F.when(F.col("has") == has, F.col(c))).alias(name)
    sides = centers.filter("has IN (0, 1)").groupBy("tok").agg(side(1, "mean", "m1"), side(1, "sd", "s1"), side(1, "docs", "n"), side(0, "mean", "m0"), side(0, "sd", "s0"))
    both = sides.select("*", F.abs(F.col("m1") - F.col("m0")).alias("gap")).filter(F.col("gap") > 1e-4).localCheckpoint()  # read five times
    often = F.broadcast(both.orderBy(F.desc("n"), "tok").limit(FREQUENT_MOST).select("tok"))
    size = both.agg(F.count("*").alias("k"))
    both = both.crossJoin(F.broadcast(size))  # one row
    term = lambda x, m, s: (x - F.col(m)) * (x - F.col(m)) / (1 / F.col("k") + F.col(s))
    zero = F.lit(0.0)
    base = both.agg(F.sum(term(zero, "m1", "s1")).alias("b1"), F.sum(term(zero, "m0", "s0")).alias("b0"))
    # frequent words meet their documents where these are read; only the others are shuffled
    frequent = shares.join(F.broadcast(both.join(often, "tok", "left_semi")), "tok")
    others = shares.join(often, "tok", "left_anti").join(both.join(often, "tok", "left_anti"), "tok")
    own = frequent.unionByName(others).groupBy("doc_id").agg(
        F.sum(term(F.col("tf"), "m1", "s1") - term(zero, "m1", "s1")).alias("d1"), F.sum(term(F.col("tf"), "m0", "s0") - term(zero, "m0", "s0")).alias("d0")
    )
    d1, d0 = (F.sqrt(F.greatest(F.col(f"b{i}") + F.col(f"d{i}"), zero)) for i in (1, 0))
    p = F.when(d1 + d0 > 0, d0 / (d1 + d0)).otherwise(0.5)
    return own.crossJoin(F.broadcast(base)).select("doc_id", F.round(p, 6).alias("p"))  # one row


def topic_filter(hits: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hits (qid, id, ..) whose id links to a wanted topic of every class of topics; all hits of a query that keeps none.

    links: (id, topic); wanted: (cls, topic).  Wanted topics without links are ignored.
    """
    live = wanted.join(links.select("topic").distinct(), "topic", "left_semi").distinct()
    classes = live.agg(F.countDistinct("cls").alias("classes"))
    met = links.join(live, "topic").groupBy("id").agg(F.countDistinct("cls").alias("met")).crossJoin(F.broadcast(classes))  # one row
    good = met.filter("met = classes").select("id", F.lit(True).alias("good"))
    w = Window.partitionBy("qid")
    return hits.join(good, "id", "left").withColumn("any", F.max("good").over(w)).filter("good OR any IS NULL").drop("good", "any")


def query_chunks(docs: DataFrame, queries: DataFrame, width: int, first_only: bool = False) -> DataFrame:
    """As chunks, of the places in documents (doc_id, text) that have a word of queries (item_id, gram, distinct).

    Places are made and chosen inside a document's row: one for each item, document and word does not go through a
    shuffle.  first_only: the densest place only.
    """
    few = queries.select("item_id", "gram").distinct().limit(QUERY_GRAMS_MOST + 1).toArrow()

    def grouped(d: DataFrame) -> DataFrame:
        spots = queries.withColumnRenamed("gram", "tok").join(tokens(d), "tok").select("item_id", "doc_id", "pos").distinct()
        made = chunks(spots, width)
        return made.filter("rank = 1") if first_only else made

    if few.num_rows > QUERY_GRAMS_MOST:
        return grouped(docs)
    sent = docs.sparkSession.sparkContext.broadcast(D.Asked(few.filter(few.column("gram").is_valid())))
    kind = queries.schema["item_id"].dataType.simpleString()
    return D.by_document(docs, lambda d: D.chunks(D.listed(d), sent, width, kind, first_only), grouped)


def chunks(positions: DataFrame, width: int) -> DataFrame:
    """(item_id, doc_id, rank, pos, weight): places to show, densest first, none closer than `width` to a better one.

    positions: (item_id, doc_id, pos) of the query's words in a document.  The weight is the number of hits within half
    a width; the greedy choice folds one document's hits of one query.
    """
    near = Window.partitionBy("item_id", "doc_id").orderBy("pos").rangeBetween(-(width // 2), width // 2)
    rated = positions.withColumn("weight", F.count("*").over(near))
    hits = F.array_sort(F.collect_set(F.struct((-F.col("weight")).alias("w"), F.col("pos").cast("long").alias("pos"))))
    none = F.expr("cast(array() as array<struct<w:bigint,pos:bigint>>)")
    far = lambda acc, x: ~F.exists(acc, lambda y: F.abs(y["pos"] - x["pos"]) < width)
    chosen = F.aggregate("hits", none, lambda acc, x: F.when(far(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    out = rated.groupBy("item_id", "doc_id").agg(hits.alias("hits")).select("item_id", "doc_id", F.posexplode(chosen).alias("rank", "c"))
    return out.select("item_id", "doc_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("c.pos").alias("pos"), (-F.col("c.w")).alias("weight"))
