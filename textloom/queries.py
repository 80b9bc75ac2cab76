"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .operators import documents as D
from .operators import index as I
from .operators import names as N
from .plans.rewriter import rewritten
from .plans.rules import compile_rules, literal_matches, load_rules
from .sources.files import plain_html

QUERIES, ORACLES = {}, {}
NOW = "2024-06-05"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TOK = r"tok AS (SELECT doc_id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|[0-9]+') AS t FROM documents))"
_POST = _TOK + ", post AS (SELECT tok AS gram, doc_id, count(*)::BIGINT AS cnt, min(pos)::BIGINT AS pos FROM tok GROUP BY ALL)"
_DF = _POST + ", dfs AS (SELECT gram, count(*)::BIGINT AS df FROM post GROUP BY gram)"
_Q = r"q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+|[0-9]+')) AS gram FROM benchmark)"
_NUM = "CASE WHEN regexp_matches(gram, '^[0-9]+$') THEN 0.5 ELSE 1.0 END"
_RANK = "SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 16"


@query(f"WITH {_DF}, {_Q}, hits AS (SELECT item_id, doc_id, round(sum({_NUM} / ln(1 + (1.0 + df))), 6) AS score FROM post JOIN dfs USING (gram) JOIN q USING (gram) GROUP BY ALL) {_RANK}")
def search_default(spark, d):
    return I.best_search(_t(spark, d, "documents"), I.query_grams(_t(spark, d, "benchmark")))


@query(f"WITH {_DF}, {_Q}, hits AS (SELECT item_id, doc_id, round(sum((CASE WHEN length(gram) = 1 THEN 0.125 ELSE 1.0 END) * 2.0 * ln(128.0 + cnt) / ln(1 + (1.0 + df)) * {_NUM}), 6) AS score FROM post JOIN dfs USING (gram) JOIN q USING (gram) GROUP BY ALL) {_RANK}")
def search_smart(spark, d):
    return I.best_search(_t(spark, d, "documents"), I.query_grams(_t(spark, d, "benchmark")), smart=True)


@query(f"WITH {_POST} SELECT * FROM post")
def postings(spark, d):
    return I.postings(_t(spark, d, "documents"))


@query(f"WITH {_TOK}, g AS (SELECT doc_id, pos, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM tok) SELECT gram, doc_id, count(*)::BIGINT AS cnt, min(pos)::BIGINT AS pos FROM g WHERE gram IS NOT NULL GROUP BY ALL")
def postings_bigrams(spark, d):
    return I.postings(_t(spark, d, "documents"), 2)


@query(f"WITH {_TOK}, g AS (SELECT doc_id, pos, tok || ' ' || lead(tok) OVER w || ' ' || lead(tok, 2) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT gram, doc_id, count(*)::BIGINT AS cnt, min(pos)::BIGINT AS pos FROM g WHERE gram IS NOT NULL GROUP BY ALL")
def postings_trigrams(spark, d):
    return I.postings(_t(spark, d, "documents"), 3)


@query(f"WITH {_DF} SELECT gram, df FROM dfs")
def document_frequency(spark, d):
    return I.postings(_t(spark, d, "documents")).groupBy("gram").agg(F.count("*").alias("df"))


@query(f"WITH {_POST} SELECT doc_id, gram, cnt AS topcnt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, gram) AS r FROM post) WHERE r = 1")
def top_feature(spark, d):
    return D.top_feature(_t(spark, d, "documents"))


@query(f"WITH {_DF} SELECT doc_id, gram, df FROM post JOIN dfs USING (gram) WHERE df <= 2")
def rare_features(spark, d):
    return I.rare_features(I.postings(_t(spark, d, "documents")), 2)


@query(f"WITH {_DF}, top AS (SELECT doc_id, max(cnt) AS topcnt FROM post GROUP BY doc_id) SELECT gram, round((1 + sum(ln(cnt / topcnt + 1))) / count(*), 6) AS score FROM post JOIN top USING (doc_id) GROUP BY gram ORDER BY score DESC, gram LIMIT 50")
def important_features(spark, d):
    return I.important_features(I.postings(_t(spark, d, "documents")))


@query(f"WITH {_POST} SELECT doc_id FROM post WHERE gram = 'the'")
def documents_of_feature(spark, d):
    return I.postings(_t(spark, d, "documents")).filter("gram = 'the'").select("doc_id")


@query(f"WITH {_TOK} SELECT tok AS gram, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS places FROM tok GROUP BY ALL")
def feature_positions(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",")
    return D.by_document(_t(spark, d, "documents"), D.places, lambda x: X.tokens(x).groupBy(F.col("tok").alias("gram"), "doc_id").agg(listed.alias("places")))


def _tags(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0'")
def tags_all(spark, d):
    return I.tagged_all(_tags(spark, d), ["en", "src0", "unknown"])


@query("SELECT doc_id, 'known' AS asked FROM documents WHERE lang = 'en' AND source = 'src1' UNION ALL SELECT doc_id, 'unknown' FROM documents WHERE lang = 'en' AND source = 'src1' AND source = 'unknown'")
def tags_all_strict(spark, d):
    one = lambda *tags, name: I.tagged_all(_tags(spark, d), list(tags), strict=True).withColumn("asked", F.lit(name))
    return one("en", "src1", name="known").unionByName(one("en", "src1", "unknown", name="unknown"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src1'")
def tags_any(spark, d):
    return I.tagged_any(_tags(spark, d), ["fr", "src1"])


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es') AND n_chars BETWEEN 500 AND 2000")
def property_filters(spark, d):
    docs = _t(spark, d, "documents")
    return docs.filter(I.predicate("in", F.col("lang"), "de", "es") & I.predicate("range", F.col("n_chars"), 500, 2000)).select("doc_id", "lang")


@query("SELECT event_id FROM events WHERE (value > 50 AND NOT event_type = 'click') OR (value > 10 AND value < 11)")
def property_algebra(spark, d):
    p = I.predicate
    return _t(spark, d, "events").filter((p("gt", F.col("value"), 50) & ~p("eq", F.col("event_type"), "click")) | p("inside", F.col("value"), 10, 11)).select("event_id")


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
def list_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.lit(1.0).alias("score"))


@query(f"WITH {_DF}, {_Q}, hits AS (SELECT item_id, doc_id, round(sum({_NUM} / ln(1 + (1.0 + df))), 6) AS score FROM post JOIN dfs USING (gram) JOIN q USING (gram) GROUP BY ALL), best AS ({_RANK}), s AS (SELECT source AS entity, sum(score) AS s FROM best JOIN documents USING (doc_id) GROUP BY source), e AS (SELECT min(s) AS lo, max(s) AS hi FROM s) SELECT entity, round(CASE WHEN hi - lo > 1e-8 THEN (s - lo) / (hi - lo) ELSE s END, 6) AS score FROM s, e")
def document_entities(spark, d):
    docs = _t(spark, d, "documents")
    hits = I.best_search(docs, I.query_grams(_t(spark, d, "benchmark")))
    return I.entity_scores(hits, docs.select("doc_id", F.col("source").alias("entity")))


@query(r"SELECT doc_id, round(2 / (1 + sqrt(length(regexp_extract(text, '^[^\n]*')))), 6) AS adjust FROM documents")
def title_adjustment(spark, d):
    title = F.substring_index("text", "\n", 1)
    return _t(spark, d, "documents").select("doc_id", F.round(2 / (1 + F.sqrt(F.length(title))), 6).alias("adjust"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def html_text(spark, d):
    return _t(spark, d, "pages").select("page_id", plain_html(F.col("html")).alias("plain"))


@query(f"WITH {_TOK} SELECT doc_id, pos::BIGINT AS pos, tok FROM tok")
def tokens_default(spark, d):
    return X.tokens(_t(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "tok")


@query(f"WITH {_TOK} SELECT DISTINCT tok, CASE WHEN regexp_matches(tok, '^[0-9]+$') AND length(tok) <= 10 AND NOT (length(tok) = 10 AND tok[1] >= '3') AND NOT (tok[1] = '0' AND length(tok) >= 3) THEN 'int' ELSE 'word' END AS cls FROM tok")
def number_classes(spark, d):
    return X.tokens(_t(spark, d, "documents")).select("tok").distinct().select("tok", X.number_class(F.col("tok")).alias("cls"))


@query(f"WITH {_TOK}, w AS (SELECT DISTINCT tok FROM tok) SELECT tok, list_aggregate(list_transform(list_filter(range(1, length(tok) + 1), lambda i: i = 1 OR tok[i] <> tok[i - 1]), lambda i: tok[i]), 'string_agg', '') AS one FROM w")
def collapsed_repeats(spark, d):
    return X.tokens(_t(spark, d, "documents")).select("tok").distinct().select("tok", X.collapsed(F.col("tok")).alias("one"))


_VOC = _TOK + ", voc AS (SELECT tok, count(*)::BIGINT AS freq FROM tok WHERE regexp_matches(tok, '^[a-z]{4,}$') GROUP BY tok), v AS (SELECT * FROM voc WHERE freq >= 2), u AS (SELECT tok FROM voc WHERE freq = 1)"


def _words(spark, d):
    t = X.tokens(_t(spark, d, "documents"))
    all_ = t.filter(F.col("tok").rlike("^[a-z]{4,}$")).groupBy("tok").agg(F.count("*").alias("freq"))
    return all_.filter("freq = 1").select("tok"), all_.filter("freq >= 2")


@query(f"WITH {_VOC}, o AS (SELECT tok, tok AS k FROM u UNION SELECT tok, tok[:i-1] || tok[i+1:] FROM u, (SELECT unnest(range(1, 41)) AS i) WHERE i <= length(tok)), p AS (SELECT tok, freq, tok AS k FROM v UNION SELECT tok, freq, tok[:i-1] || tok[i+1:] FROM v, (SELECT unnest(range(1, 41)) AS i) WHERE i <= length(tok)), c AS (SELECT DISTINCT o.tok AS word, p.tok AS c, freq FROM o JOIN p USING (k) WHERE levenshtein(o.tok, p.tok) = 1) SELECT word, c AS correction FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY freq DESC, c) AS r FROM c) WHERE r = 1")
def spell_corrections(spark, d):
    return X.corrections(*_words(spark, d))


@query(f"WITH {_VOC}, s AS (SELECT tok AS word, i, tok[:i] AS l, tok[i+1:] AS r FROM u, (SELECT unnest(range(4, 80)) AS i) WHERE i <= greatest(length(tok) - 4, 4)) SELECT word, l AS left_part, r AS right_part FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY i) AS k FROM s WHERE l IN (SELECT tok FROM v) AND r IN (SELECT tok FROM v)) WHERE k = 1")
def split_corrections(spark, d):
    return X.splits(*_words(spark, d))


@query(f"WITH {_TOK}, w AS (SELECT doc_id, lang, tok FROM tok JOIN documents USING (doc_id)), g AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(range(1, length(tok) + 1), lambda i: (' ' || tok || ' ')[i:i+2]))) AS g FROM w), pd AS (SELECT doc_id, lang, g, count(*) AS c FROM g GROUP BY ALL), m AS (SELECT lang, g, sum(c) AS n FROM pd GROUP BY ALL), t AS (SELECT lang, sum(n) AS t FROM m GROUP BY lang), s AS (SELECT pd.doc_id, m.lang, round(sum(c * (n / t)), 6) AS s FROM pd JOIN m USING (g) JOIN t ON t.lang = m.lang GROUP BY ALL) SELECT doc_id, lang AS guess FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang DESC) AS r FROM s) WHERE r = 1")
def language_guess(spark, d):
    return X.language_guess(_t(spark, d, "documents"))


_NORM = "trim(regexp_replace(' ' || regexp_replace(regexp_replace(regexp_replace(lower({0}), '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g') || ' ', ' and ', ' ', 'g'))"
_GRAMS = "unnest(list_distinct(list_transform(range(1, length({0}) + 1), lambda i: (' ' || {0} || ' ')[i:i+2])))"
_NAMES = (
    "nm AS (SELECT DISTINCT " + _NORM.format("p_name") + " AS name FROM part), ng AS (SELECT name, " + _GRAMS.format("name") + " AS gram FROM nm), nd AS (SELECT gram, count(*) AS df FROM ng GROUP BY gram), "
    "qs AS (SELECT DISTINCT p_brand || ' ' || split_part(p_name, ' ', 1) AS qid, " + _NORM.format("split_part(p_name, ' ', 1)") + " AS q FROM part), qg AS (SELECT qid, " + _GRAMS.format("q") + " AS gram FROM qs), "
    "qn AS (SELECT qid, count(*) AS nq FROM qg GROUP BY qid), h AS (SELECT qid, name, count(*)::BIGINT AS shared, round(sum(1.0 / (df * df)), 6) AS relevance, round(count(*) / any_value(nq), 6) AS coverage FROM qg JOIN qn USING (qid) JOIN ng USING (gram) JOIN nd USING (gram) GROUP BY ALL), "
    "k AS (SELECT * FROM (SELECT *, max(coverage) OVER (PARTITION BY qid) AS best FROM h WHERE coverage >= 0.3) WHERE best - coverage <= 0.1 + 1e-9)"
)


def _name_hits(spark, d):
    part = _t(spark, d, "part")
    first = F.substring_index("p_name", " ", 1)
    asked = part.select(F.concat("p_brand", F.lit(" "), first).alias("qid"), first.alias("q")).distinct()
    return N.match_names(part.select(F.col("p_name").alias("name")), asked)


@query(f"WITH {_NAMES} SELECT qid, name, shared, relevance, coverage FROM k")
def name_matches(spark, d):
    return _name_hits(spark, d)


@query(f"WITH {_NAMES}, pop AS (SELECT {_NORM.format('p_name')} AS name, max(p_size) / 50.0 AS pop FROM part GROUP BY 1), r AS (SELECT qid, name, round(coverage * (1 + pop), 6) AS score FROM k JOIN pop USING (name)), x AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS lead FROM r WINDOW w AS (PARTITION BY qid ORDER BY score DESC, length(name), name)) SELECT qid, name, score, rank FROM x WHERE lead - score <= 0.15 AND rank <= 64")
def name_search(spark, d):
    pop = _t(spark, d, "part").groupBy(N.normalised(F.col("p_name")).alias("name")).agg((F.max("p_size") / 50.0).alias("pop"))
    return N.ranked_names(_name_hits(spark, d), pop)


@query("WITH p AS (SELECT DISTINCT left(lower(p_name), 4) AS prefix FROM part), n AS (SELECT lower(p_name) AS name, max(p_size) AS relevance FROM part GROUP BY 1), b AS (SELECT prefix, name, length(name) - relevance AS w FROM p JOIN n ON starts_with(name, prefix)) SELECT prefix, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY w, name) AS rank FROM b) WHERE rank <= 10")
def autocomplete(spark, d):
    part = _t(spark, d, "part")
    names = part.groupBy(F.lower("p_name").alias("name")).agg(F.max("p_size").alias("relevance"))
    return N.autocomplete(names, part.select(F.substring(F.lower("p_name"), 1, 4).alias("prefix")).distinct())


_LINKS = "l AS (SELECT o_custkey AS id, p_type AS topic FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), w AS (SELECT id, topic, count(*) * 100.0::DOUBLE AS weight FROM l GROUP BY ALL)"


def _topic_weights(spark, d):
    links = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return N.topics(links.select(F.col("o_custkey").alias("id"), F.col("p_type").alias("topic")))


@query(f"WITH {_LINKS} SELECT id, topic, weight FROM w")
def topic_extraction(spark, d):
    return _topic_weights(spark, d)


@query(f"WITH {_LINKS} SELECT id, topic, weight FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY weight DESC) AS r FROM w) WHERE r = 1")
def top_topics(spark, d):
    return N.top_topics(_topic_weights(spark, d))


@query(f"WITH {_LINKS} SELECT id FROM w WHERE topic = (SELECT min(p_type) FROM part) AND weight >= 500")
def grammar_gate(spark, d):
    first = _t(spark, d, "part").agg(F.min("p_type").alias("topic"))
    return _topic_weights(spark, d).join(F.broadcast(first), "topic").filter("weight >= 500").select("id")


@query("SELECT p_brand AS key, p_type AS cls, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS ids FROM part GROUP BY ALL")
def entity_segregation(spark, d):
    return N.segregated(_t(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("cls"), F.col("p_name").alias("id")))


@query("SELECT p_type AS cls, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def entity_counts(spark, d):
    return _t(spark, d, "part").groupBy(F.col("p_type").alias("cls")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 0, p_size DESC, p_partkey) AS place FROM part")
def relevance_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.col("p_size") == 0, F.desc("p_size"), "p_partkey")
    return _t(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place"))


_POINTS = "g AS (SELECT c_custkey AS id, ((c_custkey * 37) % 360)::DOUBLE AS lon, ((c_custkey * 17) % 180)::DOUBLE AS lat FROM customer)"


def _points(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(k.alias("id"), ((k * 37) % 360).cast("double").alias("lon"), ((k * 17) % 180).cast("double").alias("lat"))


@query(f"WITH {_POINTS}, x AS (SELECT id, least(abs(lon - 350), 360 - abs(lon - 350)) AS dx, abs(lat - 90) AS dy FROM g) SELECT id, round(sqrt(dx * dx + dy * dy), 6) AS dist FROM x WHERE round(sqrt(dx * dx + dy * dy), 6) < 20")
def entities_near(spark, d):
    return N.near(_points(spark, d), 350.0, 90.0, 20.0).select("id", "dist")


@query("SELECT o_orderkey, round(o_totalprice * 360 / 40000.0, 6) AS km, round(o_totalprice * 1.609344 * 360 / 40000.0, 6) AS mile FROM orders")
def unit_conversion(spark, d):
    p = F.col("o_totalprice")
    return _t(spark, d, "orders").select("o_orderkey", F.round(N.to_degrees(p, "km"), 6).alias("km"), F.round(N.to_degrees(p, "mile"), 6).alias("mile"))


_TF = _TOK + ", tn AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), tf AS (SELECT doc_id, tok, count(*) / any_value(n) AS tf FROM tok JOIN tn USING (doc_id) GROUP BY ALL)"
_CEN = _TF + ", cen AS (SELECT quality AS has, tok, avg(tf) AS mean, stddev_pop(tf) AS sd, count(*)::BIGINT AS docs FROM tf JOIN labels USING (doc_id) GROUP BY ALL)"


def _classifier(spark, d):
    docs = _t(spark, d, "documents")
    return D.term_shares(docs), N.tagged_centroids(docs, _t(spark, d, "labels").select("doc_id", F.col("quality").alias("has")))


@query(f"WITH {_CEN} SELECT has, tok, round(mean, 6) AS mean, round(sd, 6) AS sd, docs FROM cen")
def tag_centroids(spark, d):
    return _classifier(spark, d)[1].select("has", "tok", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "docs")


@query()
def tag_probability(spark, d):
    return N.tag_probability(*_classifier(spark, d))


@query("SELECT l_orderkey, l_linenumber, least(l_quantity, l_discount * 100) AS lo, greatest(l_quantity, l_discount * 100) AS hi, round(l_quantity * 0.8, 6) AS fuzz_lo, round(l_quantity * 1.2, 6) AS fuzz_hi, abs(l_discount - l_tax) < 1e-13 AS empty FROM lineitem")
def range_functions(spark, d):
    q, x = F.col("l_quantity"), F.col("l_discount") * 100
    r, (lo, hi) = V.mk_range(q, x), V.range_fuzz(q, q)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r["lo"].alias("lo"), r["hi"].alias("hi"), F.round(lo, 6).alias("fuzz_lo"), F.round(hi, 6).alias("fuzz_hi"), V.is_range_empty(F.col("l_discount"), F.col("l_tax")).alias("empty"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_quantity - l_tax AS minus, l_quantity * l_tax AS mult, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS div, l_discount < l_tax AS lt, NOT l_discount < l_tax AS gt, l_discount = l_tax AS eq FROM lineitem")
def arithmetic_functions(spark, d):
    q, t, x = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q + t).alias("plus"), (q - t).alias("minus"), (q * t).alias("mult"), V.op_div(q, x).alias("div"), (x < t).alias("lt"), (~(x < t)).alias("gt"), (x == t).alias("eq"))


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS x, (o_orderkey % 45)::INT AS n, (o_orderkey % 20)::INT AS m FROM orders), y AS (SELECT *, (year(x) * 12 + month(x) - 1 + m) AS mm FROM o) SELECT o_orderkey, (make_date(mm // 12, mm % 12 + 1, 1) + (day(x) + n - 1)::INT)::DATE AS calc, isodow(x)::INT AS wday, (date_trunc('week', x)::DATE + 7)::DATE AS week_lo, (date_trunc('week', x)::DATE + 13)::DATE AS week_hi, (date_trunc('month', x) + INTERVAL 1 MONTH)::DATE AS month_lo, last_day((date_trunc('month', x) + INTERVAL 1 MONTH)::DATE) AS month_hi, make_date(year(x) + (6 <= month(x))::INT, 6, 1) AS june FROM y")
def date_functions(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("x"), (F.col("o_orderkey") % 45).cast("int").alias("n"), (F.col("o_orderkey") % 20).cast("int").alias("m"))
    x, (wl, wh), (ml, mh) = F.col("x"), V.mk_week_range(F.lit(1), F.col("x")), V.mk_month_range(F.lit(1), F.col("x"))
    return o.select("o_orderkey", V.date_calc(x, F.col("n"), F.col("m")).alias("calc"), V.weekday(x).alias("wday"), wl.alias("week_lo"), wh.alias("week_hi"), ml.alias("month_lo"), mh.alias("month_hi"), V.mk_month(F.lit(1), F.lit(6), x).alias("june"))


@query("SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 7200 + 300 AS t FROM events")
def time_functions(spark, d):
    ts = F.col("ts")
    return _t(spark, d, "events").select("event_id", V.time_calc(V.mk_time(F.hour(ts), F.minute(ts), F.second(ts)), F.lit(2), F.lit(5), F.lit(0)).cast("long").alias("t"))


@query("WITH l AS (SELECT conv_id, turn, text, role FROM conversations) SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS left_value FROM l")
def left_bead(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.when(F.col("role") == "user", F.length("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.last(mine, ignorenulls=True).over(w).cast("long").alias("left_value"))


@query(r"""WITH r AS (SELECT item_id AS rule_id, list_aggregate(regexp_extract_all(lower(text), '\p{L}+|[0-9]+')[1:3], 'string_agg', ' ') AS gram FROM benchmark), """ + _TOK + """, g AS (SELECT doc_id, pos, tok || ' ' || lead(tok) OVER w || ' ' || lead(tok, 2) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, rule_id, pos, score FROM (SELECT doc_id, rule_id, pos::BIGINT AS pos, 1200::BIGINT AS score, row_number() OVER (PARTITION BY doc_id ORDER BY pos, rule_id) AS k FROM g JOIN r USING (gram)) WHERE k = 1""")
def literal_rules(spark, d):
    items = _t(spark, d, "benchmark")
    rules = items.select(F.col("item_id").alias("rule_id"), F.array_join(F.slice(X.token_array(F.col("text")), 1, 3), " ").alias("gram"), F.lit(3).alias("size"))
    return literal_matches(_t(spark, d, "documents"), rules)


RULES = """<stmset>
<stmt n="1"><pat><t>the</t><opt><t>old</t></opt><n/></pat><tran><func n="opPlus"><var w="1"/><rn>1</rn></func></tran></stmt>
<stmt n="2"><pat><n/><any><t>to</t><p>-</p></any><n/></pat><tran><func n="mkRange"><var w="1"/><var w="2"/></func></tran></stmt>
<stmt n="3"><pat><any><t>and</t><t>of</t></any><t>the</t></pat><tran><mkent c="1" s="2" i="link"/></tran></stmt>
</stmset>"""


@query()
def rule_rewriting(spark, d):
    return rewritten(_t(spark, d, "benchmark"), compile_rules(load_rules(RULES)), "item_id")


@query()
def json_answers(spark, d):
    hits = I.best_search(_t(spark, d, "documents"), I.query_grams(_t(spark, d, "benchmark")))
    return hits.groupBy("item_id").agg(F.to_json(F.struct(F.col("item_id").alias("qid"), F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("docs"))).alias("answer"))


@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([^\s.]{4})\. ', '\1' || chr(10), 'g'), '[\n\r\t"'';:|()«»–]|  +')) AS p FROM documents) SELECT doc_id, trim(p) AS phrase FROM p WHERE trim(p) <> ''""")
def phrase_breaks(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(X.phrases(F.col("text"))).alias("phrase"))


@query(f"WITH {_TF} SELECT doc_id, tok, round(tf, 9) AS tf FROM tf")
def term_shares(spark, d):
    return D.term_shares(_t(spark, d, "documents")).withColumn("tf", F.round("tf", 9))


@query(f"SELECT doc_id, translate(lower(text), '{X.MARKED}', '{X.UNMARKED}') AS plain FROM documents")
def unmarked_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.unmarked(F.col("text")).alias("plain"))


@query(f"SELECT p_partkey, translate(lower(p_name), '{X.LATIN_KEYS.replace(chr(39), chr(39) * 2)}', '{X.RUSSIAN_KEYS}') AS typed FROM part")
def keyboard_layout(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.other_keyboard(F.col("p_name")).alias("typed"))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|[0-9]+') AS t FROM documents) SELECT doc_id, list_aggregate(t[1:20], 'string_agg', ' ') AS head, len(t) > 20 AS cut FROM t")
def truncated_tokens(spark, d):
    head, cut = X.truncated(F.col("text"), 20)
    return _t(spark, d, "documents").select("doc_id", F.when(F.size(head) > 0, F.array_join(head, " ")).alias("head"), cut.alias("cut"))  # as in SQL, no tokens join to null


@query(f"WITH {_VOC} SELECT tok.doc_id, count(v.tok)::BIGINT AS known, count(*) - count(v.tok) AS unknown FROM tok LEFT JOIN v USING (tok) GROUP BY tok.doc_id")
def known_words(spark, d):
    t, vocab = X.tokens(_t(spark, d, "documents")), _words(spark, d)[1]
    both = t.join(vocab, "tok", "left")
    return both.groupBy("doc_id").agg(F.count("freq").alias("known"), (F.count("*") - F.count("freq")).alias("unknown"))


@query(f"WITH {_VOC}, c AS (SELECT u.tok AS word, u.tok[:i] AS stem, i FROM u, (SELECT unnest(range(3, 80)) AS i) WHERE i < length(u.tok)) SELECT word, arg_max(stem, i) AS stem FROM c WHERE stem IN (SELECT tok FROM v) GROUP BY word")
def chopped_stems(spark, d):
    return X.chopped(*_words(spark, d))


@query(f"WITH {_VOC} SELECT DISTINCT tok, tok[:i-1] || tok[i+1:] AS variant FROM v, (SELECT unnest(range(1, 80)) AS i) WHERE i <= length(tok)")
def omission_variants(spark, d):
    return _words(spark, d)[1].select("tok", F.explode(X.deletions(F.col("tok"))).alias("variant"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_size > 10")
def entities_of_class(spark, d):
    part = _t(spark, d, "part")
    first = part.agg(F.min("p_type").alias("p_type"))
    return part.join(F.broadcast(first), "p_type").filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))  # one row


@query("WITH l AS (SELECT DISTINCT o_custkey AS id, p_brand AS topic FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), live AS (SELECT DISTINCT w.cls, w.topic FROM (SELECT DISTINCT p_size % 2 AS cls, p_brand AS topic FROM part WHERE p_retailprice < 920) w JOIN l USING (topic)), good AS (SELECT id FROM l JOIN live USING (topic) GROUP BY id HAVING count(DISTINCT cls) = (SELECT count(DISTINCT cls) FROM live)), h AS (SELECT c_nationkey AS qid, c_custkey AS id FROM customer) SELECT qid, id FROM h WHERE id IN (SELECT id FROM good) OR qid NOT IN (SELECT qid FROM h WHERE id IN (SELECT id FROM good))")
def topic_filtered(spark, d):
    part = _t(spark, d, "part")
    links = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    wanted = part.filter("p_retailprice < 920").select((F.col("p_size") % 2).alias("cls"), F.col("p_brand").alias("topic"))
    hits = _t(spark, d, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("id"))
    return N.topic_filter(hits, links.select(F.col("o_custkey").alias("id"), F.col("p_brand").alias("topic")).distinct(), wanted)


@query(f"WITH {_LINKS} SELECT id, sum(weight)::DOUBLE AS weight FROM w WHERE topic IN (SELECT DISTINCT p_type FROM part WHERE p_size > 40) GROUP BY id HAVING sum(weight) > 500")
def has_topics(spark, d):
    wanted = _t(spark, d, "part").filter("p_size > 40").select(F.col("p_type").alias("topic")).distinct()
    return _topic_weights(spark, d).join(wanted, "topic", "left_semi").groupBy("id").agg(F.sum("weight").alias("weight")).filter("weight > 500")


_SPOTS = _TOK + r", q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+|[0-9]+')) AS tok FROM benchmark), s AS (SELECT DISTINCT item_id, doc_id, pos FROM tok JOIN q USING (tok)), r AS (SELECT *, count(*) OVER (PARTITION BY item_id, doc_id ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS weight FROM s)"


def _chunks(spark, d, first_only=False):
    return N.query_chunks(_t(spark, d, "documents"), I.query_grams(_t(spark, d, "benchmark")), 20, first_only)


@query(f"WITH {_SPOTS} SELECT item_id, doc_id, pos::BIGINT AS pos, weight::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY weight DESC, pos) AS k FROM r) WHERE k = 1")
def best_chunk(spark, d):
    return _chunks(spark, d, first_only=True).drop("rank")


@query()
def chunk_ranks(spark, d):
    """All places of all items; best_chunk compares the first places with SQL."""
    return _chunks(spark, d)


@query("WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS x, (o_orderkey % 7 + 1)::INT AS wd FROM orders), a AS (SELECT *, ((wd - isodow(x)) % 7 + 7) % 7 AS ahead FROM o) SELECT o_orderkey, (x + (CASE WHEN ahead = 0 THEN 7 ELSE ahead END)::INT)::DATE AS next_day, (x - (CASE WHEN ahead = 0 THEN 7 ELSE 7 - ahead END)::INT)::DATE AS last_day, (x + (wd - isodow(x))::INT)::DATE AS this_day FROM a")
def weekday_dates(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("x"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("wd"))
    day = lambda f: V.mk_wday(F.lit(f), F.col("wd"), F.col("x"))
    return o.select("o_orderkey", day(1).alias("next_day"), day(-1).alias("last_day"), day(0).alias("this_day"))


from . import queries_more  # noqa: E402, F401  registers more
