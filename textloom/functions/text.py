"""Lexing, stemming and spelling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"\p{L}+|[0-9]+"
#: Relative weight of a feature by its class.
CLASS_BOOST = {"stem": 0.5, "syngroup": 0.5, "number": 0.5, "token": 1.0, "datetime": 1.2, "entity": 2.0}


def token_array(text: Column) -> Column:
    """Default tokenizer: maximal runs of letters or of digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, tok): one row per token."""
    return docs.select(key, F.posexplode(token_array(F.col(text))).alias("pos", "tok"))


#: All of a text: runs of ASCII letters, of digits, of other letters; each mark; each run of white space as one blank.
PIECES = r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]|\s+"

ONE_PIECE = r"\A([A-Za-z]+|[0-9]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~])\z"  # a word that is one of PIECES


def pieces(text: Column) -> Column:
    """All tokens of a text, marks and blanks included, in its own case."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda t: F.regexp_replace(t, r"^\s+$", " "))


def document_tokens(text: Column, spaces: bool = False) -> Column:
    """Tokens of document texts: runs without white space and ASCII marks, the marks, and blanks if asked for."""
    return F.regexp_extract_all(text, F.lit(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]" + (r"|\s" if spaces else "")), F.lit(0))


def space_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, off, tok): words between white space, with the offset of their first character."""
    from ..operators import documents

    return documents.by_document(docs, lambda d: documents.space_tokens(d, key), lambda d: _windowed_space_tokens(d, key), key)


def _windowed_space_tokens(docs: DataFrame, key: str) -> DataFrame:
    """space_tokens of keys with several rows."""
    parts = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"\s+|\S+"), F.lit(0))).alias("k", "tok"))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("off", F.coalesce(F.sum(F.length("tok")).over(before), F.lit(0)))
    words = placed.filter(~F.col("tok").rlike(r"^\s"))
    return words.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("k")) - 1).cast("long").alias("pos"), F.col("off").cast("long").alias("off"), "tok")


def retokenised(words: DataFrame, vocab: DataFrame, key: str = "doc_id", shape: str | None = None) -> DataFrame:
    """(key, pos, sub, off, tok): space tokens that are no known word cut by the default tokenizer, others whole.

    words: as of space_tokens; vocab: (tok), of which all match `shape` if that is given.  Only words that the
    tokenizer would cut, and that can be known by the shape, are looked up.
    """
    from ..operators import documents

    known = vocab.select(F.col("tok").alias("low"), F.lit(True).alias("known"))
    one = F.col("tok").rlike(ONE_PIECE)
    cut = words.withColumn("low", F.lower("tok")).withColumn("ps", F.when(one, F.array("tok")).otherwise(pieces(F.col("tok"))))
    asked = ~one if shape is None else ~one & F.col("low").rlike(shape)
    looked = cut.filter(asked).join(known, "low", "left").withColumn("ps", F.when(F.col("known"), F.array("tok")).otherwise(F.col("ps")))
    columns = [key, "ps", "pos", "off"]
    return documents.placed_pieces(cut.filter(~asked).select(*columns).unionByName(looked.select(*columns)), key)


def grouped_number(text: Column) -> Column:
    """A number in groups of three digits (comma, blank or quote between) with an optional fraction; null for others."""
    shape = r"^[0-9]{1,3}([, '][0-9]{3})+(\.[0-9]+)?$"
    return F.when(text.rlike(shape), F.regexp_replace(text, "[, ']", "").cast("double")).when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.cast("double"))


def number_class(tok: Column) -> Column:
    """int, real or word: at most 10 digits (10 only below 3e9), a leading zero only in one or two digits."""
    is_int = tok.rlike("^[0-9]+$") & (F.length(tok) <= 10) & ~((F.length(tok) == 10) & (F.substring(tok, 1, 1) >= "3")) & ~(tok.startswith("0") & (F.length(tok) >= 3))
    return F.when(is_int, "int").when(tok.rlike(r"^([0-9]+\.[0-9]*|[0-9]*\.[0-9]+)$"), "real").otherwise("word")


def plain_punctuation(text: Column) -> Column:
    """Unicode quotes and dashes as ASCII."""
    return F.translate(text, "‘’“”–—", "''\"\"--")


def collapsed(w: Column) -> Column:
    """Adjacent repeats of a character as one."""
    return F.regexp_replace(w, r"(?s)(.)\1+", "$1")  # reads w once: as an array, w was made anew for each of its characters


def deletions(w: Column) -> Column:
    """All strings with one character left out, distinct."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))


def trigrams(s: Column) -> Column:
    """Distinct character trigrams with one blank at either side."""
    p = F.concat(F.lit(" "), s, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substr(p, i, F.lit(3))))


def vocabulary(toks: DataFrame) -> DataFrame:
    """(tok, freq) of ASCII words of four letters or more that occur at least twice."""
    return toks.filter(F.col("tok").rlike("^[a-z]{4,}$")).groupBy("tok").agg(F.count("*").alias("freq")).filter("freq >= 2")


def corrections(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, correction): known words at distance 1, by shared one-character omissions; most frequent, then least.

    The omission table is an equi-join key, so no pair of words is compared that shares none.
    """
    left = unknown.select(F.col("tok").alias("word"), F.explode(F.array_union(deletions(F.col("tok")), F.array("tok"))).alias("v"))
    right = vocab.select("tok", "freq", F.explode(F.array_union(deletions(F.col("tok")), F.array("tok"))).alias("v"))
    near = left.join(right, "v").filter((F.levenshtein("word", "tok") == 1)).select("word", "tok", "freq").distinct()
    return near.groupBy("word").agg(F.min(F.struct((-F.col("freq")).alias("f"), "tok")).alias("b")).select("word", F.col("b.tok").alias("correction"))


def splits(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, left_part, right_part): the first place where both parts are known words."""
    at = unknown.select(F.col("tok").alias("word"), F.explode(F.sequence(F.lit(4), F.greatest(F.length("tok") - 4, F.lit(4)))).alias("i"))
    at = at.select("word", "i", F.substr("word", F.lit(1), F.col("i")).alias("left_part"), F.substr("word", F.col("i") + 1).alias("right_part"))
    known = vocab.select("tok")
    both = at.join(known.withColumnRenamed("tok", "left_part"), "left_part").join(known.withColumnRenamed("tok", "right_part"), "right_part")
    return both.groupBy("word").agg(F.min(F.struct("i", "left_part", "right_part")).alias("b")).select("word", "b.left_part", "b.right_part")


MODEL_MOST = 200_000  # trigrams of a language model that go to every task; a larger model is joined


def language_model(docs: DataFrame) -> DataFrame:
    """(g, shares): for each trigram its share of all trigrams of a language, an entry by language.  docs: (lang, text)."""
    words = docs.select("lang", F.explode(token_array(F.col("text"))).alias("tok")).groupBy("lang", "tok").agg(F.count("*").alias("c"))
    counted = words.select("lang", "c", F.explode(trigrams(F.col("tok"))).alias("g")).groupBy("lang", "g").agg(F.sum("c").alias("n"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("t"))
    share = counted.join(F.broadcast(total), "lang")  # one row a language
    return share.groupBy("g").agg(F.collect_list(F.struct("lang", (F.col("n") / F.col("t")).alias("p"))).alias("shares"))


def language_guess(docs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(doc_id, guess): argmax over languages of the summed trigram shares in the corpus of that language.

    model: as of language_model; by default that of the documents themselves.
    """
    model = language_model(docs) if model is None else model
    few = model.limit(MODEL_MOST + 1).toArrow()
    if few.num_rows <= MODEL_MOST:
        from ..operators.documents import language_scores

        return language_scores(docs, few)
    words = tokens(docs).groupBy("doc_id", "tok").agg(F.count("*").alias("c"))
    grams = words.select("doc_id", "c", F.explode(trigrams(F.col("tok"))).alias("g")).join(model, "g")
    each = grams.select("doc_id", "c", F.explode("shares").alias("s"))
    scored = each.groupBy("doc_id", "s.lang").agg(F.round(F.sum(F.col("c") * F.col("s.p")), 6).alias("s"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("s", "lang")).alias("b"))
    return best.select("doc_id", F.col("b.lang").alias("guess"))


BREAKS = "[\\n\\r\\t\"';:|()«»–]|  +"


def phrases(text: Column) -> Column:
    """Phrases of a text: cut at line ends, quotes, brackets, colons, bars, double blanks, and after a dot that ends a
    word of four characters or more (shorter ones are taken for abbreviations); no empty phrases."""
    cut = F.split(F.regexp_replace(text, r"([^\s.]{4})\. ", "$1\n"), BREAKS)
    return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")


#: Latin letters with marks and without.
MARKED, UNMARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Keys of the Latin and of the Russian keyboard.
LATIN_KEYS, RUSSIAN_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,.", "йцукенгшщзхъфывапролджэячсмитьбю"


def unmarked(text: Column) -> Column:
    """Lower case without diacritic marks."""
    return F.translate(F.lower(text), MARKED, UNMARKED)


def other_keyboard(text: Column, to_russian: bool = True) -> Column:
    """What the same keys give on the other layout."""
    a, b = (LATIN_KEYS, RUSSIAN_KEYS) if to_russian else (RUSSIAN_KEYS, LATIN_KEYS)
    return F.translate(F.lower(text), a, b)


def truncated(text: Column, most: int) -> tuple[Column, Column]:
    """(the first tokens, whether there were more)."""
    t = token_array(text)
    return F.slice(t, 1, most), F.size(t) > most


def chopped(unknown: DataFrame, vocab: DataFrame, least: int = 3) -> DataFrame:
    """(word, stem): the longest known proper prefix of at least `least` characters."""
    at = unknown.filter(F.length("tok") > least).select(F.col("tok").alias("word"), F.explode(F.sequence(F.lit(least), F.length("tok") - 1)).alias("i"))
    hits = at.withColumn("stem", F.substr("word", F.lit(1), F.col("i"))).join(vocab.select(F.col("tok").alias("stem")), "stem")
    return hits.groupBy("word").agg(F.max_by("stem", "i").alias("stem"))
