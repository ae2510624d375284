"""Spelling errors by the crawl's own words: a lexicon, and rare words that are one slip away from it.

Words that stand on many pages of a language are its lexicon. A word that stands on hardly any is
an error if one slip (a letter too many, too few, another one, or two neighbours changed places)
makes it a word of the lexicon. Both kinds of words are written with each of their letters left
out; words that are one slip apart share such a form, so they meet by hash, and the slip itself is
verified. The words to suggest are those on most pages.

Counting words is a partial aggregate where the texts lie. The errors, few among all words, are
looked for in the texts through a filter (``membership``), so that the texts' words pass no
exchange; only words that can be errors do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.membership import among, bitmaps
from auditlake.storage import materialize

#: Pages from which a word is of the lexicon, up to which it is rare, and letters that an error has at least.
KNOWN, RARE, LETTERS = 10, 2, 5
SUGGESTIONS, CONTEXT, EXCERPT = 5, 20, 200
RULE_ID, MESSAGE, SHORT = "LEXICON_SLIP", "The word is rare and one slip away from a frequent one", "Spelling"
_PIECES = r"(\p{L}+|[^\p{L}]+)"


def _words(texts: DataFrame) -> DataFrame:
    """(language, word, page): each word of a page once, in lower case."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("main_text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    return texts.select("language", F.explode(words).alias("word"))


def _forms(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word,
        i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def _one_slip(a: Column, b: Column) -> Column:
    """Whether two different words are one slip apart."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1,
        F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) == 1) | (F.length(a) == F.length(b)) & swapped


def errors(texts: DataFrame, known: int = KNOWN, rare: int = RARE, letters: int = LETTERS) -> DataFrame:
    """(language, word, suggestions) of the errors in texts (main_text, language), one row a page; a null language is one of its own."""
    texts = texts.select(F.coalesce("language", F.lit("")).alias("language"), "main_text")
    counts = materialize(_words(texts).groupBy("language", "word").agg(F.count(F.lit(1)).alias("pages")), "words")
    lexicon = counts.filter(F.col("pages") >= known).filter(F.length("word") >= letters - 1)
    odd = counts.filter((F.col("pages") <= rare) & (F.length("word") >= letters))
    form = lambda rows: rows.select("language", "word", "pages", F.explode(_forms(F.col("word"))).alias("form"))
    # the lexicon is small; odd words without a form of it go where they lie
    right = materialize(form(lexicon).withColumnRenamed("word", "known"), "lexicon").withColumn("key", F.xxhash64("language", "form"))
    left = among(form(odd).withColumn("key", F.xxhash64("language", "form")), "key", bitmaps(right, "key"))
    pairs = left.drop("pages").join(right, ["key", "language", "form"]).select("language", "word", "known", "pages").distinct()
    pairs = pairs.filter(_one_slip(F.col("word"), F.col("known")))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("n"), "known"))), 1, SUGGESTIONS)
    return pairs.groupBy("language", "word").agg(best.getField("known").alias("suggestions"))


def check(texts: DataFrame, **bounds: int) -> DataFrame:
    """(url, error, matches) of texts (url, main_text, language), as a spelling service has them: a match for each place of an error."""
    texts = texts.filter("main_text is not null").select("url", "main_text", F.coalesce("language", F.lit("")).alias("language"))
    wrong = materialize(errors(texts, **bounds), "errors").withColumn("key", F.xxhash64("language", "word"))
    filters = bitmaps(wrong, "key")
    pieces = F.regexp_extract_all("main_text", F.lit(_PIECES), F.lit(1))
    # only a word's place leaves the text, not the text with each word
    words = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("at"), F.lower(p).alias("word"))),
        lambda x: F.length(x["word"]) >= bounds.get("letters", LETTERS))
    places = texts.select("url", "language", F.inline(words)).withColumn("key", F.xxhash64("language", "word"))
    found = among(places, "key", filters).join(wrong, ["key", "language", "word"])
    found = found.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("at", "word", "suggestions"))).alias("places"))
    found = materialize(found, "places")
    # of the texts only those with errors meet their places
    own = among(texts.select("url", "main_text"), "url", bitmaps(found, "url")).join(found, "url").select("url", "places",
        pieces.alias("pieces"))
    byurl = own.select("url", F.transform("places", _match).alias("matches"), F.array_sort(F.array_distinct(F.transform("places",
        lambda x: x["word"]))).alias("words"))
    none = "array<struct<rule_id:string,message:string,short_message:string,excerpt:string,suggestions:array<string>>>"
    return texts.select("url").join(byurl, "url", "left").select("url", F.lit(None).cast("string").alias("error"), F.coalesce("matches",
        F.array().cast(none)).alias("matches"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def _match(x: Column) -> Column:
    """A place of an error as a service has it, with the text around it from the column pieces, of which each has a character at least."""
    at = x["at"]
    before = F.array_join(F.slice("pieces", F.greatest(at + 1 - CONTEXT, F.lit(1)), F.least(at, F.lit(CONTEXT))), "")
    after = F.array_join(F.slice("pieces", at + 2, F.lit(CONTEXT)), "")
    excerpt = F.concat(F.right(before, F.lit(CONTEXT)), F.get("pieces", at), F.left(after, F.lit(CONTEXT)))
    excerpt = F.substring(F.trim(F.regexp_replace(excerpt, r"\s+", " ")), 1, EXCERPT)
    return F.struct(F.lit(RULE_ID).alias("rule_id"), F.lit(MESSAGE).alias("message"), F.lit(SHORT).alias("short_message"),
        excerpt.alias("excerpt"), x["suggestions"].alias("suggestions"))
