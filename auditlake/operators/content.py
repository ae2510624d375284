"""Rules on main texts: thin, equal, similar and repeated content, keywords, spelling.

Near duplicates are found exactly: with each text's shingles in one order, the frequent ones last,
two texts that share 85 % of them share one among the first 15 % (prefix filter), so a
phrase that stands on every page never brings pages together. Equal texts are one row there.
Each text is cut into words once; what is exchanged are 8-byte hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import collapse, tokens
from auditlake.operators.membership import among, apart, bitmaps
from auditlake.operators.registry import FINDING, as_findings, finding, payload
from auditlake.operators.sketches import class_sizes, involved, similar_classes
from auditlake.operators.tech import shared
from auditlake.storage import materialize

THIN, DUPLICATE_WORDS, SIMILAR, SHINGLE, BLOCK_PAGES, KEYWORD_LENGTH, TOP, SHOWN, SPELLING_ERRORS = 100, 50, 0.85, 4, 3, 4, 3, 5, 5
#: Shingles of more texts than FEW are told from the rest when prefixes are cut, at most TOLD of them (12 MB).
FEW, TOLD = 8, 1 << 20
#: Words that are no keywords (fixed values).
STOPWORDS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "und", "oder", "aber",
    "sondern", "denn", "weil", "wenn", "dann", "ist", "sind", "war", "waren", "wird", "werden", "wurde", "wurden",
    "hat",
    "haben", "hatte", "hatten", "auf", "für", "mit", "von", "zu", "im", "in", "an", "bei", "aus", "über", "unter",
    "vor", "nach",
    "ohne", "gegen", "durch", "um", "auch", "noch", "nur", "schon", "wieder", "sehr", "mehr", "alle", "sich", "sie",
    "es", "er",
    "wir", "ihr", "sein", "seine", "ihre", "als", "wie", "was", "wer", "wo", "warum", "wann", "welche", "diese",
    "dieser",
    "dieses", "diesen", "diesem", "uns", "ihnen", "mir", "mich", "dich", "dir", "the", "and", "for", "with", "from",
    "this",
    "that", "these", "those", "have", "has", "had", "are", "were", "will", "would", "could", "should", "you", "your",
    "our",
    "their", "his", "her", "but", "not", "all", "any", "more", "less", "than", "into", "onto",
)


def with_text(pages: DataFrame) -> DataFrame:
    """(page_url, title, h1, main_text, main_word_count, content_blocks) of HTML pages that have a main text."""
    return pages.filter("is_html and main_text <> ''").select(F.col("url").alias("page_url"), "title", "h1",
        "main_text", "main_word_count", "content_blocks")


def text_facts(texts: DataFrame) -> DataFrame:
    """What the rules on texts need of each, from one pass over its words; to be written before they read it.

    (page_url, main_word_count, doc, set, title_key, title_found, h1_key, h1_found, keywords): the
    digest, the shingles' hashes of texts of enough words, the keywords of title and heading and
    whether the text has them, the text's own keywords.
    """
    words = texts.select("page_url", "main_word_count", _digest().alias("doc"), tokens(F.col("main_text")).alias("__words"),
        top_keyword(F.coalesce("title", F.lit(""))).alias("title_key"), top_keyword(F.coalesce("h1", F.lit(""))).alias("h1_key"))
    found = lambda c: F.array_contains("__words", F.col(c)).alias(c.replace("key", "found"))
    kept = F.filter("__words", _is_keyword)
    enough = F.col("main_word_count") >= DUPLICATE_WORDS
    facts = words.select("page_url", "main_word_count", "doc", "title_key", found("title_key"), "h1_key", found("h1_key"),
        top_words(kept, TOP).alias("keywords"), F.when(enough, F.transform("__words", lambda w: F.xxhash64(w))).alias("__hashes"))
    return facts.withColumn("set", F.when(F.col("__hashes").isNotNull(), _shingles("__hashes", SHINGLE))).drop("__hashes")


def thin_findings(texts: DataFrame) -> DataFrame:
    return as_findings(texts.filter(F.col("main_word_count") < THIN), "content.thin",
        payload(word_count=F.col("main_word_count"), min=F.lit(THIN)))


def _digest() -> Column:
    return F.sha2(F.lower(collapse(F.col("main_text"))).cast("binary"), 256)


def _eligible(texts: DataFrame) -> DataFrame:
    return texts.filter(F.col("main_word_count") >= DUPLICATE_WORDS)


def duplicate_findings(texts: DataFrame) -> DataFrame:
    """Findings for pages of one text. texts or their facts; digests go in 32 bytes, and those that stand once don't meet URLs."""
    doc = F.col("doc") if "doc" in texts.columns else _digest()
    rows = _eligible(texts).select("page_url", F.unhex(doc).alias("digest"))
    return as_findings(shared(rows.withColumnRenamed("digest", "value")), DUPLICATE, duplicate_payload())


DUPLICATE = "content.duplicate.page"


def duplicate_payload() -> Column:
    return payload(duplicate_of=F.col("others"), count=F.col("count"))


def _word_hashes(c: Column) -> Column:
    return F.transform(tokens(c), lambda w: F.xxhash64(w))


def _shingles(hashes: str, k: int) -> Column:
    """Distinct hashes of the runs of k in the column of word hashes; a shorter text is one run."""
    words = F.col(hashes)
    several = F.transform(F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.array_distinct(F.when(F.size(words) >= k, several).when(F.size(words) > 0,
            F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>")))


def shingled(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(page_url, doc, set) of texts of enough words: the digest of the text, and its shingles' hashes.

    The words are bound to a column before the runs are made: inside the lambda the text would be
    cut into words again for each run.
    """
    rows = _eligible(texts) if "set" in texts.columns else text_sets(texts, k)
    return rows.select("page_url", "doc", "set")


def text_sets(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(page_url, main_word_count, doc, set) of texts of enough words: of their facts what near copies need, without keywords."""
    words = _eligible(texts).select("page_url", "main_word_count", _digest().alias("doc"),
        _word_hashes(F.col("main_text")).alias("__words"))
    return words.select("page_url", "main_word_count", "doc", _shingles("__words", k).alias("set"))


def one_of_each(sets: DataFrame) -> DataFrame:
    """(doc, set) of written sets, one row for each doc. Only docs that several rows have are exchanged and written."""
    rows = sets.select("doc", "set")
    copied = materialize(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("doc"), "copied-docs")
    filters = bitmaps(copied, "doc")
    return apart(rows, "doc", filters).union(materialize(among(rows, "doc", filters).dropDuplicates(["doc"]), "docs"))


def frequent_shingles(texts: DataFrame, few: int = FEW, most: int = TOLD, similar: float = SIMILAR) -> DataFrame:
    """(shingle, level) of the shingles that stand in more than ``few`` of the texts' pools; level is the power of two of their number.

    A text's pool are its first shingles by hash, twice as many as its prefix takes: only these are
    exchanged and counted. Where too few of a pool are rare, all of the text's other shingles are
    counted as well. What is counted has no part in which pairs are found, only in how many meet.
    Where the frequent ones are more than ``most``, only the most frequent levels.
    """
    pools = materialize(_often(_pools(texts, similar, None), few), "frequent-shingles")
    known = _most_frequent_levels(pools, most)
    table = known.orderBy("shingle").toArrow()
    if not table.num_rows:
        return known
    rest = _often(_pools(texts, similar, table["shingle"].to_numpy()), few)
    both = pools.union(rest).groupBy("shingle").agg(F.max("level").alias("level"))
    return _most_frequent_levels(materialize(both, "frequent-shingles"), most)


def _often(each: DataFrame, few: int) -> DataFrame:
    """(shingle, level) of those that more than ``few`` rows (shingle) have."""
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > few)
    return counts.select("shingle", F.floor(F.log2("df")).cast("int").alias("level"))


def _most_frequent_levels(often: DataFrame, most: int) -> DataFrame:
    """The most frequent levels of a written (shingle, level) that have at most ``most`` shingles together."""
    # a row for each power of two
    sizes = often.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    told = accumulate(r["n"] for r in sizes)
    return often.filter(F.col("level").isin([r["level"] for r, n in zip(sizes, told) if n <= most]))


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, shingles of all sets one after another, the set that each is of)."""
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return n, sets.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def _among(known: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Where each shingle stands in the sorted known ones, -1 for others."""
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, at, -1)


def _pools(texts: DataFrame, similar: float, known: np.ndarray | None) -> DataFrame:
    """(shingle) of the pools of texts (id, set); with known frequent ones what is outside the pools that have too few others."""
    told = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shingles, owner = _flat(batch.column(0))
            order = np.lexsort((shingles, owner))
            shingles, length = shingles[order], _prefix_length(n, similar)
            kept = np.arange(len(shingles)) - np.repeat(np.cumsum(n) - n, n) < 2 * length[owner]
            if told is not None:
                rare = np.bincount(owner, kept & (_among(told.value, shingles) < 0), len(n))
                kept = ~kept & (rare < length)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(shingles[kept])], ["shingle"])

    return texts.select("set").mapInArrow(run, "shingle bigint")


def prefixes(texts: DataFrame, frequent: DataFrame, similar: float) -> DataFrame:
    """(shingle, id, n): the first shingles of each of the texts (id, set), of n, in one order of all shingles.

    Frequent ones come last, the rest in order of their hashes. Any order brings all similar texts
    together; this one keeps phrases of many pages out. The sets are sorted where they lie.
    """
    table = frequent.orderBy("shingle").toArrow()
    told = texts.sparkSession.sparkContext.broadcast((table["shingle"].to_numpy(), table["level"].to_numpy()))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, levels = told.value
        for batch in batches:
            n, shingles, owner = _flat(batch.column(1))
            level = np.zeros(len(shingles), np.int32)
            if len(known):
                at = _among(known, shingles)
                level = np.where(at >= 0, levels[at], 0)
            order = np.lexsort((shingles, level, owner))
            place = np.arange(len(shingles)) - np.repeat(np.cumsum(n) - n, n)
            picked = order[place < _prefix_length(n, similar)[owner]]
            of = owner[picked]
            yield pa.RecordBatch.from_arrays([pa.array(shingles[picked]), batch.column(0).take(pa.array(of)),
                pa.array(n[of].astype(np.int32))], ["shingle", "id", "n"])

    return texts.select("id", "set").mapInArrow(run, f"shingle bigint, id {kind}, n int")


def _prefix_length(n: np.ndarray, similar: float) -> np.ndarray:
    return (n - np.ceil(n * similar - 1e-9) + 1).astype(np.int64)


def near_pairs(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of docs a < b in written (doc, set) whose sets have at least that Jaccard similarity.

    A doc is an equal text's representative, so copies add nothing. Of a text only the prefix is
    exchanged, 16 bytes of the doc's digest with each shingle. Two texts have no more in common than
    in their prefixes and in the longer one of the rests; the sets meet for those only that this
    leaves.
    """
    texts = one_of_each(sets).filter(F.size("set") > 0).select(F.unhex(F.substring("doc", 1, 32)).alias("id"), "doc", "set")
    prefix = materialize(prefixes(texts, frequent_shingles(texts), similar), "prefixes")
    a = prefix.select("shingle", F.col("id").alias("a"), F.col("n").alias("na"))
    b = prefix.select("shingle", F.col("id").alias("b"), F.col("n").alias("nb"))
    like = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similar - 1e-9)
    met = a.join(b, "shingle").filter(like).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"))
    rest = lambda n: F.ceil(F.col(n) * similar - 1e-9) - 1
    most = F.col("met") + F.greatest(rest("na"), rest("nb"))
    enough = most >= (F.col("na") + F.col("nb")) * (similar / (1 + similar)) - 1e-6
    candidates = materialize(met.filter(enough).select("a", "b"), "candidates")
    texts = involved(texts, candidates)
    left = texts.select(F.col("id").alias("a"), F.col("doc").alias("da"), F.col("set").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("doc").alias("db"), F.col("set").alias("sb"))
    both = candidates.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    both = both.withColumn("similarity", F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")))
    return both.filter(F.col("similarity") >= similar).select(F.col("da").alias("a"), F.col("db").alias("b"), "similarity")


def near_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity), (doc, page_url)): pairs of similar unlike texts by digest, and the pages of each text.

    What the near-duplicate rule says, without a row for each pair of pages.
    """
    return near_pairs(_written_sets(texts)), text_members(texts)


def text_members(texts: DataFrame) -> DataFrame:
    """(doc, page_url): the pages of each text of enough words, by its digest. No shingle is read or made for it."""
    doc = F.col("doc") if "doc" in texts.columns else _digest().alias("doc")
    return _eligible(texts).select(doc, "page_url").distinct()


def _written_sets(texts: DataFrame) -> DataFrame:
    """The sets of texts or of their facts, which are written already."""
    return shingled(texts) if "set" in texts.columns else materialize(shingled(texts), "shingles")


def text_classes(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(page_url, doc, class, texts, pages), a row for each page: near copies as classes in place of pairs.

    doc is the text's digest, class the smallest digest that similar texts reach, texts and pages how
    many different texts and pages the class has. Equal texts are sketched once.
    """
    sets = _written_sets(texts)
    found = similar_classes(one_of_each(sets).withColumnRenamed("doc", "id"), similar)
    pages = sets.select("page_url", "doc").distinct().join(found.withColumnRenamed("id", "doc"), "doc")
    return class_sizes(pages).select("page_url", "doc", "class", "texts", F.col("rows").alias("pages"))


def near_findings(texts: DataFrame) -> DataFrame:
    """A finding for either page of each pair of similar but not equal texts, as the rule has it: copies multiply."""
    sets = _written_sets(texts)
    pairs, members = near_pairs(sets), sets.select("doc", "page_url")
    both = pairs.union(pairs.select("b", "a", "similarity"))
    rows = both.join(members.withColumnRenamed("doc", "a"),
        "a").join(members.select(F.col("doc").alias("b"), F.col("page_url").alias("other")), "b")
    return as_findings(rows, "content.duplicate.near",
        payload(similar_to=F.col("other"), similarity=F.round("similarity", 3)))


def _key(c: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 32))


def block_findings(texts: DataFrame) -> DataFrame:
    """A finding for each page and block of it that more than ``BLOCK_PAGES`` pages have.

    First only keys of blocks and pages are exchanged and counted. The keys that are frequent make
    a filter, by which blocks that stand on few pages go where they lie. What is left meets by key;
    a key's least and greatest text tell whether two texts share it, and such texts are counted by
    themselves.
    """
    blocks = texts.select("page_url", F.explode("content_blocks").alias("block")).withColumn("key", _key(F.col("block")))
    seen = blocks.select("key", _key(F.col("page_url")).alias("page")).distinct()
    often = seen.groupBy("key").agg(F.count(F.lit(1)).alias("page_count")).filter(F.col("page_count") > BLOCK_PAGES)
    often = materialize(often, "frequent-blocks")
    left = materialize(among(blocks, "key", bitmaps(often, "key")), "repeated-blocks")
    ends = left.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high")).join(often, "key")
    ends = materialize(ends.select("key", "page_count", (F.col("low") == F.col("high")).alias("one")), "block-keys")
    excerpt = F.substring("block", 1, 200).alias("excerpt")
    rows = left.select("page_url", "key", excerpt).join(ends.filter("one"), "key").select("page_url", "key", "excerpt",
        "page_count").distinct()
    shared = left.join(ends.filter("not one").select("key"), "key").select("page_url", "block").distinct()
    counts = shared.groupBy("block").agg(F.count(F.lit(1)).alias("page_count")).filter(F.col("page_count") > BLOCK_PAGES)
    rows = rows.drop("key").union(shared.join(counts, "block").select("page_url", excerpt, "page_count"))
    return as_findings(rows, "content.block.repeated",
        payload(excerpt=F.col("excerpt"), page_count=F.col("page_count"), threshold=F.lit(BLOCK_PAGES)))


def _is_keyword(w: Column) -> Column:
    return (F.length(w) >= KEYWORD_LENGTH) & ~w.isin(*STOPWORDS)


def _keywords(c: Column) -> Column:
    return F.filter(tokens(c), _is_keyword)


def _most_frequent(words: Column) -> Column:
    """The most frequent of an array of words, the first among equals; null without one. One pass over the sorted words."""
    # sort_array compares by itself, array_sort by a lambda
    at = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("word"),
        F.lit(None).cast("string").alias("w"), F.lit(0).alias("c"), F.lit(0).alias("f"))

    def step(s: Column, x: Column) -> Column:
        same = s["w"].eqNullSafe(x["w"])
        run, first = F.when(same, s["c"] + 1).otherwise(F.lit(1)), F.when(same, s["f"]).otherwise(x["i"])
        better = (run > s["n"]) | (run == s["n"]) & (first < s["at"])
        pick = lambda a, b: F.when(better, a).otherwise(b)
        return F.struct(pick(run, s["n"]).alias("n"), pick(first, s["at"]).alias("at"),
            pick(x["w"], s["word"]).alias("word"), x["w"].alias("w"), run.alias("c"), first.alias("f"))

    return F.aggregate(at, start, step, lambda s: s["word"])


def top_keyword(c: Column) -> Column:
    """The most frequent keyword, the first among equals; null without one."""
    return _most_frequent(_keywords(c))


def keyword_findings(texts: DataFrame) -> DataFrame:
    """Findings for titles and headings whose keyword isn't in the text, in one pass. texts or their facts."""
    rows = texts
    if "title_key" not in texts.columns:
        rows = texts.select("page_url", top_keyword(F.coalesce("title", F.lit(""))).alias("title_key"),
            top_keyword(F.coalesce("h1", F.lit(""))).alias("h1_key"), tokens(F.col("main_text")).alias("words"))
        rows = rows.select("*", *[F.array_contains("words", F.col(f"{c}_key")).alias(f"{c}_found") for c in ("title", "h1")])
    lacks = lambda c: F.col(f"{c}_key").isNotNull() & ~F.col(f"{c}_found")
    url = F.col("page_url")
    one = lambda c: finding(f"content.keyword.{c}_not_in_body", payload(keyword=F.col(f"{c}_key"), source=F.lit(c)), url)
    title = F.when(lacks("title"), one("title"))
    h1 = F.when(lacks("h1") & ~F.col("h1_key").eqNullSafe(F.col("title_key")), one("h1"))
    return rows.select(F.inline(F.array_compact(F.array(title, h1)))).select(*FINDING)


_ENTRY = "struct<n:int,at:int,word:string>"


def top_words(words: Column, top: int) -> Column:
    """array<struct<n, at, word>>: the most frequent of an array of words, n negative, first occurrence deciding between equals.

    One pass over the sorted words with room for ``top`` of them, inside the row: of a page's words
    nothing else leaves it.
    """
    at = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    nothing = F.lit(None).cast(_ENTRY)
    start = F.struct(F.array().cast(f"array<{_ENTRY}>").alias("best"), nothing.alias("run"))

    def kept(s: Column) -> Column:
        """The best with the run that has ended."""
        better = F.slice(F.sort_array(F.concat(s["best"], F.array(s["run"]))), 1, top)
        return F.when(s["run"].isNull(), s["best"]).otherwise(better)

    def step(s: Column, x: Column) -> Column:
        same = s["run"]["word"].eqNullSafe(x["w"])
        n, first = F.when(same, s["run"]["n"] - 1).otherwise(F.lit(-1)), F.when(same, s["run"]["at"]).otherwise(x["i"])
        run = F.struct(n.alias("n"), first.alias("at"), x["w"].alias("word"))
        return F.struct(F.when(same, s["best"]).otherwise(kept(s)).alias("best"), run.alias("run"))

    return F.aggregate(at, start, step, kept)


def page_keywords(texts: DataFrame, top: int = TOP) -> DataFrame:
    """(page_url, keyword, n, rank): each page's most frequent keywords, first occurrence deciding between equals.

    A page's words are bound to a column first, so that they are cut once. Rows of one URL each have
    their keywords.
    """
    if "keywords" not in texts.columns or top != TOP:
        words = texts.select("page_url", _keywords(F.col("main_text")).alias("__words"))
        texts = words.select("page_url", top_words(F.col("__words"), top).alias("keywords"))
    best = texts.select("page_url", F.posexplode("keywords").alias("rank", "best"))
    return best.select("page_url", F.col("best.word").alias("keyword"), (-F.col("best.n")).cast("long").alias("n"),
        (F.col("rank") + 1).alias("rank"))


def cannibalization_findings(texts: DataFrame) -> DataFrame:
    rows = page_keywords(texts).select("page_url", "keyword").distinct()
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy("page_url"))).filter(
        F.col("n") <= SHOWN + 1)
    few = few.groupBy("keyword").agg(F.array_sort(F.collect_list("page_url")).alias("few")).filter(F.size("few") > 1)
    others = F.slice(F.array_remove("few", F.col("page_url")), 1, SHOWN)
    return as_findings(rows.join(few, "keyword"), "content.keyword.cannibalization",
        payload(keyword=F.col("keyword"), competing_with=others))


def spelling_findings(results: DataFrame, least: int = SPELLING_ERRORS) -> DataFrame:
    """results: (url, error, matches array<struct<rule_id, message, excerpt, suggestions>>)."""
    rows = results.filter((F.col("error").isNull() | (F.col("error") == "")) & (F.size("matches") >= least))
    ids = F.transform("matches", lambda m: m["rule_id"])
    # rules times matches: a service is sent a few thousand characters of a page and names some dozen rules
    counted = F.transform(F.array_distinct(ids), lambda r: F.struct((-F.size(F.filter(ids,
                lambda x: x == r))).alias("n"), F.array_position(ids, r).alias("at"), r.alias("id")))
    examples = F.transform(F.slice("matches", 1, SHOWN),
        lambda m: F.struct(m["rule_id"].alias("rule_id"), m["message"].alias("message"), m["excerpt"].alias("excerpt"),
            F.slice(m["suggestions"], 1, 3).alias("suggestions")))
    data = payload(count=F.size("matches"), min_errors=F.lit(least),
        top_rules=F.transform(F.slice(F.array_sort(counted), 1, SHOWN), lambda x: x["id"]), examples=examples)
    return as_findings(rows.withColumnRenamed("url", "page_url"), "content.spelling.errors", data)


_KEYED = ("page_url", "title_key", "title_found", "h1_key", "h1_found", "keywords")


def keyword_facts(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """The keywords in facts, those of a URL that several texts have from the words of all of these.

    facts: written ``text_facts`` of texts. Such URLs are found in the facts; only their texts are read again.
    """
    several = facts.groupBy("page_url").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("page_url")
    several = materialize(several, "shared-urls")
    if several.isEmpty():
        return facts.select(*_KEYED)
    same = among(texts.select("page_url", "title", "h1", "main_text"), "page_url", bitmaps(several, "page_url"))
    same = materialize(same.join(several, "page_url"), "texts-of-shared-urls")
    field = lambda name, c: same.select("page_url", F.lit(name).alias("field"), F.posexplode(tokens(F.coalesce(c, F.lit("")))).alias(
        "at", "word"))
    words = field("title", "title").union(field("h1", "h1")).union(field("keywords", "main_text")).filter(_is_keyword(F.col("word")))
    words = words.groupBy("page_url", "field", "word").agg((-F.count(F.lit(1))).cast("int").alias("n"), F.min("at").alias("at"))
    order = F.row_number().over(Window.partitionBy("page_url", "field").orderBy("n", "at", "word"))
    best = words.withColumn("rank", order).filter(F.col("rank") <= TOP)
    first = lambda name: F.max(F.when((F.col("field") == name) & (F.col("rank") == 1), F.col("word"))).alias(f"{name}_key")
    top = F.array_sort(F.collect_list(F.when(F.col("field") == "keywords", F.struct("n", "at", "word")))).alias("keywords")
    best = best.groupBy("page_url").agg(first("title"), first("h1"), top)
    rows = same.select("page_url", tokens(F.col("main_text")).alias("__words")).join(best, "page_url", "left")
    found = lambda c: F.array_contains("__words", F.col(f"{c}_key")).alias(f"{c}_found")
    rows = rows.select("page_url", "title_key", found("title"), "h1_key", found("h1"),
        F.coalesce("keywords", F.array().cast(f"array<{_ENTRY}>")).alias("keywords"))
    return facts.select(*_KEYED).join(several, "page_url", "left_anti").union(rows)


def content_findings(pages: DataFrame, spelling: DataFrame | None = None) -> DataFrame:
    texts = with_text(pages)
    facts = materialize(text_facts(texts), "text-facts")
    keyed = keyword_facts(facts, texts)
    out = thin_findings(facts).union(duplicate_findings(facts)).union(near_findings(facts)).union(
        block_findings(texts)).union(keyword_findings(keyed)).union(cannibalization_findings(keyed))
    return (out if spelling is None else out.union(spelling_findings(spelling))).select(*FINDING)
