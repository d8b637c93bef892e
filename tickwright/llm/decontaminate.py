"""Benchmark decontamination over a positional inverted index.

Postings (term, document, position) are stored once for every training token that a test phrase
can ask for; terms that no phrase holds need no list. A phrase is looked up from its rarest term:
the term's list, moved by the term's offset, gives candidate starts, the list of the second-rarest
term thins them out, and the remaining starts must meet the moved lists of all terms. Since rare
terms lead, a common word's list is only read where rare words already agree.

Phrase tables are broadcast only when their counted rows are below ``BROADCAST_ROWS`` (a few MB);
above it the same joins shuffle, with skewed terms split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwright.llm.text import keyed, same_document, words_of
from tickwright.session import materialize

WINDOW = 13
BROADCAST_ROWS = 100_000
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bounded(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrases_of(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(phrase, item, words) of all windows; shorter items are one window, empty ones none."""
    rows = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - width, F.lit(0)))
    rows = rows.select("item", "all", F.explode(starts).alias("s"))
    words = F.slice("all", F.col("s") + 1, F.least(F.lit(width), F.size("all")))
    return rows.select("item", words.alias("words")).select(F.md5(F.array_join("words", " ")).alias("phrase"), "item", "words").distinct()


def index_postings(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tid, id, mark, pos) of the tokens of keyed documents that the vocabulary (term, tid) lists."""
    tokens = rows.select("id", "mark", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return materialize(tokens.join(bounded(vocabulary), "term").select("tid", "id", "mark", "pos"), "postings")


def ranked_terms(phrases: DataFrame, vocabulary: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase, n, off, tid, rank): terms of each phrase, the one with the shortest list first.

    Phrases with a term that has no list are left out; they occur nowhere.
    """
    lists = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    terms = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    terms = terms.join(vocabulary, "term").join(lists, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = Window.partitionBy("phrase")
    terms = terms.withColumn("least", F.min("df").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "tid", "off")))
    return materialize(terms.where(F.col("least") > 0).select("phrase", "n", "off", "tid", "rank"), "phrase-terms")


def phrase_matches(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, mark, phrase, start, n): exact occurrences, by intersection from the rarest terms."""
    first = materialize(terms.where("rank = 1").select("phrase", "n", "off", "tid"), "first-terms")
    starts = postings.join(bounded(first), "tid").select("id", "mark", "phrase", "n", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second = terms.where("rank = 2").select("phrase", F.col("off").alias("off2"), F.col("tid").alias("tid2"))
    second = bounded(materialize(second, "second-terms"))
    starts = starts.join(second, "phrase", "left").withColumn("at", F.col("start") + F.col("off2"))
    asked = bounded(materialize(second.select(F.col("tid2").alias("tid")).distinct(), "second-lists"))
    lists = postings.join(asked, "tid", "left_semi").select(F.col("id").alias("pid"), F.col("mark").alias("pmark"), F.col("pos").alias("ppos"), F.col("tid").alias("ptid"))
    lists = lists.withColumn("found", F.lit(True))
    on = [F.col("id").eqNullSafe(F.col("pid")), F.col("mark") == F.col("pmark"), F.col("at") == F.col("ppos"), F.col("tid2") == F.col("ptid")]
    left = starts.join(lists, on, "left").where("found or n = 1").select("id", "mark", "phrase", "n", "start").distinct()
    left = materialize(left, "candidates")

    held = bounded(materialize(left.select(F.col("id").alias("did"), F.col("mark").alias("dmark")).distinct(), "candidate-docs"))
    lists = postings.join(held, [F.col("id").eqNullSafe(F.col("did")), F.col("mark") == F.col("dmark")], "left_semi")
    lists = lists.select(F.col("id").alias("pid"), F.col("mark").alias("pmark"), F.col("pos").alias("ppos"), F.col("tid").alias("ptid"))
    asks = left.join(bounded(terms.select("phrase", "off", "tid")), "phrase").withColumn("at", F.col("start") + F.col("off"))
    on = [F.col("id").eqNullSafe(F.col("pid")), F.col("mark") == F.col("pmark"), F.col("at") == F.col("ppos"), F.col("tid") == F.col("ptid")]
    met = asks.join(lists, on).groupBy("id", "mark", "phrase", "n", "start").agg(F.count_distinct("off").alias("met"))
    return met.where(F.col("met") == F.col("n")).select("id", "mark", "phrase", "start", "n")


def proximity_matches(postings: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """(id, mark, phrase, pos): places of a phrase's rarest term with all its other terms, in any
    order, at most ``within`` words away. Lists meet on (document, term, stretch of positions)."""
    within = max(1, within)
    distinct = terms.groupBy("phrase", "tid").agg(F.min("rank").alias("rank"))
    size = distinct.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    first = distinct.where("rank = 1").select("phrase", "tid").join(size, "phrase")
    seeds = postings.join(first, "tid").select("id", "mark", "phrase", "n", "pos")
    others = distinct.where("rank > 1").select("phrase", F.col("tid").alias("tid2"))
    stretch = F.explode(F.array(*[(F.floor(F.col("pos") / within) + k) for k in (-1, 0, 1)]))
    asks = seeds.join(others, "phrase").withColumn("stretch", stretch)
    lists = postings.select(F.col("id").alias("pid"), F.col("mark").alias("pmark"), F.col("tid").alias("ptid"), F.col("pos").alias("ppos"))
    lists = lists.withColumn("pstretch", F.floor(F.col("ppos") / within))
    on = [F.col("id").eqNullSafe(F.col("pid")), F.col("mark") == F.col("pmark"), F.col("tid2") == F.col("ptid"), F.col("stretch") == F.col("pstretch")]
    near = asks.join(lists, on).where(F.abs(F.col("pos") - F.col("ppos")) <= within)
    near = near.groupBy("id", "mark", "phrase", "n", "pos").agg(F.count_distinct("tid2").alias("met")).where("met = n - 1")
    alone = seeds.where("n = 1").select("id", "mark", "phrase", "pos")
    return near.select("id", "mark", "phrase", "pos").unionByName(alone).distinct()


def build_index(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(vocabulary, postings, ranked phrase terms) for a phrase table."""
    vocabulary = phrases.select(F.explode("words").alias("term")).distinct()
    vocabulary = materialize(vocabulary.withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    postings = index_postings(keyed(docs, id_col, text_col), vocabulary)
    return vocabulary, postings, ranked_terms(phrases, vocabulary, postings)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(RAW_WORD)).cast("long")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, mark, n_hit, n_items, items) for documents in which a window of an item occurs.

    Null or empty texts hold nothing. Items without an id mark words but are not listed.
    Windows that several items share count for each of them; repeated documents or items change
    nothing. Empty tables give no rows.
    """
    phrases = materialize(phrases_of(items, item_id_col, item_text_col, width), "phrases")
    _, postings, terms = build_index(docs, phrases.select("phrase", "words").distinct(), id_col, text_col)
    found = materialize(phrase_matches(postings, terms), "matches")
    spans = found.select("id", "mark", "start", (F.col("start") + F.col("n")).alias("end")).groupBy("id", "mark", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("id", "mark").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start")))
    hits = spans.select("id", "mark", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("id", "mark").agg(F.sum("fresh").alias("n_hit"))
    named = phrases.select("phrase", F.col("item").cast("string").alias("item"))
    named = found.select("id", "mark", "phrase").distinct().join(named, "phrase")
    named = named.groupBy("id", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = hits.join(named, same_document(hits, named)).select(hits["id"], hits["mark"], "n_hit", "items")
    return out.withColumn("n_items", F.size("items").cast("long"))


def mark_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and (n_words, n_hit, n_items, items, contaminated).

    A document is contaminated if it has hit words and they are a twentieth of its words or more.
    Input columns with one of the new names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    found = contamination(docs, items, width, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.struct("*").alias("row"), word_count(F.col(text_col)).alias("n_words"))
    joined = rows.join(found, same_document(rows, found), "left").select("row.*", "n_words", "n_hit", "n_items", "items")
    joined = joined.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
        "n_items": F.coalesce("n_items", F.lit(0)).cast("long"),
        "items": F.coalesce("items", F.array().cast("array<string>")),
    })
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
