"""Benchmark decontamination over a distributed positional inverted index.

The index holds (term, document, position) for every place where a term of the test set occurs in the
training texts; it is stored in segments, one for each input split, so building it shuffles nothing. A phrase
is searched from its rarest terms: the list of the rarest one, shifted by its offset in the phrase, gives
places where the phrase may start; these meet the shifted lists of the next rarest terms; the few that are
left are compared with the text, so matches are exact.

Built-in functions only. Lower case means A-Z; words are runs of other characters than ASCII separators. A
null or text without words has no words and no hits; an item without words is no phrase; items with a null
id count as one item with an empty id; repeated documents are told apart by nothing and get equal results;
documents that share an id but not a text are told apart by a hash of the text. Empty tables give no hits.
Other columns are left alone.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import ascii_lower, packed, whole

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 13
LISTS = 3
END = "\x00"  # stands behind the last word of every document; no word can equal it
END_TERM = -1
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(whole(text)), SEPARATORS), "")


def bounded(df: DataFrame) -> DataFrame:
    """A stored table, sent to all tasks if it has at most BROADCAST_ROWS rows; else joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term, word) for the words of a test set."""
    words = texts.select(F.explode(words_of(F.col(text))).alias("word")).distinct()
    return materialize(words.select(F.xxhash64("word").alias("term"), "word"), "index-terms")


def build_index(documents: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(_key, _hash, term, pos), stored. Term END_TERM holds the number of words of each document."""
    ends = terms.sparkSession.range(1).select(F.lit(END_TERM).cast("bigint").alias("term"), F.lit(END).alias("word"))
    known = bounded(materialize(terms.unionByName(ends), "index-vocabulary"))
    t = F.col(text)
    rows = documents.select(
        F.col(key).alias("_key"), F.xxhash64(whole(t)).alias("_hash"),
        F.posexplode(F.concat(words_of(t), F.array(F.lit(END)))).alias("pos", "word"),
    )
    return materialize(rows.join(known, "word").select("_key", "_hash", "term", "pos"), "index")


def phrases_of(items: DataFrame, item: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, words, items): the distinct windows of an item set; a shorter item is one window."""
    held = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    rows = held.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(window)))).alias("words"))
    return materialize(
        rows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("phrase", F.xxhash64(F.concat_ws(" ", "words"))),
        "phrases",
    )


def rarest_terms(phrases: DataFrame, index: DataFrame, lists: int = LISTS) -> DataFrame:
    """(phrase, n, anchors): the offsets and terms of the rarest words of each phrase whose words all occur.

    A phrase with fewer words repeats its rarest one.
    """
    counts = index.filter(F.col("term") != END_TERM).groupBy("term").agg(F.count("*").alias("n"))
    places = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("off", "word"))
    met = places.withColumn("term", F.xxhash64("word")).join(counts, "term")
    ranked = met.groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("a"))
    ranked = ranked.filter(F.size("a") == F.col("size"))
    pick = F.array(*[F.coalesce(F.get("a", F.lit(i)), F.get("a", F.lit(0))) for i in range(lists)])
    return materialize(ranked.select("phrase", "size", pick.alias("anchors")), "phrase-anchors")


def phrase_starts(index: DataFrame, anchors: DataFrame, lists: int = LISTS) -> DataFrame:
    """(_key, _hash, phrase, start) where the lists of a phrase's rarest terms agree."""
    first = bounded(anchors.select("phrase", "anchors", F.col("anchors")[0]["term"].alias("term")))
    found = index.join(first, "term").withColumn("start", F.col("pos") - F.col("anchors")[0]["off"]).filter("start >= 0")
    found = found.select("_key", "_hash", "phrase", "start", "anchors")
    needed = anchors.select(F.explode(F.slice("anchors", 2, lists - 1)).alias("a")).select("a.term").distinct()
    rest = materialize(index.join(bounded(materialize(needed, "phrase-terms")), "term", "left_semi"), "phrase-lists")
    for i in range(1, lists):
        place = found.withColumns({"_term": F.col("anchors")[i]["term"], "_pos": F.col("start") + F.col("anchors")[i]["off"]})
        other = rest.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), F.col("term").alias("_t"), F.col("pos").alias("_p"))
        same = (
            F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
            & (F.col("_pos") == F.col("_p")) & (F.col("_term") == F.col("_t"))
        )
        found = place.join(other, same, "left_semi").drop("_term", "_pos")
    return found.select("_key", "_hash", "phrase", "start")


def exact_matches(documents: DataFrame, starts: DataFrame, phrases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(_key, _hash, hits): for each document with matches, (start, end, items) of each, in order."""
    met = starts.distinct().join(bounded(phrases), "phrase")
    held = met.groupBy("_key", "_hash").agg(F.collect_list(F.struct("start", "words", "items")).alias("maybe"))
    held = materialize(held, "phrase-candidates")
    rows = documents.select(F.col(key).alias("_k"), F.xxhash64(whole(F.col(text))).alias("_h"), F.col(text).alias("_t"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    # Only ids are sent to all tasks; the candidates meet the few texts that have some.
    ids = materialize(held.select("_key", "_hash"), "phrase-documents")
    few = rows.join(bounded(ids.select(F.col("_key").alias("_k1"), F.col("_hash").alias("_h1"))), F.col("_k").eqNullSafe(F.col("_k1")) & (F.col("_h") == F.col("_h1")), "left_semi")
    texts = few.join(held, same)
    # The one-element array has the words split once for a text, not once for each candidate.
    right = F.transform(
        F.array(words_of(F.col("_t"))),
        lambda w: F.filter("maybe", lambda c: F.slice(w, c["start"] + 1, F.size(c["words"])) == c["words"]),
    )[0]
    hits = F.transform(right, lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.size(c["words"])).alias("end"), c["items"].alias("items")))
    return texts.select("_key", "_hash", F.array_sort(hits).alias("hits")).filter(F.size("hits") > 0).dropDuplicates(["_key", "_hash"])


def proximity_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """(_key, _hash, phrase, at): places of a phrase's rarest term with all its other terms, each at most
    ``slop`` words from where the phrase has it."""
    words = phrases.select("phrase", F.posexplode("words").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    anchors = rarest_terms(phrases, index, 1)
    first = anchors.select("phrase", "size", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["off"].alias("_off"))
    at = index.join(bounded(first), "term").select("_key", "_hash", "phrase", "size", F.col("pos").alias("at"), "_off")
    wanted = at.join(words.select("phrase", "term", "off"), "phrase").withColumn("place", F.col("at") + F.col("off") - F.col("_off"))
    near = wanted.withColumn("pos", F.explode(F.sequence(F.col("place") - slop, F.col("place") + slop)))
    met = near.join(index, ["_key", "_hash", "term", "pos"])
    return met.groupBy("_key", "_hash", "phrase", "size", "at").agg(F.countDistinct("off").alias("n")).filter("n = size").drop("n", "size")


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(_key, _hash, n_words, hits) for every document."""
    index = build_index(documents, vocabulary(benchmark, text), key, text)
    phrases = phrases_of(benchmark, item, text)
    starts = phrase_starts(index, rarest_terms(phrases, index))
    found = exact_matches(documents, starts, phrases, key, text)
    ends = index.filter(F.col("term") == END_TERM).select("_key", "_hash", F.col("pos").cast("bigint").alias("n_words"))
    other = found.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "hits")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    return ends.join(other, same, "left").drop("_k", "_h")


def verdict(found: DataFrame) -> DataFrame:
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    step = lambda a, h: F.struct(
        (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], h["end"]).alias("upto"),
    )
    n_hit = F.coalesce(F.aggregate("hits", zero, step, lambda a: a["n"]), F.lit(0).cast("bigint"))
    items = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))), F.array().cast("array<string>"))
    rows = found.withColumns({"n_hit": n_hit, "items": items})
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    bad = verdict(contamination(documents, benchmark, key, item, text)).filter("contaminated")
    bad = bounded(materialize(bad.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h")), "contaminated"))
    held = packed(documents, _id=F.col(key), _own=F.xxhash64(whole(F.col(text))))
    return held.join(bad, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_own") == F.col("_h")), "left_anti").select("_row.*")


def op7_positional_index(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return verdict(contamination(documents, benchmark)).select(
        F.col("_key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
