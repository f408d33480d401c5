"""Benchmark decontamination on a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, doc_id, pos) for every occurrence of the test terms it
was built for, with the words on either side, so that the offset-adjusted lists of a
window's other terms are at hand where the rarest term stands.  Each window of a test
item is searched from its rarest term alone, counted over all documents; around it the
item's and the document's words are compared outwards.  Equal runs of a window's length
are exact matches; all terms of an item within a number of words are proximity matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 13
#: The benchmark is searched in blocks of about this many words: a block's terms go into the plan, its items are broadcast.
BLOCK_WORDS = 50_000


def words(text: Column) -> Column:
    """Words of a text between two empty strings: the second one's place is the number of words and one."""
    return F.split(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item) of items that have words."""
    found = words(F.col(text_col))
    return items.select(F.col(id_col).alias("item_id"), F.slice(found, F.lit(2), F.size(found) - 2).alias("item")).where(F.size("item") > 0)


def term_counts(docs: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """(term, n): occurrences of the terms in all documents."""
    said = F.filter(words(F.col(text_col)), lambda w: w.isin(terms))
    return docs.select(F.explode_outer(said).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


def rarest_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item, at, term): the places, from 1, of the rarest term of each window of each item."""
    placed = items.select("item_id", "item", F.posexplode("item").alias("at", "term")).withColumn("at", F.col("at") + 1)
    ranked = placed.join(counts, "term", "left").groupBy("item_id", "item").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("places"))
    last = F.greatest(F.size("item") - window + 1, F.lit(1))
    rarest = F.transform(F.sequence(F.lit(1), last), lambda s: F.array_min(F.transform(F.slice("places", s, F.lit(window)), lambda p: F.struct(p["n"], p["at"], p["term"]))))
    return ranked.select("item_id", "item", F.explode(F.array_distinct(rarest)).alias("a")).select("item_id", "item", "a.at", "a.term")


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", around: int = WINDOW - 1) -> DataFrame:
    """The index: (doc_id, n_words, pos, term, left, right) for each occurrence of a term.

    `left` holds up to `around` words before it, nearest first, `right` those after it.
    A document without any has one row with null pos.
    """
    every = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("said"))
    said = F.col("said")
    places = F.filter(F.sequence(F.lit(1), F.size(said) - 1), lambda i: said[i].isin(terms))

    def posting(i: Column) -> Column:
        before = F.greatest(i - around + 1, F.lit(2))
        return F.struct(
            i.alias("pos"),
            said[i].alias("term"),
            F.reverse(F.slice(said, before, F.greatest(i + 1 - before, F.lit(0)))).alias("left"),
            F.slice(said, i + 2, F.greatest(F.least(F.lit(around), F.size(said) - i - 2), F.lit(0))).alias("right"),
        )

    found = every.select("doc_id", (F.size(said) - 2).cast("long").alias("n_words"), F.transform(places, posting).alias("found"))
    return found.select("doc_id", "n_words", F.explode_outer("found").alias("p")).select("doc_id", "n_words", "p.*")


def _equal_run(mine: Column, theirs: Column) -> Column:
    """How many words two lists share from their start on."""
    size = F.least(F.size(mine), F.size(theirs))
    same = F.zip_with(F.slice(mine, F.lit(1), size), F.slice(theirs, F.lit(1), size), lambda a, b: a == b)
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, size.cast("long"))


def _spans(window: int) -> tuple[Column, Column]:
    """The run of equal words around a posting, and whether it holds a whole window of the item."""
    item, at = F.col("item"), F.col("at")
    start = F.greatest(at - window + 1, F.lit(1))
    back = _equal_run(F.col("left"), F.reverse(F.slice(item, start, at - start)))
    ahead = _equal_run(F.col("right"), F.slice(item, at + 1, F.lit(window - 1)))
    span = F.struct((F.col("pos") - back).alias("first"), (F.col("pos") + ahead).alias("last"))
    return span, back + ahead + 1 >= F.least(F.lit(window), F.size(item))


def phrase_matches(found: DataFrame, anchors: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, span): runs of document words around a posting that hold whole windows of an item."""
    span, whole = _spans(window)
    return found.join(F.broadcast(anchors), "term").where(whole).select("doc_id", "item_id", span.alias("span"))


def proximity_matches(found: DataFrame, anchors: DataFrame, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, pos): postings with at least `share` of the item's nearby distinct terms among their neighbours."""
    item, at = F.col("item"), F.col("at")
    start = F.greatest(at - WINDOW + 1, F.lit(1))
    near = F.array_distinct(F.slice(item, start, F.lit(2 * WINDOW - 1)))
    seen = F.array_union(F.array_union("left", "right"), F.array("term"))
    return found.join(F.broadcast(anchors), "term").where(F.size(F.array_intersect(near, seen)) >= share * F.size(near)).select("doc_id", "item_id", "pos")


def _terms(frame: DataFrame, term: Column) -> list[str]:
    """The distinct terms of a block of the benchmark."""
    return sorted(row[0] for row in frame.select(term.alias("term")).distinct().collect())


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Parts of the items whose words are few enough to broadcast; one part unless there are very many."""
    total = items.agg(F.sum(F.size("item"))).first()[0] or 0
    n = -(-total // BLOCK_WORDS)
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every document.

    A document word is hit if it lies in an occurrence of `window` consecutive words of an
    item (of the whole item if that is shorter); `items` are the ids of such items, as
    sorted strings.  Null and empty texts have no words.  Repeated ids count as one
    document whose texts are judged apart: its hits are joined by place.  Null ids are one id.
    Documents' other columns are not used.  The benchmark is searched in blocks that are
    small enough to broadcast, so its size has no limit.
    """
    span, whole = _spans(window)
    parts = []
    for block in _blocks(item_words(benchmark)):
        counts = term_counts(docs, _terms(block, F.explode("item")), text_col)
        anchors = settle(rarest_anchors(block, counts, window))
        found = postings(docs, _terms(anchors, F.col("term")), id_col, text_col, window - 1).join(F.broadcast(anchors), "term", "left")
        parts.append(found.select("doc_id", "n_words", F.when(whole, span).alias("span"), F.when(whole, F.col("item_id").cast("string")).alias("item")))
    every = reduce(DataFrame.unionByName, parts)
    spans = F.array_sort(F.collect_set("span"))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["last"] - F.greatest(s["first"] - 1, acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["last"]).alias("end")),
    )["n"]
    return every.groupBy("doc_id").agg(F.coalesce(F.max("n_words"), F.lit(0)).alias("n_words"), merged.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))

