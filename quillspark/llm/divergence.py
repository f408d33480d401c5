"""How the sources of a language differ in their words.

Many terms have the same counts in all sources.  Terms are grouped by their sparse vector
of (source, count); each pair of sources is compared once for each distinct vector, and the
difference counts as often as there are terms with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import settle, slices

#: Documents of a language that a term needs, and terms that are listed of each source.
LEAST_DOCS, LISTED = 30, 50
#: Smoothing, and the unit of shares.
ADDED, UNIT = 5, 1_000_000_000
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Letters, and the bytes of other scripts; all else stands between terms.
_FOLD = bytes(b if b >= 0x80 or bytes([b]).isalpha() else 0x20 for b in range(256)).translate(bytes.maketrans(_UPPER, _LOWER))
#: Bytes of texts of which a task counts terms at once, and of a text that it cuts at once.
SHARD_BYTES, PART_BYTES = 1 << 24, 1 << 22


def _terms(text: bytes | None) -> Counter:
    """A text's terms and their counts; a long text is cut in parts, at characters that end a term."""
    folded, at, found = (text or b"").translate(_FOLD), 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + PART_BYTES)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each shard."""
    for batch in slices(batches, SHARD_BYTES):
        n: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            found = _terms(text)
            n.setdefault((lang, source), Counter()).update(found)
            docs.setdefault((lang, source), Counter()).update(found.keys())
        for (lang, source), found in n.items():
            within = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array(list(found), pa.binary()).view(pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([within[t] for t in found], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, vector): of each term that `least_docs` documents of the language hold, its sources and counts there.

    docs has lang, source and text (null: empty); rows that repeat count each, other columns don't matter.
    A vector has at most an entry for each source of the language.
    """
    found = docs.select("lang", "source", "text").mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = found.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "vector")


def share(count: str, words: str, terms: str) -> Column:
    """1 + floor(UNIT (count + ADDED) / (words + ADDED terms)) of three columns, exact in decimals; null without terms."""
    below = f"{words} + {ADDED} * {terms}"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({count} + {ADDED} AS DECIMAL(20, 0)) * {UNIT}BD) div CAST({below} AS DECIMAL(20, 0)) END")


def _gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each pair of sources, and what a source says more often than its language.

    Null texts, languages and sources are ''.  Part `pair` has each other source of the language
    with the sum of absolute differences of shares over all kept terms (0 if there are none);
    part `term` the first `listed` terms by the excess of the source's share.  Rank 1 is the
    highest value, first by name of equals.  An empty table gives no rows.

    For a pair the sum is split: as if no term occurred in either; corrections for terms of one of
    them, summed by count; and for terms of both, once for each distinct vector.
    """
    blank = F.lit("")
    plain = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.coalesce("text", blank).alias("text"))
    terms = settle(term_vectors(plain, least_docs))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    words = terms.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = plain.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = settle(groups.withColumn("none", F.lit(0)).withColumn("zero", share("none", "words", "terms")).drop("none"))
    whole = groups.groupBy("lang").agg(F.sum("words").alias("all_words"))

    distinct = terms.groupBy("lang", "vector").agg(F.count("*").alias("m"))
    entries = distinct.select("lang", "vector", "m", F.inline("vector")).join(groups, ["lang", "source"]).withColumn("p", share("n", "words", "terms"))
    vectors = entries.groupBy("lang", "vector", "m", "terms").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("shares"), F.sum("n").alias("all_n"))
    vectors = settle(vectors.join(whole, "lang").withColumn("q", share("all_n", "all_words", "terms")).select("lang", "vector", "m", "q", "shares"))

    return _pairs(groups, vectors).union(_terms_of(terms, vectors, listed))


def _pairs(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    least = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * F.coalesce(_gap("zero", "item_zero"), F.lit(0))).alias("value"))

    single = vectors.select("lang", "m", F.inline("shares")).groupBy("lang", "source", "p", "zero").agg(F.sum("m").alias("m"))
    one = single.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_gap("p", "item_zero") - _gap("zero", "item_zero"))).alias("value"))

    both = vectors.select("lang", "m", "shares", F.inline("shares")).select("lang", "m", "source", "p", "zero", F.explode("shares").alias("_o")).where("_o.source > source")
    both = both.select("lang", "m", "source", "p", "zero", F.col("_o.source").alias("item"), F.col("_o.p").alias("item_p"), F.col("_o.zero").alias("item_zero"))
    extra = _gap("p", "item_p") - _gap("p", "item_zero") - _gap("zero", "item_p") + _gap("zero", "item_zero")
    two = both.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * extra).alias("value"))

    def swapped(rows: DataFrame) -> DataFrame:
        return rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    summed = least.union(one).union(swapped(one)).union(two).union(swapped(two)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def _terms_of(terms: DataFrame, vectors: DataFrame, listed: int) -> DataFrame:
    """Vectors are ranked first: a term can't be listed if `listed` distinct vectors exceed its own."""
    more = vectors.select("lang", "vector", "q", F.inline("shares")).where("p > q").select("lang", "source", "vector", (F.col("p") - F.col("q")).alias("value"))
    first = more.withColumn("_r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("_r") <= listed).drop("_r")
    found = first.join(terms, ["lang", "vector"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(found).where(F.col("rank") <= listed)


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(by))
