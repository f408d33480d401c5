"""Phrase collocations from word-id suffix arrays.

A task numbers the words of a shard, sorts the shard's suffixes by their first words with
prefix doubling, and reads the count of every phrase off the intervals of suffixes that
share it.  Spark adds the shards' counts up by phrase.  Words, pairs and longer phrases
are counted one after another: a phrase can only be frequent if all that it holds are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import settle, slices

#: Words of the longest phrase, and occurrences that a phrase needs.
LONGEST, LEAST = 4, 30
#: Phrases that a language's report lists.
REPORTED = 2000
#: A phrase is dropped if a longer one that holds it has so many hundredths of its occurrences.
COVERED = 80
#: Bytes of text in one suffix array, about.
SHARD_BYTES = 1 << 23
#: Bits of the map that tells phrases which may be frequent: 16 MB, however many there are.
BITS = 1 << 27
NO_LANG = "und"
#: Between pieces.  The bytes that end a piece, and blanks, in the order of their replacements.
END = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)


class Shard:
    """Numbered words of running text; word 0 is the gap between pieces.

    The first `carried` words were the last of the shard before: phrases that end within
    them have been counted there.
    """

    def __init__(self, tokens: list[bytes], carried: int = 0):
        numbers = {END: 0}
        for token in tokens:
            if token not in numbers:
                numbers[token] = len(numbers)
        self.words = pa.array(list(numbers), pa.binary())
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self.least = np.ones(len(tokens), dtype=np.int64)
        self.least[:carried] = carried - np.arange(carried) + 1

    def keep(self, words: Map, lang: str) -> None:
        """Turn words that can't be frequent into gaps; gaps that follow a gap go."""
        self.hashes = word_hashes(lang, self.words.to_pylist())
        known = words.has(self.hashes)
        known[0] = False
        self.ids = np.where(known[self.ids], self.ids, 0)
        here = (self.ids > 0) | (np.append(0, self.ids[:-1]) > 0)
        self.ids, self.least = self.ids[here], self.least[here]

    def sizes(self, depth: int) -> np.ndarray:
        """Words from each place up to the next gap, `depth` at most."""
        padded = np.append(self.ids, np.zeros(depth, dtype=np.int64))
        size, alive = np.zeros(len(self.ids), dtype=np.int64), np.ones(len(self.ids), dtype=bool)
        for k in range(depth):
            alive &= padded[k : k + len(self.ids)] > 0
            size += alive
        return size

    def suffixes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their first `depth` words, and how many words each shares with the one before."""
        n = len(self.ids)
        rank, order, width = self.ids, np.argsort(self.ids, kind="stable") if depth == 1 else None, 1
        while width < depth:
            further = np.append(rank[width:], np.zeros(min(width, n), dtype=np.int64))
            key = rank * (rank.max(initial=0) + 1) + further
            order = np.argsort(key, kind="stable")
            new = np.append(False, key[order[1:]] != key[order[:-1]]) if n else np.zeros(0, dtype=bool)
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
        padded = np.append(self.ids, np.zeros(depth, dtype=np.int64))
        shared, same = np.zeros(n, dtype=np.int64), np.append(False, np.ones(max(0, n - 1), dtype=bool))[:n]
        before = np.append(order[:1], order[:-1])
        for k in range(depth):
            same &= padded[order + k] == padded[before + k]
            shared += same
        return order, shared

    def phrases(self, order: np.ndarray, shared: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of every phrase of k words: the intervals of places that share k words."""
        starts = np.flatnonzero(shared < k)
        counted = ((size >= k) & (self.least <= k))[order].astype(np.int64)
        n = np.add.reduceat(counted, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        return order[starts[n > 0]], n[n > 0]

    def chains(self, pairs: Map, depth: int) -> np.ndarray:
        """Keep the words of pairs that may be frequent alone; how many such pairs run on from each, `depth` - 1 at most."""
        after = np.append(self.ids[1:], 0)
        good = (self.ids > 0) & (after > 0)
        good[good] = pairs.has(joined(self.hashes[self.ids[good]], self.hashes[after[good]]))
        here = good | np.append(False, good[:-1])[: len(good)]
        self.ids, self.least = self.ids[here], self.least[here]
        further = np.append(good[here], np.zeros(depth, dtype=bool)).astype(np.int64)
        chain = np.zeros(len(self.ids), dtype=np.int64)
        for k in range(depth - 2, -1, -1):
            chain = further[k : k + len(chain)] * (1 + chain)
        return chain

    def texts(self, places: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words at places."""
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[places + i])) for i in range(k)], pa.scalar(b" ", pa.binary()))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of group and word as Spark's xxhash64 has them."""
    seed = xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of words from theirs."""
    return ((first << np.uint64(1)) | (first >> np.uint64(63))) ^ second


class Map:
    """Phrases that may be frequent, by the hashes of group and words."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, counts: DataFrame, bits: int = BITS) -> Map:
        """Of the rows (lang, phrase); what reaches the driver has a fixed size."""
        words = F.transform(F.split("phrase", " ", -1), lambda w: F.xxhash64("lang", w))
        place = F.pmod(F.aggregate(words, F.lit(0).cast("long"), lambda h, w: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63)).bitwiseXOR(w)), F.lit(bits)) + 1
        parts = counts.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits")).collect()
        found = np.zeros(max(bits // 8, 4096), dtype=np.uint8)
        for bucket, part in parts:
            found[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, dtype=np.uint8)
        return cls(found[: -(-bits // 8)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.int64) % (len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _cut(body: bytes, limit: int) -> Iterator[bytes]:
    """Parts of a folded text of about `limit` bytes, cut at blanks."""
    at = 0
    while at < len(body):
        end = body.find(b" ", at + limit)
        end = len(body) if end < 0 else end
        yield body[at:end]
        at = end


def shards(texts: list[bytes | None], limit: int = SHARD_BYTES) -> Iterator[Shard]:
    """The words of texts, a gap between texts; a text beyond the limit is cut, and its last words lead the next shard."""
    if sum(len(t or b"") for t in texts) <= 2 * limit:
        yield Shard((END + b" " + b" . ".join(t or b"" for t in texts).translate(_FOLD).replace(END, b" . ") + b" .").split())
        return
    for text in texts:
        carried: list[bytes] = []
        for part in _cut((text or b"").translate(_FOLD).replace(END, b" . "), limit):
            tokens = carried + part.split()
            yield Shard(tokens, len(carried))
            carried = tokens[1 - LONGEST :]


def _counts(batches: Iterator[pa.RecordBatch], words: Map | None, pairs: Map | None, depth: int) -> Iterator[pa.RecordBatch]:
    """Counts by lang and phrase of each shard: words and, phrase null, their sum; with `words` pairs of them; with `pairs` longer phrases."""
    for batch in slices(batches, SHARD_BYTES):
        groups: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            groups.setdefault(lang, []).append(text)
        for lang, texts in groups.items():
            for shard in shards(texts):
                for found, n in _of_shard(shard, lang, words, pairs, depth):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(found)), found.view(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _of_shard(shard: Shard, lang: str, words: Map | None, pairs: Map | None, depth: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    if words is None:
        n = np.bincount(shard.ids[shard.least == 1], minlength=len(shard.words))
        n[0] = 0
        seen = np.flatnonzero(n)
        yield shard.words.take(pa.array(seen)), n[seen]
        yield pa.nulls(1, pa.binary()), np.array([n.sum()])
        return
    shard.keep(words, lang)
    if pairs is None:
        order, shared = shard.suffixes(2)
        places, n = shard.phrases(order, shared, shard.sizes(2), 2)
        yield shard.texts(places, 2), n
        return
    size = 1 + shard.chains(pairs, depth)
    order, shared = shard.suffixes(depth)
    for k in range(3, depth + 1):
        places, n = shard.phrases(order, shared, size, k)
        yield shard.texts(places, k), n


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """(lang, phrase, size, n): words and phrases of up to `longest` (2 to 4) words that occur `least` times or more within pieces.

    docs has lang (null: `und`) and text (null: empty); other columns don't matter, and rows that
    repeat count each.  A row of null phrase and size 0 has the language's words in all.
    Counts are exact: the bitmaps only leave out phrases that can't be frequent.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    plain = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    context = docs.sparkSession.sparkContext

    def counted(words: Map | None = None, pairs: Map | None = None) -> DataFrame:
        held = context.broadcast((words, pairs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _counts(batches, *held.value, longest)

        summed = plain.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        return settle(summed.where((F.col("n") >= least) | F.col("phrase").isNull()))

    words = counted()
    known = Map.of(words.where("phrase IS NOT NULL"), bits)
    pairs = counted(known)
    found = words.union(pairs)
    if longest > 2:
        found = found.union(counted(known, Map.of(pairs, bits)))
    return found.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(F.size(_words("phrase"))).alias("size"), "n")


def _words(phrase: str) -> Column:
    return F.split(phrase, " ", -1)


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("_w", start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more, by their lowest-scoring cut; `counts` as phrase_counts gives them.

    score is floor(2000000 a / (l + r)).  Of cuts with equal scores the one after fewest words counts.
    """
    single = counts.where("size > 0").select("lang", "phrase", "n")
    parts = single.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
    cut = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), _words("phrase").alias("_w")).select("lang", "phrase", "a", "_w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("_left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    cut = cut.join(parts.withColumnRenamed("_part", "_left").withColumnRenamed("_n", "l"), ["lang", "_left"]).join(parts.withColumnRenamed("_part", "_right").withColumnRenamed("_n", "r"), ["lang", "_right"])
    exact = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cut.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    return best.select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")


def uncovered(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase) of the phrases of two words or more that no longer one of `covered` hundredths of their occurrences holds."""
    inside = counts.where("size > 2").select("lang", "n", "size", _words("phrase").alias("_w")).select("lang", "n", "_w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_k"))
    inside = inside.select("lang", "n", "_w", "_k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_k") + 1)).alias("_at")).select("lang", _part(F.col("_at"), F.col("_k")).alias("phrase"), "n")
    longest = inside.groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    left = counts.where("size > 1").join(longest, ["lang", "phrase"], "left")
    return left.where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("n"))).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, covered: int = COVERED, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `reported` phrases by score, occurrences and spelling.

    An empty table and texts without words give no rows.  Ranks are settled in two steps, so that one task
    never gets more of a language than `reported` phrases of each of 64 shares.
    """
    counts = phrase_counts(docs, least, longest, bits)
    listed = scored(counts).join(uncovered(counts, covered), ["lang", "phrase"])
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = listed.withColumn("_share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*by))).where(F.col("rank") <= reported)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= reported)
    words = counts.where("size = 0").select("lang", F.col("n").alias("_all"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("_all").alias("n"), "score")
