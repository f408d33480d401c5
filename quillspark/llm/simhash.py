"""SimHash near-duplicates, found by fuzzy keys from the binary Golay code.

A 64-bit fingerprint is cut in three segments of 22, 21 and 21 bits.  If two
fingerprints differ in at most three bits, two of their segments differ in at most
one bit each.  The perfect (23, 12) Golay code decodes a segment to the index of the
one codeword within three bits; a segment's fuzzy keys are the indices of all words
one bit away.  So one side needs its own index only and the other its few keys: they
meet whenever the segment differs in at most one bit.  The keys of two segments
together are joined, and every pair that meets is verified on all 64 bits.

`one_of_each` drops texts, so it decides by the Jaccard similarity of word-shingle sets.
At 0.8 fingerprints differ in about ten bits, too many for fuzzy keys alone: pairs are
proposed by them and by bands of smallest hashes, and the sets themselves decide.  Keys
that hold different texts, as a passage in very many texts makes them, are searched by
their texts' rarest shingles, never by all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import components, settle, slices

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the Golay code, a fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Near-copies in `one_of_each`: words of a shingle and least Jaccard similarity of the sets.
COPY_SHINGLE, SIMILARITY = 5, 0.8
#: Keys of a set, each of so many smallest hashes; a pair at 0.8 shares none with probability 0.0002.
BANDS, BAND_ROWS = 16, 4
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _remainders(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
    return words


@lru_cache(1)
def _decoder() -> np.ndarray:
    """Index of the nearest codeword, for each of the 2^22 segment values."""
    bits = 1 << np.arange(23, dtype=np.int64)
    one = np.concatenate([[0], bits])
    errors = np.unique((one[:, None, None] ^ one[None, :, None] ^ one[None, None, :]).ravel())
    fix = np.zeros(2048, dtype=np.int64)
    fix[_remainders(errors)] = errors
    words = np.arange(1 << 22, dtype=np.int64)
    return ((words ^ fix[_remainders(words)]) >> 11).astype(np.int16)


def fuzzy_keys(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Own index, and all indices with -1 for repeats, of segment values."""
    near = values[:, None] ^ np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    keys = np.sort(_decoder()[near].astype(np.int64), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return _decoder()[values].astype(np.int64), keys


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number; texts without a word have 0."""
    return _majority(shingle_hashes(text, shingle, seed))


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles in order; a text of fewer words is one shingle, one without a word none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(partial(xxh64_intdigest, seed=seed), runs), dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row: majority bits of the XXH64 of all word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(text, shingle) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def fuzzy_links(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ in 1 to 3 bits, from distinct fingerprints (id, fp)."""

    def keyed(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, fps = part.column(0), part.column(1).to_numpy()
                raw = fps.view(np.uint64)
                cut = [fuzzy_keys(((raw >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64), n) for s, n in SEGMENTS]
                for which, (i, j) in enumerate(PAIRS):
                    if probe:
                        row, x, y = np.nonzero((cut[i][1] >= 0)[:, :, None] & (cut[j][1] >= 0)[:, None, :])
                        left, right = cut[i][1][row, x], cut[j][1][row, y]
                    else:
                        row, left, right = np.arange(len(fps)), cut[i][0], cut[j][0]
                    code = pa.array((which << 24) | (left << 12) | right)
                    yield pa.RecordBatch.from_arrays([code, ids.take(pa.array(row)), pa.array(fps[row])], names=["code", "id", "fp"])

    schema = "code long, id long, fp long"
    index = points.mapInArrow(partial(keyed, probe=False), schema).select("code", F.col("id").alias("a"), F.col("fp").alias("fa"))
    probes = points.mapInArrow(partial(keyed, probe=True), schema).select("code", F.col("id").alias("b"), F.col("fp").alias("fb"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 3)
    return index.join(probes.hint("merge"), "code").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) of every row.

    Fingerprints link at three or fewer differing bits; a component is named by its
    smallest id.  Null and empty texts share fingerprint zero and so form one class.
    Equal fingerprints are one point of the search, so a group of copies costs one row.
    Repeated ids keep a row each and take part as one.  Other columns are not used.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle))
    points = prints.groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp")
    ring = components(fuzzy_links(settle(points)))
    classes = points.join(ring.hint("merge"), points["id"] == ring["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(classes.hint("merge"), "fp").select("id", "fp", "component_id")


def hex64(value: Column) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def band_keys(held: np.ndarray) -> list[int]:
    """Signed keys of a set of shingle hashes: each of BAND_ROWS smallest hashes under multipliers of its own."""
    if not len(held):
        return []
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(held), 2048):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * held[None, at : at + 2048]).min(1))
    keys = [xxh64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, same, fp, keys) of texts (id, text): a digest of the shingle set, its fingerprint without repeats, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [np.unique(shingle_hashes(text, shingle)) for text in batch.column(1).to_pylist()]
            same = np.array([xxh64_intdigest(x.tobytes()) for x in held], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(map(_majority, held), pa.int64()), pa.array(map(band_keys, held), pa.list_(pa.int64()))], names=["id", "same", "fp", "keys"])

    return texts.mapInArrow(run, "id long, same long, fp long, keys array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' shingle sets are similar enough, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.unique(shingle_hashes(left, shingle)), np.unique(shingle_hashes(right, shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (texts.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "_left"), ("b", "_right")))
    return settle(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "_left", "_right").mapInArrow(run, "a long, b long").distinct())


def prefix_pairs(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts (id, c, text) of different classes c: all whose shingle sets are similar, and few others.

    Shingles stand in order of the number of texts that hold them, the rarest first.  Of two
    similar sets the shorter's start and the longer's start (at 0.8 a ninth and a fifth) share
    one, at places that leave enough behind them.  A passage in very many texts stands at
    their ends and proposes nothing, unless texts hold little else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [np.unique(shingle_hashes(text, shingle)) for text in batch.column(2).to_pylist()]
            same = np.array([xxh64_intdigest(x.tobytes()) for x in held], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same), pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))], names=["id", "c", "same", "held"])

    sets = settle(texts.select("id", "c", "text").mapInArrow(run, "id long, c long, same long, held array<long>").dropDuplicates(["id", "same"]))
    said = sets.select("id", "same", F.explode("held").alias("h"))
    often = said.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one text alone comes before all others and can't be shared, so its place is only counted.
    order = said.join(often.hint("merge"), "h").groupBy("id", "same").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order"))
    whole = sets.select("id", "c", "same", F.size("held").alias("n")).join(order.hint("merge"), ["id", "same"]).withColumn("alone", F.col("n") - F.size("order"))
    first = (F.floor(F.col("n") * (1 - similarity) + 1e-6) + 1 - F.col("alone")).cast("int")
    starts = whole.select("id", "c", "n", "alone", F.posexplode(F.slice("order", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "o"))
    starts = settle(starts.select("id", "c", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("o.h").alias("h")))
    share = similarity / (1 + similarity)
    shorter, longer = (starts.select("h", *[F.col(x).alias(f"{x}_{side}") for x in ("id", "c", "n", "at")]) for side in ("a", "b"))
    sizes = "c_a <> c_b AND (n_a < n_b OR n_a = n_b AND id_a < id_b)"
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    near = (F.col("n_a") + 1e-6 >= similarity * F.col("n_b")) & (left + 1e-6 >= share * (F.col("n_a") + F.col("n_b")))
    found = shorter.where(F.col("at_a") <= F.col("n_a") * (1 - 2 * share) + 1e-6).join(longer.hint("merge"), "h").where(F.expr(sizes) & near)
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def similar_links(texts: DataFrame, points: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that join all similar texts (id, text), from one point (id, fp, keys) for each shingle set.

    Every proposed pair is decided by its sets.  First all points of a key are compared with
    its smallest id; so a large group of near-copies costs one comparison a point and key.
    Points of keys that are then in different components go through a prefix filter.
    """
    spread = points.select("id", F.explode(F.array_union("keys", F.array("fp"))).alias("key"))
    tops = spread.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    shared = settle(spread.join(tops.hint("merge"), "key").select("key", "first", "id"))
    fuzzy = fuzzy_links(settle(points.groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp")))
    pairs = settle(shared.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).union(fuzzy).distinct())
    wanted = shared.select("id").union(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    held = settle(texts.join(wanted.hint("merge"), "id", "left_semi"))
    links = _similar(pairs, held, shingle, similarity)
    ring = components(links).withColumnRenamed("node", "id")
    tagged = settle(shared.join(ring.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")))
    mixed = tagged.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    apart = tagged.join(mixed.hint("merge"), "key", "left_semi").select("id", "c").distinct()
    rest = prefix_pairs(held.join(apart.hint("merge"), "id"), shingle, similarity).join(pairs.hint("merge"), ["a", "b"], "left_anti")
    return links.union(_similar(settle(rest), held, shingle, similarity))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id names its component: one of each group of near-copies.

    Texts link where the Jaccard similarity of their sets of word shingles is at least
    `similarity`; texts without a word are one class.
    Rows of null ids all stay and link nothing; rows that repeat a kept id stay.
    """
    unnamed = docs.where(F.col(id_col).cast("long").isNull())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    points = settle(_sets(texts, shingle).groupBy("same").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    ring = components(similar_links(texts, points, shingle, similarity))
    kept = points.join(ring.hint("merge"), points["id"] == ring["node"], "left").select(F.coalesce("component", "id").alias("_kept")).distinct()
    return docs.join(kept.hint("merge"), docs[id_col].cast("long") == kept["_kept"], "left_semi").unionByName(unnamed)
