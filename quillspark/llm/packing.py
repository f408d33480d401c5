"""Best-fit packing of token pieces into sequences, by bin completion on the histogram of lengths.

Pieces of one length are alike, so packing needs only how many there are of each: at
most `capacity` counts, however large the corpus.  Bin completion takes the largest
length left, searches the undominated fillings of the room beside it by branch and
bound, and repeats the best one as often as the counts allow; while that takes more
sequences than a lower bound, it goes back over them.  Pieces then take the slots of
their length by rank.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import settle, slices

CAPACITY = 2048
#: Sequences tried in all while looking for plans shorter than the first.
SEARCH_STEPS = 2000
VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker remembers.
MEMORY_WORDS = 300_000
#: How text splits into words before byte pairs merge, a fixed value of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters, in which Python's own classes agree with these.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧€]|[\xb2\xb3\xb9\xbc\xbd\xbe]")


@lru_cache(1)
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary's encoder: ids are merge ranks, and tokens spell bytes by printable characters."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(spelt[c] for c in token): i for token, i in vocabulary.items() if all(c in spelt for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _added(path: str) -> dict[str, int]:
    """The vocabulary's added tokens, which stand for themselves wherever a text spells them."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    if any(token[side] for token in added for side in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take their surroundings are not supported")
    return {token["content"]: token["id"] for token in added}


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, remembered within a bound."""

    def __init__(self, encoding: tiktoken.Encoding, added: dict[str, int]):
        super().__init__()
        self.encode = encoding.encode_ordinary
        self.added = added
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        found = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) < MEMORY_WORDS and len(word) < 40:
            self[word] = found
        return found

    def text(self, text: str) -> bytes:
        found, at = [], 0
        for token in self.split.finditer(text):
            found += [self.plain(text[at : token.start()]), self.added[token[0]].to_bytes(4, "little")]
            at = token.end()
        return b"".join([*found, self.plain(text[at:])]) if at else self.plain(text)

    def plain(self, text: str) -> bytes:
        if BEYOND_LATIN.search(text):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, LATIN_WORDS.findall(text)))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document, ids as little-endian unsigned 32-bit bytes.

    A document is its text's ids and id 0; null texts are empty.  Longer ones than
    `capacity` are cut into pieces of that length, the first of which may be shorter.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(_encoding(path), _added(path))
        for batch in slices(batches):
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                coded = words.text(text or "") + bytes(4)
                cut = (len(coded) - 1) % width + 1
                for k, (a, b) in enumerate(zip([0, *range(cut, len(coded), width)], range(cut, len(coded) + 1, width), strict=True)):
                    row.append(i), piece.append(k), start.append(a // 4), length.append((b - a) // 4), ids.append(coded[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def completions(counts: list[int], sizes: list[int], room: int, keep: int, most: int, nodes: int = 4000) -> list[list[int]]:
    """Up to `keep` fillings of `room` by remaining sizes (ascending) that waste least and at most `most`, best first.

    Depth first over sizes and how often each is taken, larger sizes and more of them first,
    so a filling comes before those that it dominates, the first descent is the best-fit
    filling, and the depth is that of distinct sizes.  A branch ends where even its largest
    possible sum can't beat the worst kept; the search ends at no waste or after `nodes` steps.
    """
    kept: list[tuple[int, int, list[tuple[int, int]]]] = []
    limit, left = most + 1, nodes
    within = list(accumulate(size * counts[size] for size in sizes))

    def search(room: int, top: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal limit, left
        if room < limit:
            insort(kept, (room, nodes - left, chosen))
            del kept[keep:]
            limit = kept[-1][0] if len(kept) == keep else limit
        for place in range(min(top, bisect_right(sizes, room)) - 1, -1, -1):
            size = sizes[place]
            for times in range(min(counts[size], room // size), 0, -1):
                if not limit or left <= 0 or room - min(room, within[place]) >= limit:
                    return
                left -= 1
                search(room - times * size, place, [*chosen, (size, times)])

    search(room, len(sizes), [])
    return [[size for size, times in chosen for _ in range(times)] for _, _, chosen in kept]


def best_completion(counts: list[int], sizes: list[int], room: int, nodes: int = 4000) -> list[int]:
    """The filling of `room` by remaining sizes (ascending) that wastes least."""
    return completions(counts, sizes, room, 1, room, nodes)[0]


def least_sequences(counts: list[int], capacity: int) -> int:
    """Sequences that any plan needs: for each size, lengths that exclude it fill some alone, others share what is left."""
    number, total = list(accumulate(counts)), list(accumulate(s * n for s, n in enumerate(counts)))
    half, least = capacity // 2, -(-total[-1] // capacity)
    for small in range(1, half + 1):
        alone = number[capacity] - number[capacity - small]
        large = number[capacity - small] - number[half]
        free = large * capacity - (total[capacity - small] - total[half])
        least = max(least, alone + large + max(0, -(-(total[half] - total[small - 1] - free) // capacity)))
    return least


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> list[tuple[list[int], int]]:
    """Patterns of lengths that fit a sequence, and how many sequences follow each.

    The first plan takes the best filling each time.  While a plan needs more sequences than
    `least_sequences`, one with a sequence less is sought over other fillings and fewer
    repeats; `steps` bounds that search, and the best plan found so far is the answer.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a length must be from 1 to {capacity}, not {length}")
        counts[length] += n
    least, total = least_sequences(counts, capacity), sum(s * n for s, n in enumerate(counts))
    plan = _search(counts, capacity, None, 1, 0)[0] or []
    while (need := sum(times for _, times in plan)) > least and steps > 0:
        better, steps = _search(counts, capacity, (need - 1) * capacity - total, 6, steps)
        if better is None:
            break
        plan = better
    return plan


def _search(counts: list[int], capacity: int, slack: int | None, keep: int, steps: int) -> tuple[list[tuple[list[int], int]] | None, int]:
    """The first plan that wastes at most `slack` in all, back over earlier sequences where need be, and the steps left; no slack given takes the first way down."""
    counts, plan, choices, wasted = counts[:], [], [], 0

    def change(pattern: list[int], times: int) -> None:
        for s in pattern:
            counts[s] -= times

    def ways() -> Iterator[tuple[list[int], int]]:
        sizes = [s for s in range(1, capacity + 1) if counts[s]]
        largest = sizes[-1]
        counts[largest] -= 1
        most = capacity if slack is None else slack - wasted
        fillings = completions(counts, sizes, capacity - largest, keep, most)
        counts[largest] += 1
        found = [[largest, *filling] for filling in fillings]
        repeats = [min(counts[s] // pattern.count(s) for s in set(pattern)) for pattern in found]
        yield from zip(found, repeats, strict=True)
        yield from ((pattern, 1) for pattern, n in zip(found, repeats, strict=True) if n > 1 and keep > 1)

    while any(counts):
        if len(choices) == len(plan):
            choices.append(ways())
        steps -= slack is not None
        if steps < 0:
            return None, 0
        way = next(choices[-1], None)
        if way is None:
            choices.pop()
            if not plan:
                return None, steps
            pattern, times = plan.pop()
            change(pattern, -times)
            wasted -= times * (capacity - sum(pattern))
        elif slack is None or wasted + way[1] * (capacity - sum(way[0])) <= slack:
            plan.append(way)
            change(*way)
            wasted += way[1] * (capacity - sum(way[0]))
    return plan, steps


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, pieces side by side) of the plan's places."""
    taken: dict[int, int] = {}
    found, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, run in groupby(pattern):
            beside, rank = len(list(run)), taken.get(length, 0)
            found.append((length, rank, rank + beside * times, sequence, offset, beside))
            taken[length] = rank + beside * times
            offset += length * beside
        sequence += times
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a column `length` from 1 to capacity) with sequence_id and offset added.

    Sequences hold at most `capacity`, without gaps from offset 0.  Only the histogram of
    lengths and the plan for it reach the driver; both are bounded by `capacity`.  Pieces are
    ranked within their length after a range sort, so a common length is ranked in many
    parts; what is broadcast has a row for each length and each part.  Other columns, such as
    the pieces' ids, are written once and meet their places by row.  Columns named
    sequence_id or offset are replaced.  No rows give no rows.
    """
    spark = pieces.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = settle(pieces.drop("sequence_id", "offset", "_row").withColumn("_row", F.monotonically_increasing_id()))
    order = ["length", *[c for c in ("doc_id", "piece") if c in held.columns], "_row"]
    parts = settle(held.select(*order).repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = dict(counts.groupBy("length").agg(F.sum("_n").alias("n")).collect())
    rows = slots(plan_sequences(histogram, capacity))
    places = spark.createDataFrame(rows, "length long, lo long, hi long, first long, offset long, beside long").groupBy("length").agg(F.collect_list(F.struct("lo", "hi", "first", "offset", "beside")).alias("_slots"))
    own = Window.partitionBy("length", "_part").orderBy(*order)
    ranked = parts.withColumn("_rank", F.row_number().over(own) - 1).join(F.broadcast(bases), ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(F.broadcast(places), "length").withColumn("_slot", F.filter("_slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0])
    at = F.col("_rank") - F.col("_slot.lo")
    sequence = F.col("_slot.first") + F.floor(at / F.col("_slot.beside"))
    offset = F.col("_slot.offset") + F.pmod(at, F.col("_slot.beside")) * F.col("length")
    return held.join(placed.select("_row", sequence.alias("sequence_id"), offset.alias("offset")), "_row").drop("_row")
