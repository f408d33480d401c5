"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes are equal through `depth` bytes exactly if their windows of that length
are.  The sort goes by most significant digits and stops at that depth; a bucket of one
is done.  Its digits are hashes of whole blocks:

1. A window's block is the one of `block` bytes inside it with the smallest hash, so
   equal windows have equal blocks at equal places.  Neighbouring windows share their
   block and go into the first pass together, as a run; it buckets runs by block.
2. The second pass splits a bucket by the content of the whole run.  Equal runs repeat
   in all their windows.
3. Runs that differ from all others of their bucket are opened: their windows, and those
   of one run of each other class in the bucket, are split by their full depth.

Equal groups are exactly the repeated windows.  Only hashes are shuffled in passes 1 to 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.bytehash import Rolling, mix, sliding_min
from quillspark.llm.common import settle, slices

DEPTH = 200
BLOCK = 40
#: Stands for a null id.  With it the id is never null, and both uses of the dealt texts share one exchange.
NO_ID = -(1 << 63)
#: Bytes hashed at once, a power of two; a place among them fits the low bits of a key.
CHUNK_BITS = 20
_PLACE = np.uint64((1 << CHUNK_BITS) - 1)


class Runs(NamedTuple):
    """Runs of windows of several texts: text, first and last window start in it, hash of the block and of the content."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    block: np.ndarray
    content: np.ndarray


def _chunk_runs(data: np.ndarray, limits: np.ndarray, depth: int, block: int) -> Runs:
    """Runs in one buffer; `limits` are the ends of the texts that it joins."""
    rolling = Rolling(data)
    hashes = rolling.every(block)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_min(keys, depth - block + 1) & _PLACE).astype(np.int64)
    start = np.arange(len(chosen))
    text = np.searchsorted(limits, start, side="right")
    whole = start + depth <= limits[np.minimum(text, len(limits) - 1)]
    start, chosen, text = start[whole], chosen[whole], text[whole]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])) if len(start) else np.zeros(0, np.int64)
    first, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1] if len(new) else start
    at, text = chosen[new], text[new]
    content = mix(rolling.spans(first, last + depth) ^ mix((at - first).astype(np.uint64)))
    origin = np.concatenate([[0], limits])[text]
    return Runs(text, first - origin, last - origin, hashes[at].view(np.int64), content.view(np.int64))


def text_runs(texts: list[bytes], depth: int = DEPTH, block: int = BLOCK) -> Runs:
    """Runs of windows of all texts; a text that exceeds a chunk is cut into chunks that share depth - 1 bytes."""
    found, at = [], 0
    room = 1 << CHUNK_BITS
    while at < len(texts):
        if len(texts[at]) > room:
            whole = np.frombuffer(texts[at], np.uint8)
            for start in range(0, len(whole) - depth + 1, room - depth + 1):
                part = _chunk_runs(whole[start : start + room], np.array([min(room, len(whole) - start)]), depth, block)
                found.append(part._replace(text=part.text + at, first=part.first + start, last=part.last + start))
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= room:
            size += len(texts[end])
            end += 1
        part = _chunk_runs(np.frombuffer(b"".join(texts[at:end]), np.uint8), np.cumsum([len(t) for t in texts[at:end]]), depth, block)
        found.append(part._replace(text=part.text + at))
        at = end
    return Runs(*map(np.concatenate, zip(*found, strict=True))) if found else Runs(*[np.zeros(0, np.int64)] * 5)


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def window_runs(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(block, content, id, n): the distinct runs of each text (id, body) and how often each stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = text_runs([b or b"" for b in batch.column(1).to_pylist()], depth)
            order = np.lexsort((runs.content, runs.block, runs.text))
            text, block, content = runs.text[order], runs.block[order], runs.content[order]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (block[1:] != block[:-1]) | (content[1:] != content[:-1])])) if len(text) else order
            n = np.diff(np.concatenate([new, [len(text)]]))
            yield _batch({"block": block[new], "content": content[new], "id": batch.column(0).take(pa.array(text[new])), "n": n})

    return texts.select("id", "body").mapInArrow(run, "block long, content long, id long, n long")


def sort_buckets(runs: DataFrame) -> DataFrame:
    """Passes 1 and 2: (id, equal, open), lists of contents of each text's runs that share their block with others.

    equal: the content stands elsewhere too.  open: its windows must be told apart; in a
    bucket with contents that stand once, that is for those and for one text of each other.
    """
    shared = runs.groupBy("block").agg(F.sum("n").alias("_total")).where("_total > 1").select("block")
    held = settle(runs.join(shared, "block"))
    classes = held.groupBy("block", "content").agg(F.sum("n").alias("_n"), F.min("id").alias("_one"))
    mixed = classes.where("_n = 1").select("block").distinct().withColumn("_mixed", F.lit(True))
    states = classes.join(mixed, "block", "left").select("block", "content", "_one", (F.col("_n") > 1).alias("_equal"), F.coalesce("_mixed", F.lit(False)).alias("_mixed"))
    marked = held.join(states, ["block", "content"]).withColumn("_open", F.col("_mixed") & (F.col("id") == F.col("_one"))).where("_equal OR _open")
    return marked.groupBy("id").agg(F.collect_list(F.when(F.col("_equal"), F.col("content"))).alias("equal"), F.collect_list(F.when(F.col("_open"), F.col("content"))).alias("open"))


def open_windows(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Pass 3: (id, at), the starts of windows of open runs (id, body, open) that stand elsewhere in open runs too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            for i, (body, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                runs = text_runs([body], depth)
                some = np.flatnonzero(np.isin(runs.content, np.array(wanted, np.int64)))
                some = some[np.unique(runs.content[some], return_index=True)[1]]
                data = np.frombuffer(body, np.uint8)
                for part in range(0, len(some), 1 << 12):
                    first, last = runs.first[some[part : part + (1 << 12)]], runs.last[some[part : part + (1 << 12)]]
                    sizes = last - first + 1
                    at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    hashes = window_hashes(data, at, depth).view(np.int64)
                    yield _batch({"window": hashes, "id": batch.column(0).take(pa.array(np.full(len(at), i))), "at": at})

    windows = texts.select("id", "body", "open").mapInArrow(run, "window long, id long, at long")
    return windows.withColumn("_n", F.count("*").over(Window.partitionBy("window"))).where("_n > 1").select("id", "at")


def window_hashes(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the windows of a text at given ascending places."""
    found = np.zeros(len(at), np.uint64)
    room = 1 << CHUNK_BITS
    for chunk in np.unique(at // room):
        some = at // room == chunk
        base = int(chunk) * room
        rolling = Rolling(data[base : base + room + depth])
        found[some] = rolling.spans(at[some] - base, at[some] - base + depth)
    return found


def _cover(first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Maximal spans of the union of [first, last)."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(first[new], reach[np.concatenate([new[1:], [len(first)]]) - 1], strict=True)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, n_bytes, kept, spans) of every document: the bytes left, and the byte spans [start, end) taken out.

    A byte goes if a window of `depth` bytes of UTF-8 covers it that starts anywhere else
    too, in the same document or another; windows are those of the whole input.  `spans` are
    the maximal ones, in order, null if there are none.  Null texts are empty, and texts
    shorter than `depth` stay as they are.  ids must be unique; one may be null.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bodies = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("body"))
    lists = settle(sort_buckets(window_runs(bodies.where(F.octet_length("body") >= depth), depth)))
    dealt = bodies.repartition(partitions, "id")
    starts = open_windows(dealt.join(lists.where(F.size("open") > 0), "id"), depth).groupBy("id").agg(F.collect_list("at").alias("at"))
    found = dealt.join(lists.select("id", "equal"), "id", "left").join(starts, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, spans = [], []
            for body, equal, at in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                mine: list[dict[str, int]] = []
                if equal or at:
                    runs = text_runs([body], depth)
                    some = np.isin(runs.content, np.array(equal or [], np.int64))
                    single = np.array(at or [], np.int64)
                    mine = _cover(np.concatenate([runs.first[some], single]), np.concatenate([runs.last[some], single]) + depth)
                edges = [0, *(x for s in mine for x in (s["start"], s["end"])), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if mine else body)
                spans.append(mine or None)
            n_bytes = pa.array(map(len, batch.column(1).to_pylist()), pa.int64())
            yield _batch({"id": batch.column(0), "n_bytes": n_bytes, "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    kept = found.select("id", "body", "equal", "at").mapInArrow(run, "id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
    return kept.withColumn("id", F.nullif("id", F.lit(NO_ID)))
