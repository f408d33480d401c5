"""Substring dedup by sliding sentence spans.

Texts are cut into sentences and clauses, and these after every word whose hash says so,
since a long one would hide what is repeated within it.  From each of them a span runs over as many as
make at least MIN_SENTENCES and MIN_WORDS; every span is hashed and counted over all
documents, and sentences under a span that isn't the first of its kind are removed.
Where a span starts and ends depends on its own words alone, so a passage gives the same
spans wherever it is pasted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytehash import Rolling
from quillspark.llm.common import settle, slices, with_membership

MIN_SENTENCES, MIN_WORDS = 3, 25
#: A clause also ends after every word whose hash is a multiple of this.
CUT = 4
_STOPS = ".!?,;:|。！？；：，、｡､…؟،؛۔।॥።፣"
_CLOSERS = "\"'”’»)]"
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Letters of scripts that put no spaces between words, as ranges; each counts as a word.
_LETTERS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _table(signs: str) -> np.ndarray:
    """Whether each code point up to 0xFFFF is one of the signs."""
    found = np.zeros(1 << 16, dtype=bool)
    found[[ord(c) for c in signs]] = True
    return found


_STOP, _CLOSER, _BLANK = map(_table, (_STOPS, _CLOSERS, _BLANKS))


def _clauses(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, where each starts, and the ends of its clauses among them.

    Words stand between ASCII white space; a clause ends after a word that a stop closes,
    quotes and brackets after it apart, and after one whose hash is a multiple of CUT.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.minimum(codes, 0xFFFF)
    word = ~_BLANK[low]
    alone = np.zeros(len(codes), dtype=bool)
    if not text.isascii():
        for first, last in _LETTERS:
            alone |= (codes >= first) & (codes <= last)
    cut = np.concatenate([[True], ~word[:-1] | alone[:-1]]) | alone if len(codes) else word
    starts = np.flatnonzero(word & cut)
    ends = np.flatnonzero(word & np.concatenate([~word[1:] | cut[1:], [True]])) if len(codes) else starts
    hashes = Rolling(codes).spans(starts, ends + 1)
    tail = ends
    for _ in range(2):
        tail = np.where(_CLOSER[low[tail]] & (tail > starts), tail - 1, tail)
    close = np.flatnonzero(_STOP[low[tail]] | ((hashes >> np.uint64(8)) % np.uint64(CUT) == 0)) + 1
    return hashes, starts, close if len(starts) == 0 or (len(close) and close[-1] == len(starts)) else np.append(close, len(starts))


def _parts(text: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The clauses as texts; blanks before the first word belong to the first."""
    bounds = [0, *starts[ends[:-1]].tolist(), len(text)]
    return [text[a:z] for a, z in zip(bounds, bounds[1:], strict=False) if a < z]


def split_sentences(text: str) -> list[str]:
    """Sentences and clauses with what follows them; joined they are the text."""
    _, starts, ends = _clauses(text)
    return _parts(text, starts, ends)


def _hashes(words: np.ndarray, ends: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    said = np.concatenate([[0], ends]).astype(np.int64)
    first = np.arange(len(ends))
    end = np.maximum(np.searchsorted(said, said[:-1] + min_words), first + min_sentences)
    whole = end <= len(ends)
    return Rolling(words).spans(said[first[whole]], said[end[whole]]).view(np.int64), first[whole], end[whole]


def span_hashes(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and end of each span of a text; white space within it doesn't count."""
    words, _, ends = _clauses(text)
    return _hashes(words, ends, min_sentences, min_words)


def _spans(texts: DataFrame) -> DataFrame:
    """(span, id, at, again): hashes of all spans of the texts (id, text), the sentences they start with, and whether their text has had them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [span_hashes(t or "")[:2] for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
            span, at = (np.concatenate(x) for x in zip(*found, strict=True))
            again = np.concatenate([np.isin(np.arange(len(h)), np.unique(h, return_index=True)[1], invert=True) for h, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(span), batch.column(0).take(pa.array(owner)), pa.array(at.astype(np.int32)), pa.array(again)], names=["span", "id", "at", "again"])

    return texts.select("id", "text").mapInArrow(run, "span long, id long, at int, again boolean")


def later_spans(texts: DataFrame) -> DataFrame:
    """(id, at): where spans start that have come before, by id and then by place.

    The smallest id of each repeated span is written first.  Spans that a bitmap of these
    rules out aren't dealt again; both sides of the join on the others are dealt anew, and
    adaptive execution can split a span that is very common.  Spans are computed twice
    rather than written, since they take more room than the texts.
    """
    spans = _spans(texts)
    often = settle(spans.groupBy("span").agg(F.count("*").alias("_n"), F.min("id").alias("_first")).where("_n > 1").select("span", "_first"))
    told = with_membership(spans, "span", often, "_may", bits=1 << 27).where("_may")
    return told.join(often, "span").where("id > _first OR again").select("id", "at")


def drop_repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with what is left of each text, and n_sentences, n_removed and n_spans.

    The first span of a kind is the one of the smallest id, then the first in its text; its
    sentences stay.  `n_spans` counts maximal removed runs of sentences.  Null texts stay
    null; a text may end up empty.  ids must be unique; texts of null ids stay whole and are
    no span's first.  Columns of the added names are replaced, all others are kept as they are.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    later = later_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).groupBy("id").agg(F.collect_list("at").alias("_at")).withColumnRenamed("id", "_later")
    plain = docs.drop("n_sentences", "n_removed", "n_spans", "_at", "_text", "_later")
    place = len(plain.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_without(text, at) for text, at in zip(batch.column(place).to_pylist(), batch.column(place + 1).to_pylist(), strict=True)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], *columns], names=[*batch.schema.names[:place], "_text", "n_sentences", "n_removed", "n_spans"])

    dealt = plain.withColumn("_text", F.col(text_col)).withColumn(text_col, F.lit(None).cast("string")).repartition(partitions, F.col(id_col).cast("long"))
    joined = dealt.join(later, F.col(id_col).cast("long") == later["_later"], "left").select(*dealt.columns, "_at")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    found = joined.mapInArrow(run, f"{kinds}, n_sentences long, n_removed long, n_spans long")
    return found.withColumn(text_col, F.col("_text")).drop("_text")


def _without(text: str | None, at: list[int] | None) -> tuple[str | None, int, int, int]:
    """A text without the spans that start at the given sentences."""
    words, place, ends = _clauses(text or "")
    if not at:
        return text, max(len(ends), int(bool(text))), 0, 0
    _, first, end = _hashes(words, ends, MIN_SENTENCES, MIN_WORDS)
    gone = np.zeros(len(ends) + 1, dtype=np.int64)
    some = np.isin(first, at)
    np.add.at(gone, first[some], 1)
    np.add.at(gone, end[some], -1)
    gone = np.cumsum(gone)[:-1] > 0
    starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return "".join(s for s, g in zip(_parts(text, place, ends), gone, strict=True) if not g), len(ends), int(gone.sum()), starts
