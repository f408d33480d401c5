"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A window of
words that the toxic dictionary compresses to fewer bytes than the ordinary one looks
toxic.  A document's score comes from how many of its windows gain so many bytes, by
thresholds and weights that are fitted on documents which the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import slices

#: Words of a window, and words from one window to the next.
WINDOW, STEP = 6, 3
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3
#: Labelled documents of each label that the model is fitted on, at most, and bytes of the texts of each.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 3 << 20
#: Bytes of a dictionary that holds ordinary text, and of what sets the two dictionaries apart.
BASE_BYTES, OWN_BYTES = 1 << 14, 1 << 12
#: Windows that the common part of the dictionaries is trained on, at most.
BASE_WINDOWS = 50_000
#: Sizes of the byte strings by which toxic passages are found, and the least excess of toxic documents among those that hold one, in standard deviations.
GRAMS, EXCESS = (5, 6, 7, 8), 5.0
#: Toxic texts that a passage needs to stand in.
LEAST_TEXTS = 3
#: Windows count by gains of so many bytes.
GAINS = np.arange(1, 7)
LEVEL = 3
#: Characters of a text that are cut into words at a time.
PART_CHARS = 1 << 20
_SPACE = re.compile(r"\s")
_MARKS = re.compile(r"[^\w\s]+")


def windows(text: str | None) -> Iterator[list[bytes]]:
    """The windows of a text, lower-cased, in lists of bounded size; a last one of fewer words included."""
    text, at = text or "", 0
    while at < len(text):
        cut = _SPACE.search(text, min(len(text), at + PART_CHARS))
        end = cut.start() if cut else len(text)
        words = text[at:end].lower().split()
        yield [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "surrogatepass") for i in range(0, max(len(words) - STEP, min(len(words), 1)), STEP)]
        at = end + 1


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content.rjust(8))
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of frequent passages; of too few samples for the trainer, their text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Gains:
    """Bytes that windows save under the toxic dictionary, summed up by text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def features(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """Shares of windows by gain, mean excess, highest gain, size; windows; and windows of two bytes or more."""
        n, excess, most = 0, 0, 0
        reached = np.zeros(len(GAINS))
        for part in windows(text):
            gain = np.fromiter((len(self.ordinary(w)) - len(self.toxic(w)) for w in part), dtype=np.int64, count=len(part))
            n += len(part)
            if len(part):
                reached += (gain[:, None] >= GAINS).sum(0)
                excess += int(np.maximum(gain - 1, 0).sum())
                most = max(most, int(gain.max()))
        return np.array([*reached / max(1, n), excess / max(1, n), most, np.log1p(n)]), n, int(reached[1])


def _words(text: str) -> set[str]:
    return set(_MARKS.sub(" ", text.lower()).split())


def _grams(word: str) -> set[bytes]:
    body = f" {word} ".encode("utf-8", "surrogatepass")
    return {body[i : i + size] for size in GRAMS for i in range(len(body) - size + 1)}


@dataclass
class Evidence:
    """In how many texts of each kind byte strings stand, and the words of the toxic ones."""

    texts: list[int]
    words: set[str]
    toxic: Counter
    ordinary: Counter

    @classmethod
    def of(cls, parts: list[list[tuple[str, int]]]) -> list[Evidence]:
        """Of each part of the rows (text, label).  Only strings of three toxic texts in all are looked for in ordinary ones."""
        found = [cls([0, 0], set(), Counter(), Counter()) for _ in parts]
        for one, rows in zip(found, parts, strict=True):
            for words in (_words(text) for text, label in rows if label):
                one.texts[1] += 1
                one.words |= words
                one.toxic.update(set().union(*map(_grams, words)))
        often = {g for g, n in sum((one.toxic for one in found), Counter()).items() if n >= LEAST_TEXTS}
        known: dict[str, list[bytes]] = {}
        for one, rows in zip(found, parts, strict=True):
            one.toxic = Counter({g: n for g, n in one.toxic.items() if g in often})
            for words in (_words(text) for text, label in rows if not label):
                one.texts[0] += 1
                for word in words - known.keys():
                    known[word] = list(_grams(word) & often)
                one.ordinary.update(set().union(*map(known.__getitem__, words)))
        return found

    def __add__(self, other: Evidence) -> Evidence:
        return Evidence([a + b for a, b in zip(self.texts, other.texts, strict=True)], self.words | other.words, self.toxic + other.toxic, self.ordinary + other.ordinary)

    def telling(self) -> dict[bytes, float]:
        """Byte strings that toxic texts hold more often than others do, with the excess in standard deviations."""
        others, mine = (max(1, n) for n in self.texts)
        found = {}
        for gram, n in self.toxic.items():
            if n >= LEAST_TEXTS:
                elsewhere = self.ordinary[gram]
                share = (n + elsewhere) / (mine + others)
                spread = (share * (1 - share) * (1 / mine + 1 / others)) ** 0.5
                excess = (n / mine - elsewhere / others) / max(spread, 1e-9)
                if excess >= EXCESS:
                    found[gram] = excess
        return found

    def passages(self) -> bytes:
        """The parts of words that telling byte strings cover, the most telling last and nearest to what is compressed."""
        telling, spans = self.telling(), {}
        for word in self.words:
            body = f" {word} ".encode("utf-8", "surrogatepass")
            hits = [(i, i + size) for size in GRAMS for i in range(len(body) - size + 1) if body[i : i + size] in telling]
            if not hits:
                continue
            covered = np.zeros(len(body) + 2, dtype=bool)
            for a, z in hits:
                covered[a + 1 : z + 1] = True
            for a, z in np.flatnonzero(np.diff(covered)).reshape(-1, 2):
                worth = sum(telling[body[i:j]] for i, j in hits if a <= i < z)
                spans[body[a:z]] = max(spans.get(body[a:z], 0.0), worth)
        chosen, size = [], 0
        for span, _ in sorted(spans.items(), key=lambda x: (-x[1], x[0])):
            if size + len(span) <= OWN_BYTES and not any(span in c for c in chosen):
                chosen.append(span)
                size += len(span)
        return b"".join(reversed(chosen))


def train_dictionaries(texts: list[str], evidence: Evidence) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, from ordinary texts and the evidence of both kinds.

    Both begin with the same passages of ordinary text.  The toxic one ends with what toxic
    texts say more often, the ordinary one with as much of other ordinary text.
    """
    plain = [w for text in texts for part in windows(text) for w in part[:: WINDOW // STEP]]
    plain = plain[:: -(-len(plain) // BASE_WINDOWS)] if plain else []
    base, own = _trained(plain, BASE_BYTES), evidence.passages()
    return base + own, base + b"".join(plain[: len(own)])[: len(own)]


@dataclass
class Model:
    """Dictionaries, and weights of the features."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + ((features - self.centre) / self.scale) @ self.weights[1:], -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], share: tuple[float, float] = (1.0, 1.0)) -> Model:
        """From (text, label); each label's rows are `share` of all there are.

        Weights are fitted on gains under dictionaries of the other half.  Rows of one label
        only, or none, give every text that label's share of rows, 0 of no rows.
        """
        rows = sorted(dict.fromkeys(rows), key=lambda row: row[1])
        halves = [rows[0::2], rows[1::2]]
        evidence = Evidence.of(halves)
        toxic, ordinary = train_dictionaries([text for text, label in rows if not label], evidence[0] + evidence[1])
        width = len(GAINS) + 3
        labels = np.array([label for _, label in rows])
        if len(set(labels)) < 2:
            return cls(toxic, ordinary, np.array([30.0 if len(labels) and labels[0] else -30.0, *np.zeros(width)]), np.zeros(width), np.ones(width))
        features = np.zeros((len(rows), width))
        for k in (0, 1):
            gains = Gains(*train_dictionaries([text for text, label in halves[1 - k] if not label], evidence[1 - k]))
            features[k::2] = [gains.features(text)[0] for text, _ in halves[k]]
        centre, scale = features.mean(0), np.maximum(features.std(0), 1e-6)
        x = np.concatenate([np.ones((len(rows), 1)), (features - centre) / scale], axis=1)
        many = np.where(labels == 1, 1 / share[1], 1 / share[0])
        many *= len(rows) / many.sum()
        weights, ridge = np.zeros(width + 1), np.diag([1e-3, *np.ones(width)])
        for _ in range(30):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (many * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (many * (labels - p)) - ridge @ weights)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(toxic, ordinary, weights, centre, scale)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the texts of docs (doc_id, text) that labels (doc_id, toxic) mark.

    Null ids, texts and labels don't count; a document that is marked both ways is toxic.
    It is fitted on about `sample_docs` documents of each label with `sample_bytes` of text,
    chosen by a hash of id and text; a text that alone is longer than that isn't chosen.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("_label"))
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_h"))
    usable = hashed.select("doc_id", "_h", F.octet_length("text").alias("_n")).join(marked, "doc_id")
    counts = dict(usable.groupBy("_label").count().collect())
    if not counts:
        return Model.fit([])
    span = 1_000_003
    wanted = F.lit(False)
    for label, n in counts.items():
        wanted |= (F.col("_label") == label) & (F.pmod("_h", F.lit(span)) < F.lit(min(span, span * sample_docs // n)))
    left, chosen = dict.fromkeys(counts, sample_bytes), {}
    for h, label, n in usable.where(wanted & (F.col("_n") <= sample_bytes)).select("_h", "_label", "_n").distinct().sort("_h").collect():
        left[label] -= n
        if left[label] >= 0:
            chosen[h] = label
    picked = docs.sparkSession.createDataFrame(list(chosen.items()), "_h long, _label int")
    rows = [(text, label) for label, text, _ in sorted(hashed.join(F.broadcast(picked), "_h").select("_label", "text", "_h").dropDuplicates(["_h"]).collect(), key=lambda r: (r["_h"], r["text"]))]
    got = Counter(label for _, label in rows)
    return Model.fit(rows, tuple(max(got[k], 1) / counts.get(k, 1) for k in (0, 1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_windows, n_toxic_windows) of every row of docs (doc_id, text), whatever its id.

    Null and empty texts have no window, and the score of a text in which none gains.
    Rows that repeat give equal rows; an empty table gives none; other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        gains = Gains(held.toxic, held.ordinary)
        for batch in slices(batches):
            found = [gains.features(text.as_py()) for text in batch.column(1)]
            scores = held.scores(np.array([f for f, _, _ in found]).reshape(len(found), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([k for _, _, k in found], pa.int64())], names=["doc_id", "score", "n_windows", "n_toxic_windows"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_windows long, n_toxic_windows long")


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows, n_toxic_windows) of every document; documents of fold 2 are held out of the fit."""
    model = train(docs.where(fold(F.col("doc_id")) != 2), labels, sample_docs)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "n_toxic_windows")
