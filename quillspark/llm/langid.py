"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of lower-cased words, each word between
boundary marks.  The models of all languages share sorted arrays of n-gram hashes, with
a column per language; a text's language is the one of lowest cross-entropy per letter.
A word scores the same wherever it stands, so a worker scores each new word once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytehash import mix
from quillspark.llm.common import slices

ORDER = 4
#: Documents of each language that a model is fitted on, about; with it the model's size is bounded.
SAMPLE_DOCS = 1000
#: Words whose scores a worker remembers, their letters in all, and letters scored at once.
MEMORY_WORDS, MEMORY_LETTERS, BLOCK_LETTERS = 400_000, 1 << 23, 1 << 17
#: A text is rejected beyond this multiple of the highest cross-entropy of its language's sample.
SLACK = 1.25
EDGE = "\x02"
UNKNOWN = "und"


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    value = np.zeros(len(codes), dtype=np.uint64)
    for i in range(codes.shape[1]):
        value = mix(value + codes[:, i].astype(np.uint64) + np.uint64(1))
    return value


def _table(rows: dict[str, dict[int, float]], width: int, langs: int, default: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of n-grams of one width, and their values by language; one more row holds the default."""
    grams = list(rows)
    values = np.full((len(grams) + 1, langs), default)
    for i, gram in enumerate(grams):
        for lang, value in rows[gram].items():
            values[i, lang] = value
    codes = np.array([[ord(c) for c in g] for g in grams], dtype=np.int64).reshape(len(grams), width)
    keys = _hash(codes)
    order = np.argsort(keys)
    return keys[order], np.concatenate([values[:-1][order], values[-1:]])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array; the place past its end for those not there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def letters(token: str) -> str:
    """A token's letters in lower case."""
    return "".join(filter(str.isalpha, token.lower()))


@dataclass
class Model:
    """Languages, and per order the discounted shares of n-grams and the weights of their contexts."""

    langs: list[str]
    shares: list[tuple[np.ndarray, np.ndarray]]
    weights: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limits: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]]) -> Model:
        """From counts (language, n-gram of the highest order, n) over words padded with edges."""
        langs = sorted({lang for lang, _, _ in counts})
        shares: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(ORDER)]
        weights: list[dict[str, dict[int, float]]] = [defaultdict(dict) for _ in range(ORDER)]
        floor = np.ones(len(langs))
        for i, lang in enumerate(langs):
            level = {gram: n for name, gram, n in counts if name == lang}
            for order in range(ORDER, 0, -1):
                once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
                discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
                total, kinds = Counter(), Counter()
                for gram, n in level.items():
                    total[gram[:-1]] += n
                    kinds[gram[:-1]] += 1
                for gram, n in level.items():
                    shares[order - 1][gram][i] = max(n - discount, 0) / total[gram[:-1]]
                for context, n in total.items():
                    weights[order - 1][context][i] = discount * kinds[context] / n
                if order > 1:
                    level = Counter(gram[1:] for gram in level)
                else:
                    floor[i] = 1 / (len(level) + 1)
        return cls(langs, [_table(t, k + 1, len(langs), 0.0) for k, t in enumerate(shares)], [_table(t, k, len(langs), 1.0) for k, t in enumerate(weights)], floor)

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits that each language spends on each word's letters and its end."""
        padded = [EDGE * (ORDER - 1) + w + EDGE for w in words]
        sizes = np.array([len(p) for p in padded])
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        every = np.flatnonzero(place >= ORDER - 1)
        owners = np.repeat(np.arange(len(words)), sizes)
        spent = np.zeros((len(words), len(self.langs)))
        for start in range(0, len(every), BLOCK_LETTERS):
            at = every[start : start + BLOCK_LETTERS]
            chance = np.tile(self.floor, (len(at), 1))
            for order in range(1, ORDER + 1):
                gram = codes[at[:, None] + np.arange(1 - order, 1)]
                (keys, share), (contexts, weight) = self.shares[order - 1], self.weights[order - 1]
                chance = share[_find(keys, _hash(gram))] + weight[_find(contexts, _hash(gram[:, :-1]))] * chance
            first = owners[at[0]]
            bits, owner = -np.log2(chance), owners[at] - first
            for i in range(len(self.langs)):
                sums = np.bincount(owner, bits[:, i])
                spent[first : first + len(sums), i] += sums
        return spent


class Scorer:
    """Cross-entropies of texts under a model; remembers words, within a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.table = np.zeros((1024, len(self.model.langs) + 1))

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > MEMORY_WORDS or self.letters > MEMORY_LETTERS:
            self.clear()
            new = list(tokens)
        plain = [letters(t) for t in new]
        rows = np.zeros((len(new), len(self.model.langs) + 1))
        real = [i for i, p in enumerate(plain) if p]
        for at in range(0, len(real), 4096):
            part = real[at : at + 4096]
            rows[part, :-1] = self.model.bits([plain[i] for i in part])
            rows[part, -1] = [len(plain[i]) + 1 for i in part]
        while len(self.table) < len(self.known) + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.letters += sum(map(len, new))
        start = len(self.known)
        self.table[start : start + len(new)] = rows
        self.known.update(zip(new, range(start, start + len(new)), strict=True))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Bits per letter by text and language; NaN for texts without letters."""
        split = [(t or "").split() for t in texts]
        self.learn({token for tokens in split for token in tokens})
        found = np.full((len(texts), len(self.model.langs)), np.nan)
        for i, tokens in enumerate(split):
            if tokens:
                total = self.table[np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))].sum(0)
                if total[-1]:
                    found[i] = total[:-1] / total[-1]
        return found


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of padded n-grams by language."""
    counts: Counter = Counter()
    for batch in slices(batches):
        words: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for token, n in Counter(text.split()).items():
                words[lang, letters(token)] += n
        for (lang, word), n in words.items():
            if word:
                padded = EDGE * (ORDER - 1) + word + EDGE
                for i in range(len(padded) - ORDER + 1):
                    counts[lang, padded[i : i + ORDER]] += n
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(counts.values(), pa.int64())], names=["lang", "gram", "n"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows (doc_id, text, lang); null texts and languages don't count.

    It is fitted on about `sample_docs` documents of each language, chosen by a hash of
    the text, so copies are chosen together and the choice doesn't depend on the order of rows.
    A language's rejection limit is SLACK times its sample's highest cross-entropy.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    chosen = usable.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(1_000_003 * sample_docs) / F.col("_n")).select("lang", "text")
    counts = chosen.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    model = Model.fit([tuple(r) for r in sorted(counts)])
    if model.langs:
        worst = score(chosen, model, keep=["lang"]).where("lang = lang_pred").groupBy("lang").agg(F.max("bits").alias("bits")).collect()
        model.limits = {lang: SLACK * bits for lang, bits in worst}
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns with lang_pred, score, bits and rejected.

    lang_pred is the language of lowest bits per letter, the first by name of equals, and
    `und` for texts that are null or have no letter (score 0, bits null, rejected).  score
    is that language's share when each loses a factor 16 per bit.  rejected: bits are over
    the language's limit.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    place = keep.index(text_col) if text_col in keep else len(keep)
    extra = [] if text_col in keep else [F.col(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs, limits = shared.value.langs, shared.value.limits
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            bits = scorer.entropies(texts) if langs else np.full((len(texts), 1), np.nan)
            sure = ~np.isnan(bits[:, 0])
            best = np.where(sure, np.argmin(np.where(np.isnan(bits), np.inf, bits), axis=1), 0)
            least = bits[np.arange(len(best)), best]
            share = np.where(sure, 1 / np.where(sure, np.exp2(4 * (least[:, None] - bits)).sum(1), 1), 0.0)
            names = [langs[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)]
            out = [bool(not s or x > limits.get(n, np.inf)) for s, x, n in zip(sure, least, names, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names), pa.array(share), pa.array([float(x) if s else None for x, s in zip(least, sure, strict=True)], pa.float64()), pa.array(out)],
                names=[*keep, "lang_pred", "score", "bits", "rejected"],
            )

    return docs.select(*keep, *extra).mapInArrow(run, f"{kinds}, lang_pred string, score double, bits double, rejected boolean")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids are in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, rejected) of every document.

    The model learns from the documents of folds 1 to 4 and predicts from the text alone.
    """
    held = fold(F.col("doc_id")) == 0
    model = train(docs.where(~held), sample_docs)
    return score(docs, model).withColumn("held_out", fold(F.col("doc_id")) == 0).select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs whose text is in one of the learned languages: not without letters, not beyond its language's limit.

    Null and empty texts go; rows that repeat, null ids and columns of any name stay as they are.
    """
    model = train(docs.where(fold(F.col("doc_id")) != 0), sample_docs)
    named = docs.toDF(*[f"_{i}_{c}" for i, c in enumerate(docs.columns)])
    scored = score(named, model, text_col=named.columns[docs.columns.index("text")], keep=named.columns)
    return scored.where(~F.col("rejected")).select(*[F.col(f"`{mine}`").alias(c) for mine, c in zip(named.columns, docs.columns, strict=True)])
