"""Toxicity, phrase collocations and source divergence against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import oracles, phrases
from quillspark.llm.divergence import _terms, divergence
from quillspark.llm.phrases import collocations, phrase_counts, shards
from quillspark.llm.queries import op11_toxicity, op12_phrases, op13_sources
from quillspark.llm.toxicity import Model, score, toxicity, train, windows

DOCS = "doc_id long, text string, lang string, source string, n long, l long, term string, phrase string, vector string, score string"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, text, lang, source, 7, 7, "t", "p", "v", "s") for i, (text, lang, source) in enumerate(rows)], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sample_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "été", "x-y", "“q”", "日本", "a" * 300, "rare%d"]
    line = lambda k: "".join((w % rng.randrange(10**6) if "%" in w else w) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?"]) for w in rng.choices(words, k=k))
    rows = [(line(rng.randrange(40)), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "s3", None, "é"])) for _ in range(n)]
    return [*rows, (None, "en", "s1"), ("", None, None), (" \t.. ", "en", "s9"), (None, "zz", "s1"), (None, "zz", "s2"), *[("New york city", "en", "s1")] * 40, (line(3000), "en", "s2")]


def brute_counts(rows, longest=4):
    counts, words = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts, words


def brute_phrases(rows, least=30, listed=2000):
    counts, words = brute_counts(rows)
    for lang, found in counts.items():
        frequent = {p.split(" ").__len__() and p: n for p, n in found.items() if n >= least}
        result = []
        for phrase, a in frequent.items():
            w = phrase.split(" ")
            if len(w) < 2 or any(100 * n >= 80 * a for other, n in frequent.items() if len(other.split(" ")) > len(w) and f" {phrase} " in f" {other} "):
                continue
            cut = min((2000000 * a // ((l := found[" ".join(w[:k])]) + (r := found[" ".join(w[k:])])), k, l, r) for k in range(1, len(w)))
            result.append((-cut[0], -a, phrase.encode(), cut[2], cut[3]))
        for i, (s, a, phrase, l, r) in enumerate(sorted(result)[:listed]):  # noqa: E741
            yield lang, i + 1, phrase.decode(), -a, l, r, words[lang], -s


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    rows = sample_rows(seed)
    expected = sorted(brute_phrases(rows))
    assert len(expected) > 5
    assert sorted(map(tuple, collocations(docs(spark, rows)).collect())) == expected
    assert sorted(map(tuple, collocations(docs(spark, rows), reported=3).collect())) == [r for r in expected if r[1] <= 3]


def test_collocations_with_a_full_map(spark):
    """A bitmap so small that it leaves nothing out changes no count."""
    rows = sample_rows(3)
    assert sorted(map(tuple, collocations(docs(spark, rows), bits=1 << 3).collect())) == sorted(brute_phrases(rows))


def test_no_collocations(spark):
    assert collocations(docs(spark, [])).collect() == []
    assert collocations(docs(spark, [(None, None, None), ("", "en", "s")])).collect() == []
    with pytest.raises(ValueError, match="2 to 4"):
        phrase_counts(docs(spark, []), longest=5)


@pytest.mark.parametrize("limit", [1, 7, 60, 10**6])
def test_shards_cut_long_texts(limit):
    texts = [(t or "").encode() for t, _, _ in sample_rows(4, 40)]
    found = Counter()
    for shard in shards(texts, limit):
        order, shared = shard.suffixes(4)
        for k in range(1, 5):
            places, n = shard.phrases(order, shared, shard.sizes(4), k)
            found.update(dict(zip((p.decode() for p in shard.texts(places, k).to_pylist()), n.tolist(), strict=True)))
    assert found == sum(brute_counts([(t.decode(), "en", None) for t in texts])[0].values(), Counter())


def test_suffixes_are_in_order():
    rng = random.Random(5)
    shard = phrases.Shard([rng.choice([b"a", b"b", b"c", b"."]) for _ in range(500)])
    order, shared = shard.suffixes(4)
    first = [tuple([*shard.ids[i : i + 4], 0, 0, 0][:4]) for i in order]
    assert first == sorted(first) and sorted(order) == list(range(len(shard.ids)))
    for (x, y), k in zip(pairwise(first), shared[1:], strict=True):
        assert k == next((j for j in range(4) if x[j] != y[j]), 4)


def by_sql(spark, rows, sql):
    found = duckdb.connect()
    found.register("documents", docs(spark, rows).select("doc_id", "text", "lang", "source").toPandas())
    return sorted(found.execute(sql).fetchall(), key=repr)


def brute_divergence(rows):
    held = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for text, lang, source in rows]
    held = [(a, b, [lowered(t) for t in terms]) for a, b, terms in held]
    for lang in {a for a, _, _ in held}:
        mine = [(b, terms) for a, b, terms in held if a == lang]
        df = Counter(t for _, terms in mine for t in set(terms))
        kept = {t for t, n in df.items() if n >= 30}
        counts = defaultdict(Counter)
        for b, terms in mine:
            counts[b].update(t for t in terms if t in kept)
        total = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(-sum(abs(p(c, t) - p(d, t)) for t in kept), o.encode()) for o, d in counts.items() if o != s]
            terms = [(p(total, t) - p(c, t), t.encode()) for t in kept if c[t] and p(c, t) > p(total, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                yield from ((lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found))


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence(spark, seed):
    rows = sample_rows(seed)
    expected = sorted(brute_divergence(rows))
    assert {"pair", "term"} == {r[2] for r in expected} and any(r[0] == "zz" and r[4] == 0 for r in expected)
    found = divergence(docs(spark, rows))
    assert sorted(map(tuple, found.collect())) == expected
    assert dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, divergence(docs(spark, rows), listed=1).where("part = 'term'").collect())) == [r for r in expected if r[2] == "term" and r[5] == 1]


def test_no_divergence(spark):
    assert divergence(docs(spark, [])).collect() == []
    assert sorted(map(tuple, divergence(docs(spark, [(None, None, None), ("", None, "b")])).collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab cd" * 50 + " été été " * 40
    whole = _terms(text.encode())
    monkeypatch.setattr("quillspark.llm.divergence.PART_BYTES", 3)
    assert _terms(text.encode()) == whole and whole["été".encode()] == 80


def test_mining_queries_equal_sql(spark, sf):
    found = duckdb.connect()
    found.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for query, sql in ((op12_phrases, oracles.OP12), (op13_sources, oracles.OP13)):
        assert sorted(map(tuple, query(spark, sf).collect())) == sorted(found.execute(sql).fetchall())


INSULTS = ["blockhead", "numbskull", "dimwit"]


def toxic_rows(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("kel min tas rov ued") for _ in range(rng.randrange(2, 9))).replace(" ", "") + "a" for _ in range(400)]
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randrange(30, 200)), i % 4 == 0
        for _ in range(len(words) // 25 + 1 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        yield " ".join(words), int(toxic)


def test_toxic_windows_are_found():
    model = Model.fit(list(toxic_rows(1, 400)))
    assert all(w.encode()[:6] in model.toxic and w.encode() not in model.ordinary for w in INSULTS)
    held = list(toxic_rows(2, 200))
    from quillspark.llm.toxicity import Gains

    gains = Gains(model.toxic, model.ordinary)
    scores = model.scores(np.array([gains.features(t)[0] for t, _ in held]))
    right = np.mean([(s >= 0.3) == y for s, (_, y) in zip(scores, held, strict=True)])
    assert right > 0.9
    assert ((scores >= 0) & (scores <= 1)).all()


def test_windows_hold_every_word():
    for text in ("", None, " \n", "one", "A b c d", " ".join(map(str, range(50))), "x" * 5000):
        found = [w for part in windows(text) for w in part]
        assert set(b" ".join(found).split()) == {w.encode() for w in (text or "").lower().split()}


def test_long_texts_have_all_windows(monkeypatch):
    text = " ".join(map(str, range(500)))
    monkeypatch.setattr("quillspark.llm.toxicity.PART_CHARS", 40)
    assert set(b" ".join(w for part in windows(text) for w in part).split()) == {str(i).encode() for i in range(500)}


def test_toxicity_of_odd_tables(spark):
    rows = [None, "", "a calm text", "a calm text", "x" * 100_000]
    table = docs(spark, [(t, "en", "s") for t in rows]).withColumn("doc_id", F.when(F.col("doc_id") < 4, F.col("doc_id")))
    labels = spark.createDataFrame([(0, 1, 1), (None, 1, 1), (2, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity(table, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, None)]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert toxicity(table.limit(0), labels).collect() == []
    assert [r["predicted"] for r in score(table, train(table, labels.limit(0))).select((F.col("score") >= 0.3).cast("int").alias("predicted")).collect()] == [0] * 5


def test_a_sample_is_bounded_and_needs_no_order(spark):
    rows = list(toxic_rows(3, 200))
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    one, two = (train(t, labels, sample_docs=30, sample_bytes=20_000) for t in (table, table.orderBy(F.desc("doc_id")).repartition(3)))
    assert one.toxic == two.toxic and one.ordinary == two.ordinary and np.allclose(one.weights, two.weights)


def test_held_out_toxicity(spark, sf):
    found = {r["doc_id"]: r for r in op11_toxicity(spark, sf).collect()}
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(found) == documents
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    right = [found[i]["predicted"] == y for i, y in labels.items() if i in found]
    assert np.mean(right) > 0.85
