"""Suffix, sentence-span and SimHash dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm import simhash
from quillspark.llm.queries import op7_sentence_spans, op8_simhash
from quillspark.llm.sentences import drop_repeated_sentences, span_hashes, split_sentences
from quillspark.llm.simhash import fingerprint, fuzzy_links, near_duplicates, one_of_each, prefix_pairs, shingle_hashes
from quillspark.llm.suffixes import remove_repeats

DOCS = "doc_id long, text string, spans string, kept string, id long, component_id string, fp string"


def docs(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 7, "c", "f") for i, t in enumerate(texts)], DOCS)


def brute_repeats(texts, depth):
    seen = Counter(b[p : p + depth] for b in texts for p in range(len(b) - depth + 1))
    for b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if seen[b[p : p + depth]] > 1:
                gone[p : p + depth] = [True] * depth
        yield gone


def random_texts(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, long = line(260), line(5000)
    return [None, "", "short", line(300), "x" + shared + "y", shared, "aa" * 150, long, long + "z", long[:2000] + line(40) + long[2000:], *[shared + "!"] * 40, line(199), line(200)]


@pytest.mark.parametrize("depth", [200, 60])
def test_remove_repeats(spark, depth):
    texts = random_texts(depth)
    bodies = [(t or "").encode() for t in texts]
    found = {r["id"]: r for r in remove_repeats(docs(spark, texts), depth=depth).collect()}
    assert sorted(found) == list(range(len(texts)))
    for i, gone in enumerate(brute_repeats(bodies, depth)):
        kept = bytes(c for c, g in zip(bodies[i], gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        assert (found[i]["n_bytes"], bytes(found[i]["kept"]), len(found[i]["spans"] or [])) == (len(bodies[i]), kept, runs), i


def brute_spans(texts):
    seen = set()
    for text in texts:
        sentences = split_sentences(text or "")
        words = [s.split() for s in sentences]
        gone = set()
        for a in range(len(words)):
            z, n = a, 0
            while z < len(words) and (z - a < 3 or n < 25):
                n += len(words[z])
                z += 1
            if z - a < 3 or n < 25:
                continue
            key = tuple(" ".join(w) for w in words[a:z])
            gone |= set(range(a, z)) if key in seen else set()
            seen.add(key)
        yield text and "".join(s for i, s in enumerate(sentences) if i not in gone), len(gone)


def passage(rng, words):
    return "".join(rng.choice("kelo minu ta") + rng.choice(["sa ", "re ", "tu. ", "no, "]) for _ in range(words))


def test_sentence_spans(spark):
    rng = random.Random(3)
    shared = ". " + passage(rng, 90) + ". "
    texts = [None, "", "one. two. three.", passage(rng, 50) + shared, passage(rng, 60) + shared + passage(rng, 50), *[shared] * 12, shared + shared, "word " * 3000, "word " * 3000]
    found = {r["doc_id"]: r for r in drop_repeated_sentences(docs(spark, texts)).collect()}
    for i, (left, n) in enumerate(brute_spans(texts)):
        assert (found[i]["text"], found[i]["n_removed"], found[i]["kept"]) == (left, n, "y"), i
    assert all("".join(split_sentences(t)) == t for t in texts if t)
    assert len(span_hashes("a. b.")[0]) == 0


def test_sentence_query_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: (left, n) for r, (left, n) in zip(rows, brute_spans([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in op7_sentence_spans(spark, sf).collect()} == want


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_simhash_query_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    want = brute_components(prints)
    found = op8_simhash(spark, sf).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found} == {i: (prints[i], want[i]) for i in prints}
    assert all(len(r["fingerprint"]) == 16 for r in found)


def test_fuzzy_links_find_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {*base}
    for f in base:
        for n in (1, 2, 3, 4):
            for _ in range(4):
                prints.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(prints))]
    whole = sorted(prints)
    want = {(i, j) for i in range(len(whole)) for j in range(i + 1, len(whole)) if (whole[i] ^ whole[j]).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in fuzzy_links(spark.createDataFrame(signed, "id long, fp long")).collect()} == want


def test_simhash_edges(spark):
    texts = [None, "", " \t\n", "One two", "one TWO", "a b c d", " x", "É é"]
    found = {r["id"]: r for r in near_duplicates(docs(spark, texts)).collect()}
    assert [found[i]["component_id"] for i in range(5)] == [0, 0, 0, 3, 3]
    assert all(found[i]["fp"] % (1 << 64) == brute_fingerprint(t) for i, t in enumerate(texts))
    assert fingerprint("a\x1cb") % (1 << 64) == brute_fingerprint("a\x1cb")
    kept = one_of_each(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert {0, 3} <= {r["doc_id"] for r in kept.collect()}


def test_no_rows(spark):
    none = docs(spark, ["x"]).where(F.lit(False))
    assert remove_repeats(none).count() == drop_repeated_sentences(none).count() == near_duplicates(none).count() == one_of_each(none).count() == 0


def test_kept_digest_of_plain_text(spark):
    row = remove_repeats(docs(spark, ["plain"])).select(F.sha2("kept", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"plain").hexdigest()


def test_sentence_spans_within_a_text_and_of_null_ids(spark):
    from quillspark.llm.sentences import drop_repeated_sentences

    passage = " ".join(f"Sentence number {n} says something of its own kind." for n in range(6)) + " "
    docs = spark.createDataFrame([(None, passage), (1, "Short. "), (2, passage + passage), (3, passage), (4, None)], "doc_id long, text string")
    left = {r["doc_id"]: (r["text"], r["n_removed"]) for r in drop_repeated_sentences(docs).collect()}
    assert left[None] == (passage, 0) and left[1] == ("Short. ", 0) and left[4] == (None, 0)
    assert left[2][0].startswith(passage) and left[2][1] > 0 and left[3] == ("", len(split_sentences(passage)))


def brute_jaccard_components(texts):
    held = []
    for text in texts:
        words = text.lower().split()
        held.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    top = list(range(len(held)))
    for j, y in enumerate(held):
        for i, x in enumerate(held[:j]):
            if top[i] != top[j] and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    return top


def test_one_of_each_finds_near_copies_of_five_word_sets(spark, sf):
    """Planted copies at 0.8 to 0.95, one repeated line with different tails, and the whole table, against brute force."""
    rng = random.Random(8)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(words))
        for at in rng.sample(range(10, len(words) - 10), max(1, len(words) // 55)):
            words[at] = "changed"
        texts.append(" ".join(words))
    line = "the same line of nine words again and again "
    texts += [line * 60 + " ".join(f"t{i}x{k}" for k in range(40)) for i in range(5)]
    top = brute_jaccard_components(texts)
    assert len(set(top[-125:-5])) <= 70
    kept = {r["doc_id"] for r in one_of_each(docs(spark, texts)).select("doc_id").collect()}
    assert kept == set(top)


def test_sentence_spans_of_passages_at_any_offset(spark):
    """Passages of 51 to 60 words in clauses of 26 to 40, pasted in the middle of sentences; and a script without spaces."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n: "".join(word() + (". " if rng.random() < 0.03 else " ") for _ in range(n))
    found = 0
    for _ in range(400):
        passage = prose(rng.randint(51, 60))
        left, right = (set(span_hashes(prose(rng.randint(20, 90)) + passage + prose(rng.randint(20, 90)))[0].tolist()) for _ in range(2))
        found += bool(left & right)
    assert found >= 0.96 * 400
    parts = split_sentences("一二三。四五！六")
    assert "".join(parts) == "一二三。四五！六" and not any(sign in "。！" for part in parts for sign in part[:-1])
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    shared = signs(120)
    rows = [(i, signs(40) + shared + signs(40)) for i in range(2)]
    left = {r["doc_id"]: r["text"] for r in drop_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[0] == rows[0][1] and len(left[1]) < 140 and left[1].startswith(rows[1][1][:20])


def test_one_of_each_keeps_rows_of_null_ids(spark):
    rows = [(None, "a text of its own that nobody else has"), (None, None), (3, "one two three four five six"), (4, "one two three four five six")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows[:3], key=str)


def test_prefix_pairs_holds_every_similar_pair_and_no_group_of_a_shared_passage(spark):
    """Texts around one passage: all pairs share it, only those with few other words are similar."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 2, 5, 40, 60]))] + passage + [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 3, 30]))]) for _ in range(150)]
    texts += [texts[7] + " more", "", None, "few words"]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)] + [(0, 0, texts[0])], "id long, c long, text string")
    found = {(r["a"], r["b"]) for r in prefix_pairs(rows, 5, 0.8).collect()}
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near and near <= found
    assert len(found) <= 2 * len(near)


def planned(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def test_links_are_joined_without_a_broadcast(spark):
    points = spark.range(2000).selectExpr("id", "xxhash64(id) AS fp")
    assert "Broadcast" not in planned(fuzzy_links(points))


def test_near_copies_are_joined_without_a_broadcast(spark, sf, monkeypatch):
    plans = []

    def kept(frame):
        plans.append(planned(frame))
        return frame

    monkeypatch.setattr(simhash, "settle", kept)
    monkeypatch.setattr(simhash, "components", lambda edges: edges.selectExpr("b AS node", "a AS component"))
    held = spark.read.parquet(f"{sf}/documents.parquet")
    plans += [planned(near_duplicates(held)), planned(one_of_each(held))]
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
