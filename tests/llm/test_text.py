"""Decontamination, packing, media, language, chat, pages and URL rules against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import media
from quillspark.llm.chatformat import escape, format_conversations, read_back, unescape
from quillspark.llm.common import with_membership
from quillspark.llm.decontaminate import contamination
from quillspark.llm.langid import Model, identify, keep_identified
from quillspark.llm.packing import best_completion, pack, plan_sequences, token_pieces
from quillspark.llm.pagediff import AROUND, aligned, extract, neighbours, outlines, text_lines
from quillspark.llm.queries import QUERIES, URL_RULES
from quillspark.llm.urlrules import judge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items):
    for text in texts:
        said, hit, found = words(text), set(), set()
        for item_id, item in items:
            want = words(item)
            size = min(13, len(want))
            wins = {tuple(want[i : i + size]) for i in range(len(want) - size + 1)} if want else set()
            for p in range(len(said) - size + 1) if wins else ():
                if tuple(said[p : p + size]) in wins:
                    hit |= set(range(p, p + size))
                    found.add(str(item_id))
        yield len(said), len(hit), sorted(found)


def test_contamination(spark):
    rng = random.Random(1)
    some = [f"w{rng.randrange(40)}" for _ in range(400)]
    items = [(1, " ".join(some[:30])), (2, "tiny Item"), (3, None), (4, "..."), (11, " ".join(some[100:113])), (12, " ".join(some[:30])), (13, "a a a a a a a a a a a a a a")]
    texts = [None, "", "TINY  item!tiny-item", " ".join(some), "x " + " ".join(some[5:20]).upper(), " ".join(some[101:113]), "a " * 40, "naïve tiny item", *[" ".join(some[2:28])] * 30]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, item string, pos int")
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, term string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, bench).collect()}
    assert found == dict(enumerate(brute_hits(texts, items)))
    assert contamination(docs.where("false"), bench).count() == 0
    assert {r["n_hit"] for r in contamination(docs, bench.where("false")).collect()} == {0}


def test_pieces_have_the_tokenizers_ids(spark, sf):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [None, "", " ", "don't  stop\n\n\tnow ", "naïve Ελλάδα 漢字 🎉 x²", "a\x1cb _under_ 12ab", "<|endoftext|> tail", "a <|endoftext|><|endoftext|>  b 漢<|endoftext|>", "w " * 5000]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = defaultdict(list)
    for r in token_pieces(docs).collect():
        held[r["doc_id"]].append(r)
    for doc_id, text in rows:
        pieces = sorted(held[doc_id], key=lambda r: r["piece"])
        want = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == want, doc_id
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces[:-1]]]).tolist()
        assert all(p["length"] == 2048 for p in pieces[1:]) and (len(pieces) == 1 or len(want) > 2048)


def test_packing_is_gapless_and_tight(spark, sf):
    rows = QUERIES["op2_packing"](spark, sf).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        cut = (len(ids) - 1) % 2048 + 1
        for k, (a, b) in enumerate(zip([0, *range(cut, len(ids), 2048)], range(cut, len(ids) + 1, 2048), strict=True)):
            p = pieces[r["doc_id"], k]
            assert (p["start"], p["length"], p["ids_crc32"]) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    total = sum(r["length"] for r in rows)
    assert len(by) <= 1.02 * -(-total // 2048) + 1
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_best_completion_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted(rng.sample(range(2, 40), 6))
        counts = [0] * 41
        for s in sizes:
            counts[s] = rng.randint(1, 2)
        room = rng.randint(10, 40)
        reach = {0}
        for s in sizes:
            for _ in range(counts[s]):
                reach |= {r + s for r in reach if r + s <= room}
        assert sum(best_completion(counts, sizes, room)) == max(reach)
    assert plan_sequences({}) == []
    with pytest.raises(ValueError):
        plan_sequences({3000: 1})


def test_pack_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, offset int")
    assert pack(token_pieces(none)).count() == 0
    some = spark.createDataFrame([(i, 900, "a", 7) for i in (1, 1, None, 2)], "doc_id long, length int, text string, offset int")
    assert sorted((r["sequence_id"], r["offset"], r["text"]) for r in pack(some).collect()) == [(0, 0, "a"), (0, 900, "a"), (1, 0, "a"), (1, 900, "a")]


def test_media_round_trips():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (6, 9, 3), np.uint8)
    for image in (grey, colour):
        assert (media.decode(media.encode_netpbm(image)) == image).all()
        assert (media.from_npy(media.to_npy(image)) == image).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert media.decode(b"P2 # note\n2 1 255\n0 9").tolist() == [[0, 9]]
    assert media.decode(b"P1\n2 1\n0 1").tolist() == [[255, 0]]
    block = media.area_resize(np.repeat(np.repeat(grey, 4, 0), 4, 1).astype(float), 7, 5)
    assert np.allclose(block, grey)


def test_media_of_odd_files(spark):
    """Malformed, empty, null and repeated media give a row each; tall images are summed in blocks."""
    palette = media.encode_bmp(np.zeros((1, 1), np.uint8))[:14] + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 8, 0, 0, 0, 0, 2, 0) + bytes(8) + bytes([0, 9, 0, 0])
    palette = palette[:10] + struct.pack("<I", 62) + palette[14:]
    good = media.encode_netpbm(np.arange(12, dtype=np.uint8).reshape(3, 4))
    odd = [None, b"", b"P5", b"P5\n0 0\n255\n", b"P5 9 9 255 x", b"P2 1 1 255 z", b"BM", palette, b"P2 1 1 255 999999999999999999999999"]
    rows = [(i, x, "c", 1) for i, x in enumerate([*odd, good, good])]
    found = {r["id"]: r for r in media.media_tiles(spark.createDataFrame(rows, "key long, media binary, npy string, id int"), "key", "media", (2, 2)).collect()}
    assert len(found) == len(rows) and all(found[i]["npy"] is None and found[i]["dhash"] is None for i in range(len(odd)))
    assert found[9]["npy"] == found[10]["npy"] and media.from_npy(found[9]["npy"]).shape == (2, 2) and found[9]["height"] == 2
    assert media.media_tiles(spark.createDataFrame([], "key long, media binary"), "key", "media").count() == 0
    rng = np.random.default_rng(5)
    tall = rng.integers(0, 256, (4001, 576), np.uint8)
    whole = media.area_resize(tall, 8, 9)
    for i, j in ((0, 0), (3, 4), (7, 8)):
        y0, y1, x0, x1 = i * 4001 / 8, (i + 1) * 4001 / 8, j * 64, (j + 1) * 64
        weights = np.clip(np.minimum(np.arange(1, 4002), y1) - np.maximum(np.arange(4001), y0), 0, 1)
        assert abs(whole[i, j] - (weights @ tall[:, x0:x1]).sum() / (weights.sum() * 64)) < 1e-6


def test_media_query(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    features = defaultdict(set)
    for r in QUERIES["op3_media"](spark, sf).collect():
        data = texts[r["doc_id"]]
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        npy = io.BytesIO()
        np.save(npy, np.frombuffer(payload, np.uint8).reshape(-1, 576))
        assert (r["media_bytes"], r["media_sha256"]) == (len(npy.getvalue()), hashlib.sha256(npy.getvalue()).hexdigest())
        features[data].add((r["media_sha256"], r["feature"]))
    assert all(len(f) == 1 for f in features.values())


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = identify(docs).collect()
    held = [r for r in found if r["held_out"] and truth[r["doc_id"]]]
    assert len(found) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    odd = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate([None, "", "12 !!", "x"])], docs.schema))
    tail = {r["doc_id"]: r for r in identify(odd).where("doc_id >= 1000000").collect()}
    assert [tail[10**6 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in [*tail.values(), *found])
    assert keep_identified(odd).where("doc_id in (1000000, 1000001, 1000002)").count() == 0
    assert identify(docs.where("false")).count() == keep_identified(docs.where("false")).count() == 0


def test_language_model_is_interpolated_kneser_ney(spark):
    """Bits of words against the formula worked out plainly, and texts of one very long word."""
    counts = [("a", g, n) for g, n in (("\x02\x02\x02x", 3), ("\x02\x02xy", 2), ("\x02xyx", 1), ("xyx\x02", 1), ("\x02xy\x02", 1), ("yxyx", 2))]
    model = Model.fit([*counts, ("b", "\x02\x02\x02z", 1)])
    levels, level = {}, {g: n for _, g, n in counts}
    for order in range(4, 0, -1):
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        levels[order] = (dict(level), min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95))
        level = Counter(g[1:] for g in level)

    def chance(context, letter):
        order = len(context) + 1
        held, discount = levels[order]
        lower = chance(context[1:], letter) if context else 1 / (len(levels[1][0]) + 1)
        total = sum(n for g, n in held.items() if g[:-1] == context)
        if not total:
            return lower
        kinds = sum(g[:-1] == context for g in held)
        return max(held.get(context + letter, 0) - discount, 0) / total + discount * kinds / total * lower

    for word in ("xyx", "yz", "x" * 9):
        padded = "\x02" * 3 + word + "\x02"
        want = -sum(np.log2(chance(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
        assert abs(model.bits([word])[0, 0] - want) < 1e-9
    long = "xyxzyx" * 60_000
    pair = model.bits(["ab", long, "yx"])
    assert np.allclose(pair[0], model.bits(["ab"])[0]) and np.allclose(pair[2], model.bits(["yx"])[0]) and pair[1, 0] > 1000


def test_language_rejects_what_it_does_not_know(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(3)
    strange = [" ".join("".join(rng.choice("qxzwkjvв") for _ in range(rng.randrange(4, 9))) for _ in range(40)), "漢字 " * 30, "漢" * 3000]
    odd = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate(strange * 2)], docs.schema)).withColumn("bits", F.lit("c"))
    kept = {r["doc_id"] for r in keep_identified(odd).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**6]
    clean = {r["doc_id"] for r in docs.where("lang IS NOT NULL").collect()}
    assert len(clean & kept) >= 0.99 * len(clean)


def test_chat(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by[conv].append((turn, role or "", text or ""))
    for r in QUERIES["op9_chat"](spark, sf).collect():
        turns = sorted(by.pop(r["conv_id"]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not by


def test_chat_edges(spark):
    for text in ["", "<|im_end|>", "<\\|x", "<\\\\|", "\\<|", "<<||"]:
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    rows = [(1, 0, "user", None, True), (1, 1, None, "x", True), (None, None, "a\n<b", "<|im_start|>", False)]
    found = read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid boolean"))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["valid"]) for r in found} == {1: (2, False), None: (1, False)}
    assert read_back(format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def page(menu, body):
    return f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav>{menu}</nav><div>{menu}</div>{body}<footer>foot</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "http://a.org/x/1", page("Home | News", "<p>First&nbsp;text &amp; more.</p><p>Second   one.</p>")),
        (2, "http://a.org/x/2", page("Home | News", "<p>Other things.</p>")),
        (3, None, None),
        (4, "no url", ""),
        (5, "http://b.org/", "<article><p>Alone &#233;.</p></article><div class='comments'>me too</div>"),
    ]
    pages = spark.createDataFrame([(*r, "c", 3) for r in rows], "page_id long, url string, html string, partner string, text int")
    found = {r["page_id"]: r for r in extract(pages).collect()}
    assert [found[i]["text"] for i in range(1, 6)] == ["First text & more.\n\nSecond one.", "Other things.", "", "", "Alone é."]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert extract(pages.where("false")).count() == 0


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("xyzwab") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = aligned(a, b)
        assert len(found) == table[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < n for (i, j), (k, n) in zip(found, found[1:], strict=False))


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest, re.DOTALL).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


def test_url_rules(spark):
    rng = random.Random(6)
    rules = [*URL_RULES, ("a.com", "", "block"), ("b.a.com", "/x", "allow"), ("a.com", "/x", "block"), ("a.com", "/xy", "allow")]
    urls = [None, "", "no", "http://", "HTTP://EXAMPLE.org/es/?q", "http://xexample.org/es/", "http://a.com?x=/x", "http://é.org/ü#f"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'b.', 'c.b.', 'W.'])}{rng.choice(['a.com', 'example.org', 'com', 'net'])}{rng.choice(['', '/'])}{rng.choice(['', 'x', 'xy', 'es/', 'en/1', 'fr/', 'de/'])}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert found == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert judge(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = docs
        docs = spark.createDataFrame(stage(spark, held, sf).toPandas(), held.schema)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids, name
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            rows = held.collect()
            hits = brute_hits([r["text"] for r in rows], items)
            assert left == {r["doc_id"] for r, (n, hit, _) in zip(rows, hits, strict=True) if not (hit and 20 * hit >= n)}
        ids = left
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.where(F.col("offset") + F.col("length") > 2048).count() == 0


def test_packing_of_many_empty_documents(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = pack(token_pieces(docs)).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(rows) == len(places) == 5000 and all(r["length"] == 1 for r in rows)
    assert places == {(s, o) for s in range(3) for o in range(2048 if s < 2 else 5000 - 4096)}


def test_plans_go_back_over_sequences():
    def need(histogram, capacity):
        plan = plan_sequences(histogram, capacity)
        used = defaultdict(int)
        for pattern, times in plan:
            assert sum(pattern) <= capacity
            for s in pattern:
                used[s] += times
        assert used == histogram
        return sum(times for _, times in plan)

    def least(lengths, bins, capacity):
        if not lengths:
            return len(bins)
        fits = {b for b in bins if b >= lengths[0]} | {capacity}
        found = []
        for b in fits:
            left = list(bins)
            if b in left:
                left.remove(b)
            found.append(least(lengths[1:], [*left, b - lengths[0]], capacity))
        return min(found)

    rng = random.Random(11)
    for _ in range(150):
        lengths = sorted((rng.randint(2, 14) for _ in range(8)), reverse=True)
        histogram = {s: lengths.count(s) for s in lengths}
        assert need(histogram, 20) == least(lengths, [], 20), lengths
    planted = {15: 2, 10: 2, 7: 1, 8: 1, 13: 5, 16: 3, 11: 2, 6: 1, 18: 1, 14: 1, 5: 2, 20: 1, 12: 1}
    assert need(planted, 40) == 7


def article(*lines):
    return "<main>" + "".join(x if x.startswith("<") else f"<p>{x}</p>" for x in lines) + "</main>"


LONG = [f"Paragraph {i} is told at some length and on its own page, {'so it goes on ' * 6}." for i in range(30)]


def test_pages_lose_template_lines_within_articles(spark):
    rows = [(i, f"http://a.org/x/{i}", article(f"Title {i}", LONG[i], "Subscribe now", LONG[20], LONG[i + 8])) for i in range(2 * AROUND + 1)]
    rows += [(90, "http://a.org/x/1", article("Title 90", LONG[3], "Subscribe now", LONG[20], LONG[4]))]
    rows += [(100 + i, f"http://b.org/x/{i}", article("One title", LONG[5 + i], "<div>Share this</div>", "Les.", LONG[20])) for i in range(2)]
    rows += [(200, None, article("Alone")), (201, "http://c.org/", article("Alone", "<div>Share this</div>"))]
    found = {r["page_id"]: r["text"].split("\n\n") for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    middle = AROUND
    for i in range(2 * AROUND + 1):
        notice = [] if i == middle else ["Subscribe now"]
        assert found[i] == [f"Title {i}", LONG[i], *notice, LONG[20], LONG[i + 8]]
    assert found[90] == ["Title 90", LONG[3], "Subscribe now", LONG[20], LONG[4]]
    assert all(found[100 + i] == ["One title", LONG[5 + i], "Les.", LONG[20]] for i in range(2))
    assert found[200] == ["Alone"] and found[201] == ["Alone", "Share this"]


def test_extracted_pages_do_not_rest_on_article_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|main)", "<$1div"))
    whole = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert {r["page_id"]: r["text"] for r in extract(bare).collect()} == whole
    lines = {r["page_id"]: [x.text for x in text_lines(r["html"]) if x.zone == 2] for r in pages.collect()}
    assert whole == {i: "\n\n".join(x) for i, x in lines.items()}


def test_neighbours_of_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.col("page_id").alias("id"), "url", "html")
    rows = outlines(pages).groupBy("url").agg(F.min(F.struct("id", "marks")).alias("f")).select("url", "f.*")
    held = sorted((*brute_rule(r["url"], [])[:2], r["id"], r["url"]) for r in rows.collect())

    def shares(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = {}
    for k, (host, path, _, url) in enumerate(held):
        before, after = ([held[j] for j in js if 0 <= j < len(held) and held[j][0] == host] for js in (range(k - AROUND, k), range(k + 1, k + 1 + AROUND)))
        near = sorted([*before[-1:], *after[:1]], key=lambda x: -shares(path, x[1]))
        want[url] = (near[0][3] if near else None, [x[3] for x in before + after])
    for partitions in ("3", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found = {r["url"]: (r["partner"]["url"] if r["partner"] else None, [x["url"] for x in r["around"]]) for r in neighbours(rows).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert found == want


def test_membership_has_no_false_negatives(spark):
    keys = [f"k{i}" for i in range(500)]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    held = rows.where("k IS NULL OR k LIKE '%7'")
    for bits, most in ((1 << 27, 50), (64, 500)):
        found = {r["k"]: r["_in"] for r in with_membership(rows, "k", held, "_in", bits).collect()}
        assert len(found) == 501 and not found[None] and all(found[k] for k in keys if k.endswith("7"))
        assert sum(found.values()) <= most


def test_pipeline_stages_take_nulls_repeats_and_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = {"bits": "b", "_at": "a", "n_hit": "h", "length": "l", "n_sentences": "s", "_kept": "k", "path": "p"}
    shape = docs.withColumns({c: F.lit(v) for c, v in extra.items()})
    odd = spark.createDataFrame([(i, t, None, None, None, *extra.values()) for i, t in ((None, None), (None, ""), (-1, None), (-2, ""), (-3, "12 34"), (-3, "12 34"))], shape.schema)
    told = spark.createDataFrame([tuple(r) for r in shape.unionByName(odd).collect()], shape.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, told.where("false"), sf).count() == 0, name
        kept = stage(spark, told, sf)
        if name == "packing":
            assert kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = -3").count() == 2
            continue
        assert kept.columns == told.columns, name
        assert kept.where(" AND ".join(f"`{c}` = '{v}'" for c, v in extra.items())).count() == kept.count(), name
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name == "language":
            assert not any(i is None or i < 0 for i in ids)
        elif name == "near_dedup":
            assert ids.count(None) == 2 and ids.count(-3) == 2 and ids.count(-1) == 0 and ids.count(-2) == 1
        else:
            assert ids.count(None) == 2 and ids.count(-3) == 2 and {-1, -2} <= set(ids)
