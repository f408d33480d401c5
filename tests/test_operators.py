"""Operators on small tables with known results."""

from __future__ import annotations

import datetime as dt
import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers as N
from quillspark.functions import text as T
from quillspark.operators import monitoring as M
from quillspark.operators import records as R
from quillspark.operators import retrieval as V
from quillspark.operators import sequences as S
from quillspark.plans import queries as plans
from quillspark.sources.tables import append_new, replace_partitions, table
from quillspark.streaming.counters import daily_counts, first_arrivals


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_of_the_whole_table(spark, sf):
    texts = {r["item_id"]: r["text"].strip(" ").lower() for r in table(spark, sf, "benchmark").collect()}
    found = {r["item_id"]: r["cer"] for r in plans.char_error_rate(spark, sf).collect()}
    assert set(found) == {i for i in texts if i + 1 in texts}
    for i, cer in found.items():
        assert cer == pytest.approx(edits(texts[i], texts[i + 1]) / len(texts[i + 1]), abs=1e-6)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    s = F.lit
    assert one(spark, T.search_tokens(s("문서에서 The 연차는 a 3일")))[0] == ["문서", "the", "연차", "3일"]
    assert one(spark, T.error_rate(s("kitten"), s("sitting")), T.error_rate(s(None), s("")), T.error_rate(s("x"), s(""))) == (3 / 7, 0.0, 1.0)
    masked = one(spark, T.mask_private(s("mail a.b@c.org now")))[0]
    assert masked == f"mail {T.MASK} now"
    assert one(spark, T.is_rejection(s("찾을 수 없습니다")), T.is_rejection(s("yes")), T.is_rejection(s(None))) == (True, False, False)
    assert one(spark, T.condition_supported(s("5일"), s("3일 이상")), T.condition_supported(s("2일"), s("3일 이상"))) == (True, False)


def test_number_functions(spark):
    s = F.lit
    assert one(spark, N.as_number(s("1,200 원")), N.as_number(s("n/a")), N.parse_money(s("12.000"))) == (1200.0, None, 12000)
    assert one(spark, N.half_even(s(2.5)), N.half_even(s(3.5)), N.half_up(s(2.5))) == (2.0, 4.0, 3)
    assert one(spark, N.speed_score(s(30_000.0), s(1.0)), N.speed_score(s(30_000.0), s(200_000.0)), N.speed_score(s(300_000.0), s(1.0))) == (3.0, 1.0, 0.0)
    found = one(spark, N.resolve_operands(F.array(s(3000.0), s(2.0), s(1500.0))))[0]
    assert (found["quantity"], found["unit"], found["amount"]) == (2.0, 1500.0, 3000.0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "some words"), (2, None)], "query_id long, text string")
    assert V.bm25(asked, docs).count() == 0
    vectors = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert V.vector_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors).count() == 0
    assert M.distribution(docs, "text").count() == 0


def test_merges(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (3, None)], "k long, v string")
    assert sorted(map(tuple, R.upsert(held, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, None)]
    assert [tuple(r) for r in R.only_new(new, held, ["k"]).collect()] == [(3, None)]
    assert sorted(tuple(r) for r in R.snapshot_diff(held, new.distinct(), "k", ["v"]).collect()) == [(1, "removed", ""), (2, "changed", "v"), (3, "added", "")]


def test_sequences(spark):
    packed = one(spark, S.pack_parts(F.array(*map(F.lit, ["ab", "cd", "efghij", "k"])), 5))[0]
    assert packed == ["ab\ncd", "efghij", "k"]
    lines = spark.createDataFrame([(1, p, t) for p in range(1, 6) for t in (f"page {p}", f"own {'x' * p}")], "doc long, page int, text string")
    assert [tuple(r) for r in S.repeated_margins(lines, "doc", "page", "text").collect()] == [(1, "page #")]
    with pytest.raises(ValueError):
        M.date_spine(spark, dt.date(2024, 2, 1), dt.date(2024, 1, 1))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    path = str(tmp_path / "t")
    for _ in range(2):
        append_new(rows, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    parted = str(tmp_path / "p")
    replace_partitions(rows, parted, "p")
    replace_partitions(spark.createDataFrame([(9, "b")], "k long, p string"), parted, "p")
    assert sorted((r["k"], r["p"]) for r in spark.read.parquet(parted).collect()) == [(1, "a"), (9, "b")]


def test_stream_equals_batch(spark, sf, tmp_path):
    """Closed days have the batch counts; the last event, far ahead, closes them all."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, where = str(tmp_path / "in"), str(tmp_path / "c")
    Path(source).mkdir()
    stream = spark.readStream.schema(events.schema).parquet(source)
    days = daily_counts(first_arrivals(stream, "ts", "event_id"), "ts", "event_type", None)
    ahead = events.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 90 DAYS")).withColumn("event_id", F.lit(-1).cast("long"))
    for part in (events.unionByName(events.limit(10)), ahead):
        part.coalesce(1).write.mode("append").parquet(source)
        run = days.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", where).trigger(availableNow=True).start()
        assert run.awaitTermination(120) and run.exception() is None
    want = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_groups_are_joined_without_a_broadcast(spark, monkeypatch):
    from quillspark.operators import filters

    plans, held = [], filters.checkpointed

    def kept(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return held(frame)

    monkeypatch.setattr(filters, "checkpointed", kept)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r["group"] for r in filters.split_groups(edges).collect()} == {0}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_vectors_of_odd_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(7, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id IN (0, 3, 7)").withColumnRenamed("vec_id", "query_id")
    found = V.vector_topk(asked, vectors, k=2, threshold=2.0).collect()
    assert {(r["query_id"], r["vec_id"], r["similarity"], r["rank"]) for r in found} == {(3, 4, 13.0, 1), (3, 3, 10.0, 2)}


def test_best_pairs_keep_ties_by_id():
    rng = np.random.default_rng(3)
    for k, width in ((1, 5), (3, 3), (4, 40)):
        similar, ids = rng.integers(-3, 4, (9, width)).astype(float), rng.permutation(width)
        want = [(i, int(ids[j])) for i, row in enumerate(similar) for j in np.lexsort((ids, -row))[:k] if row[j] >= 0]
        rows, columns = V.best_pairs(similar, ids, k, 0.0)
        assert list(zip(rows.tolist(), ids[columns].tolist(), strict=True)) == want


def test_search_tokens_take_one_particle_off_each_run(spark):
    particles = T.SEARCH_PARTICLES.split("|")
    rng = random.Random(5)
    said = ["".join(rng.choice([*particles, "a", "Z9", "회사", " ", "-", "é", "\n"]) for _ in range(12)) for _ in range(400)]
    want = [[t for t in (re.sub(f"({T.SEARCH_PARTICLES})$", "", r) for r in re.findall("[가-힣A-Za-z0-9]+", s.lower())) if len(t) >= 2] for s in said]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, s string").select("i", T.search_tokens(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in sorted(rows)] == want


def test_documents_are_scored_where_they_lie(spark, sf):
    from quillspark.plans.queries import bm25_topk

    plan = bm25_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    # Only the terms' counts are dealt out, by document; no score is shuffled before it is ranked.
    assert "SortMergeJoin" not in plan and "ExistingRDD" not in plan
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id#" in plan and ", doc_id#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_similarities_of_pairs_that_come_again_are_kept(monkeypatch):
    from quillspark.operators import receipts as P

    made = []
    real = P.difflib.SequenceMatcher
    monkeypatch.setattr(P.difflib, "SequenceMatcher", lambda *a: made.append(a) or real(*a))
    a, b = pd.Series(["kept pair", "kept pair", "pair kept", None]), pd.Series(["pair kept", "pair kept", "kept pair", "x"])
    found = P.ratio.func(a, b)
    assert len(made) == 2 and found[0] == found[1] == real(None, a[0], b[0]).ratio() and found[2] == real(None, a[2], b[2]).ratio() and pd.isna(found[3])
