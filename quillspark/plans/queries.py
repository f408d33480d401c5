"""The reference's operators as queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.numbers import tax_split
from quillspark.operators import monitoring as M
from quillspark.operators import records as R
from quillspark.operators import retrieval as V
from quillspark.operators import sequences as S
from quillspark.plans.registry import ORACLES, QUERIES, query
from quillspark.sources.tables import table

#: The library's tokens in SQL.
TOKENS = f"list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[가-힣A-Za-z0-9]+'), lambda t: regexp_replace(t, '({T.SEARCH_PARTICLES})$', '')), lambda t: length(t) >= 2)"


BM25 = f"""
WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark),
said AS (SELECT doc_id, {TOKENS} AS tokens FROM documents),
corpus AS (SELECT count(*) AS n, CASE WHEN avg(len(tokens)) > 0 THEN avg(len(tokens)) ELSE 1.0 END AS mean FROM said),
postings AS (SELECT term, doc_id, dl, count(*) AS f FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM said) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM asked JOIN postings USING (term) JOIN spread USING (term), corpus GROUP BY ALL),
lexical AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 12)
"""


@query(BM25 + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twelve documents for every benchmark text."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.bm25(asked, table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


#: The fixed query set of vector searches: every fiftieth vector, against all vectors.
NEAR = """
WITH near AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS asked, v.label, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM near WHERE similarity >= {threshold} QUALIFY rank <= 12)
"""


def _near(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.vector_topk(asked, vectors, threshold=threshold)


@query(NEAR.format(threshold=-1) + "SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM found")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve nearest vectors to each query vector."""
    return _near(spark, sf_dir, -1.0).withColumn("similarity", F.round("similarity", 6))


@query(NEAR.format(threshold=0.2) + "SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM found")
def vector_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a similarity of 0.2 or more."""
    return _near(spark, sf_dir, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("SELECT count(*) AS n, count_if(len(embedding) <> 64) AS wrong_size, count_if(len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, count_if(abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-6) AS not_unit FROM embeddings")
def vector_norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of wrong length, with odd values or without unit norm."""
    return V.vector_audit(table(spark, sf_dir, "embeddings"), 64)


@query(
    NEAR.format(threshold=-1)
    + """, per AS (SELECT query_id, count(*) AS n, count_if(asked = label) AS good, min(CASE WHEN asked = label THEN rank END) AS first, sum(CASE WHEN asked = label AND rank <= 4 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM found WHERE query_id <> vec_id) GROUP BY query_id),
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
expected AS (SELECT vec_id AS query_id, sizes.n - 1 AS n_expected FROM embeddings JOIN sizes USING (label) WHERE vec_id % 50 = 0)
SELECT query_id, coalesce(good > 0, false) AS hit, round(coalesce(good / nullif(n_expected, 0), 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(good / n, 0), 6) AS precision,
       round(CASE WHEN n_expected > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(r + 1)) FROM unnest(range(1, least(n_expected, 4) + 1)) AS u(r)) ELSE 0 END, 6) AS ndcg
FROM expected LEFT JOIN per USING (query_id)"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall, reciprocal rank, precision and nDCG@4 of vector search; a vector of the same label is relevant."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _near(spark, sf_dir, -1.0).where("query_id <> vec_id").join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    judged = V.ranked(found.select("query_id", (F.col("asked") == F.col("label")).alias("relevant"), (-F.col("rank")).alias("order")), "query_id", F.col("order"), "order")
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    expected = vectors.where(F.col("vec_id") % 50 == 0).join(sizes, "label").select(F.col("vec_id").alias("query_id"), (F.col("n") - 1).alias("n_expected"))
    measures = ["recall", "reciprocal_rank", "precision", "ndcg"]
    return V.rank_metrics(judged, expected, 4).select("query_id", "hit", *[F.round(m, 6).alias(m) for m in measures])


@query(
    BM25
    + """, dense AS (SELECT q.vec_id // 50 AS query_id, v.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND score >= 0.2 QUALIFY rank <= 12),
both_ AS (SELECT 0 AS source, query_id, doc_id, rank, score FROM dense UNION ALL SELECT 1, query_id, doc_id, rank, score FROM lexical),
merged AS (SELECT query_id, doc_id, CASE WHEN min(source) = 1 THEN 'bm25' WHEN max(source) = 0 THEN 'dense' ELSE 'dense,bm25' END AS methods, min(CASE WHEN source = 0 THEN rank END) AS dense_rank, min(CASE WHEN source = 1 THEN rank END) AS bm25_rank, max(CASE WHEN source = 0 THEN score END) AS vector_similarity, max(CASE WHEN source = 1 THEN score END) AS bm25_score, min({'s': source, 'r': rank}) AS seen FROM both_ GROUP BY ALL)
SELECT query_id, doc_id, methods, dense_rank, bm25_rank, round(vector_similarity, 6) AS vector_similarity, round(bm25_score, 6) AS bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS position FROM merged"""
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical lists merged; each fiftieth vector stands for a question, vectors for documents of their id."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    dense = _near(spark, sf_dir, 0.2).select(F.expr("query_id div 50").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank", F.col("similarity").alias("score"))
    merged = V.merge_hybrid(dense, V.bm25(asked, table(spark, sf_dir, "documents")))
    return merged.withColumns({c: F.round(c, 6) for c in ("vector_similarity", "bm25_score")})


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and percentiles of values by event type."""
    found = M.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p95_nearest")})


@query(
    """WITH spine AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) AS u(d)),
found AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS items, count_if(event_type = 'error') AS failures, avg(value) AS mean_value FROM events GROUP BY 1)
SELECT day, coalesce(items, 0) AS items, coalesce(failures, 0) AS failures, round(1 - failures / items, 6) AS success_rate, round(mean_value, 6) AS mean_value FROM spine LEFT JOIN found USING (day)"""
)
def monitoring_daily_kst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily measures by Korean day on a full spine."""
    events = table(spark, sf_dir, "events")
    found = M.daily_kpis(events, M.date_spine(spark, date(2024, 1, 1), date(2024, 2, 5)), M.kst_day(F.col("ts")), F.col("event_type") == "error", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("success_rate", "mean_value")})


@query(
    """WITH tagged AS (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events),
p AS (SELECT event_type, value, day >= DATE '2024-01-16' AS now FROM tagged WHERE day BETWEEN DATE '2024-01-06' AND DATE '2024-01-25')
SELECT event_type, count_if(now) AS n_now, count_if(NOT now) AS n_before, round(avg(value) FILTER (now), 6) AS mean_now, round(avg(value) FILTER (NOT now), 6) AS mean_before, round(avg(value) FILTER (now) - avg(value) FILTER (NOT now), 6) AS change FROM p GROUP BY event_type"""
)
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days against the ten before."""
    found = M.compare_periods(table(spark, sf_dir, "events"), M.kst_day(F.col("ts")), date(2024, 1, 16), date(2024, 1, 25), "event_type", "value")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_now", "mean_before", "change")})


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, event_type) AS rank FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by count and share."""
    return M.distribution(table(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean, CASE WHEN count(DISTINCT k) = 1 AND count(k) = count(*) THEN min(k) END AS only FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events) GROUP BY user_id")
def run_summary_null_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' means, errors as nulls, and their setting where they had one only."""
    events = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return M.run_summary(events, "user_id", "value", "k").withColumn("mean", F.round("mean", 6))


@query("WITH k AS (SELECT doc_id, lang, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z가-힣]', '', 'g') AS key FROM documents) SELECT doc_id, lang, sha256(key) AS key FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1")
def latest_distinct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest document of each compact text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(T.compact(F.coalesce("text", F.lit(""))), 256).alias("key"))
    return R.latest(docs, ["key"], F.desc("doc_id"))


@query(
    """WITH d AS (SELECT doc_id, md5(text) AS exact, md5(regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g')) AS loose FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, least(min(doc_id) OVER (PARTITION BY exact), min(doc_id) OVER (PARTITION BY loose)) AS first_id FROM d) SELECT doc_id, first_id FROM f WHERE first_id < doc_id"""
)
def exact_fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text or compact text came before, and where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("exact"), F.md5(T.compact(F.col("text"))).alias("loose"))
    return R.duplicates_of(docs, ["exact", "loose"], "doc_id")


@query("SELECT doc_id, quality, 'actual' AS origin FROM labels UNION ALL SELECT doc_id, -1, 'baseline' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, and a baseline row for documents without one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.lit("actual").alias("origin"))
    return R.fill_missing(labels, table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit("baseline").alias("origin")), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS n_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with nation and number of orders."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    named = R.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "n_name", "UNKNOWN")
    return named.join(counts, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 100000")
def inner_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders of one segment with the customer's name."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").where("o_totalprice >= 100000").join(customers, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT s.stage, count(e.event_id) AS n FROM (VALUES ('error'), ('view'), ('purchase'), ('none')) AS s(stage) LEFT JOIN events e ON e.event_type = s.stage GROUP BY s.stage")
def spine_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for a fixed domain of stages, zeros included."""
    domain = spark.createDataFrame([(s,) for s in ("error", "view", "purchase", "none")], "stage string")
    return M.zero_filled(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), domain, "stage")


@query("WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY status DESC NULLS LAST, o_orderkey) - 20 AS place FROM o) SELECT o_orderkey, status, place, (SELECT count(*) FROM orders) > 70 AS has_more FROM r WHERE place BETWEEN 1 AND 50")
def page_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of orders, nulls last."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"))
    return R.page_of(rows, 50, 20, F.desc_nulls_last("status"), F.asc("o_orderkey"))


@query(
    f"""WITH p AS (SELECT item_id AS id, unnest({TOKENS}) AS t, 0 AS p, 1 AS q FROM benchmark UNION ALL SELECT doc_id, unnest({TOKENS}), 1, 0 FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)),
c AS (SELECT id, sum(least(p, q)) AS tp, sum(p) AS p, sum(q) AS q FROM (SELECT id, t, sum(p) AS p, sum(q) AS q FROM p GROUP BY ALL) GROUP BY id)
SELECT doc_id AS id, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(q, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + q, 0), 0), 6) AS f1 FROM documents JOIN benchmark ON doc_id = item_id LEFT JOIN c ON c.id = doc_id"""
)
def token_multiset_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of documents and the benchmark texts of their id."""
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("truth"))
    found = V.token_f1(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("said")).join(truth, "id"))
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each benchmark text against the next."""
    bench = table(spark, sf_dir, "benchmark")
    after = bench.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth"))
    return bench.join(after, "item_id").select("item_id", F.round(T.error_rate(F.col("text"), F.col("truth")), 6).alias("cer"))


@query()
def privacy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return table(spark, sf_dir, "documents").select("doc_id", T.has_private(F.col("text")).alias("private"), F.md5(T.mask_private(F.col("text"))).alias("masked_md5"))


@query("SELECT doc_id, CAST(c AS INTEGER) AS chunk, CAST(c * 480 AS INTEGER) AS start, CAST(length(substr(text, c * 480 + 1, 600)) AS INTEGER) AS length, md5(substr(text, c * 480 + 1, 600)) AS content_md5 FROM documents, unnest(range(0, CAST(greatest(ceil((length(text) - 600) / 480), 0) AS BIGINT) + 1)) AS u(c) WHERE length(text) > 0")
def text_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 600 characters with 120 shared."""
    return S.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 600, 120).select("doc_id", "chunk", "start", "length", F.md5("content").alias("content_md5"))


@query("SELECT lang, count(*) AS n, CAST(min(length(text)) AS INTEGER) AS least, CAST(max(length(text)) AS INTEGER) AS largest, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, count_if(length(text) > 600) AS n_over FROM documents GROUP BY lang")
def corpus_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts by language."""
    return M.length_stats(table(spark, sf_dir, "documents"), "lang", "text", 600).withColumn("mean", F.round("mean", 6))


@query("WITH g AS (SELECT user_id, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cluster FROM g JOIN events USING (user_id, event_id)")
def gap_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events, apart where half a day passes."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return S.cluster_gaps(events, "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"), "event_id", 43_200_000_000).select("user_id", "event_id", "cluster")


@query("WITH i AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY event_type, g")
def islands_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of one type."""
    return S.islands(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events")
def asof_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest error until then."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return S.asof_last(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_id"), "last_error").select("event_id", "last_error")


@query("SELECT l_orderkey, l_linenumber, round(8 * CAST(l_quantity >= 10 AS DOUBLE) + 15 * CAST(l_discount <= 0.05 AS DOUBLE) + 12 * (1 - l_tax), 6) AS score, 8 * CAST(l_quantity >= 10 AS DOUBLE) + 15 * CAST(l_discount <= 0.05 AS DOUBLE) >= 15 AS passed FROM lineitem")
def weighted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted scores of lines and a gate."""
    parts = {"quantity": (F.col("l_quantity") >= 10, 8.0), "discount": (F.col("l_discount") <= 0.05, 15.0)}
    gate = R.weighted_score(parts)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.weighted_score(parts | {"tax": (1 - F.col("l_tax"), 12.0)}), 6).alias("score"), (gate >= 15).alias("passed"))


@query("SELECT o_orderkey, round_even(o_totalprice / 11, 0) AS tax, round(o_totalprice - round_even(o_totalprice / 11, 0), 2) AS supply, floor(o_totalprice * 0.1 + 0.5) AS tenth FROM orders")
def tax_split_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax parts of order totals by both rounding rules."""
    rows = R.tax_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return rows.select("o_orderkey", "tax", F.round("supply", 2).alias("supply"), tax_split(F.col("o_totalprice"), 0.1)["tax"].cast("double").alias("tenth"))


@query(
    """WITH s AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS item_sum, sum(l_extendedprice * l_discount) AS d FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, coalesce(n, 0) AS n_items, round(item_sum, 2) AS item_sum, CASE WHEN o_totalprice <= 0 OR o_totalprice IS NULL THEN 'AMOUNT_MISSING' END AS a, CASE WHEN n IS NULL THEN 'ITEMS_MISSING' END AS b, CASE WHEN least(abs(item_sum - o_totalprice), abs(item_sum - o_totalprice - d)) > 1000 THEN 'ITEM_SUM_MISMATCH' END AS c FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT o_orderkey, n_items, item_sum, concat_ws(',', a, b, c) AS reasons, CASE WHEN concat_ws(',', a, b, c) = '' THEN 'PASS' ELSE 'REVIEW' END AS decision FROM j"""
)
def reconcile_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals against their lines."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"))
    return R.reconcile(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total")), items, "o_orderkey", 1000.0)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS kind, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def group_month_type_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month and priority."""
    return R.group_records(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice")


@query(
    """WITH c AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY 1), f AS (SELECT event_type, n, n * 1000 // t AS fl, n * 1000 % t AS rest FROM c)
SELECT event_type, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, event_type) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS units FROM f"""
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand units dealt by event counts."""
    return M.largest_remainder(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


@query("SELECT CAST(t AS DOUBLE) AS threshold, count_if(n_chars / 1000 >= t) AS accepted, round(count_if(n_chars / 1000 >= t) / count(*), 6) AS coverage, round(avg(quality) FILTER (n_chars / 1000 >= t), 6) AS accuracy FROM labels JOIN documents USING (doc_id), unnest([0.1, 0.5, 1.0, 2.0]) AS u(t) GROUP BY t")
def classifier_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy of a score at several thresholds."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("score")), "doc_id")
    return M.threshold_sweep(rows, "score", "quality", [0.1, 0.5, 1.0, 2.0]).withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy")})


@query("SELECT quality AS truth, CAST(n_chars >= 500 AS INTEGER) AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of a rule against labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy(F.col("quality").alias("truth"), (F.col("n_chars") >= 500).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'added' WHEN p_size % 5 = 0 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 THEN 'p_retailprice' ELSE '' END AS fields FROM part WHERE p_size % 7 = 0 AND p_size % 5 <> 0 OR p_size % 5 = 0 AND p_size % 7 <> 0 OR p_size % 3 = 0 AND p_size % 7 <> 0 AND p_size % 5 <> 0")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two versions of parts: sizes that divide by 7 are new, by 5 gone, by 3 dearer."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    after = parts.where("p_size % 5 <> 0").withColumn("p_retailprice", F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return R.snapshot_diff(parts.where("p_size % 7 <> 0"), after, "p_partkey", ["p_name", "p_retailprice"])


#: Other modules register theirs on import.
from quillspark.plans import amounts, attribution, chunks, evaluation, evidence, grounding, layout, listings, receipts, taxonomy, texts  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "amounts", "attribution", "chunks", "evaluation", "evidence", "grounding", "layout", "listings", "receipts", "taxonomy", "texts"]
