"""Lexical and vector retrieval, their merge, and the measures of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.numbers import norm
from quillspark.functions.text import search_tokens
from quillspark.session import written

K1, B, LIMIT, THRESHOLD = 1.5, 0.75, 12, 0.2
#: Scores are ranked at this many decimals, so that ties fall to the id on any partitioning.
PLACES = 9
#: Query vectors multiplied with a batch of vectors at once.
BLOCK = 256


def ranked(frame: DataFrame, by: str, score: Column, tie: str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within `by`, highest score first, ties by `tie`."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(score.desc(), F.col(tie))))


def spread_out(rows: DataFrame) -> DataFrame:
    """Rows dealt over the shuffle partitions where the scan gives fewer; many files stay as they are."""
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B, limit: int = LIMIT) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best `limit` docs (doc_id, text) for each query (query_id, text).

    The corpus mean counts every document, empty ones included.  No token, no rows.  Texts are tokenised
    once; what is kept of them is how often each asked term stands in each.  A task scores the documents that
    it holds and hands on its best `limit` for each query: neither texts nor scores of all pairs are shuffled, and no
    term's postings meet in one task.  The queries' terms go to every task.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("term"))
    said = spread_out(docs.select("doc_id", "text")).select("doc_id", search_tokens(F.col("text")).alias("tokens"))
    terms = asked.select("term").distinct().withColumn("_asked", F.lit(True))
    tokens = said.select("doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).join(F.broadcast(terms), "term", "left")
    # A document's other words are one row without a term, so that all of its length is told.
    counts = written(tokens.groupBy("doc_id", "dl", F.when(F.col("_asked"), F.col("term")).alias("said")).agg(F.count("term").alias("f")).withColumnRenamed("said", "term"))
    postings = counts.where("term IS NOT NULL")
    mean = F.coalesce(F.col("_all"), F.lit(0)) / F.col("n")
    corpus = docs.agg(F.count("*").alias("n")).crossJoin(counts.agg(F.sum("f").alias("_all"))).select("n", F.when(mean > 0, mean).otherwise(1.0).alias("mean"))
    spread = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(spread, "term").crossJoin(F.broadcast(corpus)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    held = postings.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    scored = held.join(F.broadcast(weighed), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), PLACES).alias("score")).where("score > 0")
    return ranked(scored, "query_id", F.col("score"), "doc_id").where(F.col("rank") <= limit)


def best_pairs(similar: np.ndarray, ids: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's best `k` values of `threshold` or more, equal ones by the smallest id."""
    least = np.full(len(similar), threshold, dtype=np.float64)
    if similar.shape[1] > k:
        np.maximum(least, np.partition(similar, -k, axis=1)[:, -k], out=least)
    rows, columns = np.nonzero(similar >= least[:, None])
    order = np.lexsort((ids[columns], -similar[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = LIMIT, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the exact nearest vectors (vec_id, embedding) to each query (query_id, embedding).

    Queries are gathered into blocks, so a task multiplies two matrices and hands on its best
    `k` only.  Null vectors have no neighbours; all others must have one length.
    """

    def grouped(frame: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
        rows = frame.where("embedding IS NOT NULL").select(id_col, "embedding").withColumn("g", F.floor(F.monotonically_increasing_id() / size))
        return rows.groupBy("g").agg(F.collect_list(F.struct(id_col, "embedding")).alias(name)).select(name)

    def numbers(vectors: pa.ListArray) -> np.ndarray:
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One pair of blocks at a time, as Arrow holds it: Python's own floats would take eight times the memory.
            for at in range(batch.num_rows):
                held, block = (batch.column(i)[at].values for i in (0, 1))
                ids, asked = (x.field(0).to_numpy(zero_copy_only=False) for x in (held, block))
                similar = np.round(numbers(block.field(1)) @ numbers(held.field(1)).T, PLACES)
                rows, columns = best_pairs(similar, ids, k, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(asked[rows]), pa.array(ids[columns]), pa.array(similar[rows, columns])], names=["query_id", "vec_id", "similarity"])

    near = grouped(vectors, "vec_id", 1024, "held").crossJoin(grouped(queries, "query_id", BLOCK, "asked")).mapInArrow(multiply, "query_id long, vec_id long, similarity double")
    return ranked(near, "query_id", F.col("similarity"), "vec_id").where(F.col("rank") <= k)


def vector_audit(vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: how many vectors there are, and how many have another length, values that aren't finite, or no unit norm."""
    odd = F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    unit = F.abs(norm(F.col("embedding")) - 1) <= 1e-6
    return vectors.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.size("embedding") != dimension, F.lit(True))).alias("wrong_size"),
        F.count_if(F.coalesce(odd, F.lit(True))).alias("not_finite"),
        F.count_if(~F.coalesce(unit, F.lit(False))).alias("not_unit"),
    )


def merge_hybrid(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Union of two ranked lists (query_id, doc_id, rank, score): methods in order, each one's rank and score, order of first appearance."""
    both = dense.select("query_id", "doc_id", "rank", "score", F.lit("dense").alias("method"), F.lit(0).alias("source")).unionByName(lexical.select("query_id", "doc_id", "rank", "score", F.lit("bm25").alias("method"), F.lit(1).alias("source")))
    merged = both.groupBy("query_id", "doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("source", "method"))), lambda x: x["method"]), ",").alias("methods"),
        F.min(F.when(F.col("source") == 0, F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("source") == 1, F.col("rank"))).alias("bm25_rank"),
        F.max(F.when(F.col("source") == 0, F.col("score"))).alias("vector_similarity"),
        F.max(F.when(F.col("source") == 1, F.col("score"))).alias("bm25_score"),
        F.min(F.struct("source", "rank")).alias("seen"),
    )
    order = Window.partitionBy("query_id").orderBy("seen", "doc_id")
    return merged.withColumn("position", F.row_number().over(order)).drop("seen")


def rank_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query hit, recall, reciprocal rank, precision and nDCG at k.

    `results` (query_id, rank, relevant) has distinct documents; `expected` (query_id,
    n_expected) every query.  Nothing expected gives recall 0, nothing retrieved precision 0.
    """
    gain = F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0))
    found = results.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("relevant").alias("good"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_expected", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = F.lit(0.0)
    return expected.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("good") > 0, F.lit(False)).alias("hit"),
        F.coalesce(F.try_divide("good", "n_expected"), zero).alias("recall"),
        F.coalesce(1 / F.col("first"), zero).alias("reciprocal_rank"),
        F.coalesce(F.try_divide("good", "n"), zero).alias("precision"),
        F.when(F.col("n_expected") > 0, F.coalesce(F.col("dcg"), zero) / ideal).otherwise(zero).alias("ndcg"),
    )


def token_f1(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, f1) of the token multisets of `said` and `truth` by id; an empty side gives 0."""
    tokens = pairs.select("id", F.explode(search_tokens(F.col("said"))).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(pairs.select("id", F.explode(search_tokens(F.col("truth"))).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("q")))
    counts = tokens.groupBy("id", "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).groupBy("id").agg(F.sum(F.least("p", "q")).alias("tp"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return pairs.select("id").join(counts, "id", "left").select(
        "id",
        F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "q"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("q")), F.lit(0.0)).alias("f1"),
    )
