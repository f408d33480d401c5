"""Pieces that several of these operators share: reading, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at a time.
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's reader alone (the path may be one that only Spark opens)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local tests)."""
    if not (folder := spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: later steps neither recompute it nor depend on executors.

    Spark takes the compressed files' size for the frame's and would broadcast what is many times larger
    in memory, or is made of it.  So joins of settled frames that grow with the input are hinted to merge.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(path, compression="zstd")
    return spark.read.schema(frame.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes, or one row."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_membership(rows: DataFrame, key: str, held: DataFrame, name: str, bits: int = 1 << 25) -> DataFrame:
    """`rows` with a boolean `name`: false only where the column `key` isn't among those of `held`, or null.

    A bitmap of `bits` hashed keys is broadcast, 4 MB however many keys there are; the more
    there are beyond a tenth of that, the more other rows are true as well.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = held.where(F.col(key).isNotNull()).select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    marked = rows.withColumn("_p", place).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(maps), "_bucket", "left")
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return marked.select(*rows.columns, hit.alias(name))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else.  `lower` does the same to texts without other letters, and does it faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in the undirected edges (a, b); a component is its smallest node.

    Alternating stars: each round every node hands its larger, then its smaller neighbours
    to the smallest one it knows.  A round is two joins on the node, so a node with very many
    neighbours is a skewed join, which adaptive execution splits.  Rounds grow with the
    logarithm of the longest path.  No edges give no rows.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            around = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            moved = around.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = pairs.groupBy("a").agg(F.min("b").alias("m"))
            moved = pairs.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        return moved.where("a > b").distinct()

    pairs = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = None
    while True:
        digest = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if digest["n"] == 0 or state == tuple(digest):
            break
        state = tuple(digest)
        pairs = settle(star(star(pairs, larger=True), larger=False))
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
