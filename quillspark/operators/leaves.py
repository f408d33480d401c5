"""Leaves of JSON at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpointed


def json_leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of every value that isn't an object or array, as text; paths such as $.a[0].b.

    All rows go down one level at a time, so the work takes as many passes as the deepest text has levels, each
    over what is left.  Texts that aren't JSON and nulls have no leaf; a null leaf has a null value; repeated rows give repeated leaves.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    found = []
    while True:
        level = checkpointed(level)
        nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        found.append(level.where(~nested).select("key", "path", F.col("v").cast("string").alias("value")))
        inner = level.where(nested)
        if inner.isEmpty():
            break
        step = F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("k")))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "k", "item"))
        level = opened.select("key", F.concat("path", step).alias("path"), F.col("item").alias("v"))
    whole = found[0]
    for part in found[1:]:
        whole = whole.union(part)
    return whole.withColumnRenamed("key", key)
