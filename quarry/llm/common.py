"""Shared helpers of the training-data operators: tables, scratch tables, running sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts lineage: a lost executor costs a reread, not a recomputation.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names (of equal names the first), and no others.

    Other columns may have any names, also these in other case.
    """
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    return plain.select(*[F.col(f"_{k}").alias(n) for k, n in zip(places, names)])


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's earlier rows in ``order``.

    No task holds a whole key: rows are range-partitioned by (keys, order)
    and written once; per-file totals of each key (one row for each key and
    partition) give the offsets, and the sums run inside the partitions.
    Rows that are equal in keys and order stand next to each other.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ks = [F.col(k) for k in keys]
    dealt = stored(df.repartitionByRange(parts, *[k.asc_nulls_first() for k in ks], *order)
                   .withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part", *keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys],
                          F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_hpart")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_own", F.coalesce(F.sum(value).over(local), F.lit(0)))
    joined = summed.join(heads.withColumnRenamed("_part", "_hpart"), on, "left")
    return (joined.withColumn(out, (F.col("_own") + F.col("_before")).cast("long"))
            .drop("_part", "_own", "_before", "_hpart", *[f"_k_{k}" for k in keys]))
