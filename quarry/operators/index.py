"""Vector-index upkeep as table operations.

An index is a Parquet table ``(id, ..., embedding, embedding_model)``.  Two
write rules exist:

* ``upsert`` (K4) – last writer wins per id.  A later load
  beats the stored record; inside one load, whose order is not defined
  originally, the greatest ``(batch_no, path)`` wins.
* ``insert_if_absent`` (K5) – an id already present keeps its record; inside
  one batch the first writer (smallest ``(batch_no, path)``) wins.

Plans.  Winner selection is a ``groupBy(id)`` with ``max_by`` / ``min_by``:
a hash aggregate with partial aggregation, so a key shared by a third of all
rows is pre-reduced map-side instead of landing whole in one task.  The
stored index meets the batch in an anti join on the key alone; adaptive
execution broadcasts the batch's keys if their measured size allows it, and
the index is then not shuffled.  Persistent indexes are written as numbered versions (a new folder per write), so a
write never overwrites the table it reads.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from ..functions import text as T

# Fixed values of the two stores' identity rules.
FIRST_STORE_KEY_CHARS = 512      # first store: id = first 512 characters of the text
SECOND_STORE_KEY_CHARS = 50      # second store without a path: first 50 characters
DEFAULT_CLASSIFICATION = "public"

FIRST_STORE_SCHEMA = StructType([
    StructField("id", StringType()), StructField("file_path", StringType()),
    StructField("metadata", MapType(StringType(), StringType())),
    StructField("embedding", ArrayType(DoubleType())), StructField("embedding_model", StringType()),
    StructField("batch_no", IntegerType())])

SECOND_STORE_SCHEMA = StructType([
    StructField("id", StringType()), StructField("document", StringType()),
    StructField("classification", StringType()),
    StructField("metadata", MapType(StringType(), StringType())),
    StructField("embedding", ArrayType(DoubleType())), StructField("embedding_model", StringType()),
    StructField("batch_no", IntegerType())])


def first_store_key(text: Column) -> Column:
    """First-store id."""
    return T.prefix_key(text, FIRST_STORE_KEY_CHARS)


def second_store_key(path: Column, text: Column) -> Column:
    """K6: the path, or the first 50 characters when there is none."""
    return F.coalesce(path, T.prefix_key(text, SECOND_STORE_KEY_CHARS))


def _pick(df: DataFrame, key: str, order: list[str], latest: bool) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    rec = F.struct(*[F.col(c) for c in cols])
    ordk = F.struct(*[F.col(c) for c in order])
    agg = F.max_by(rec, ordk) if latest else F.min_by(rec, ordk)
    return df.groupBy(key).agg(agg.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(existing: DataFrame | None, batch: DataFrame, key: str = "id",
           order: tuple[str, ...] = ("batch_no", "file_path")) -> DataFrame:
    """K4 + U2: merged index, one row per key, last writer wins.

    A later load always beats the stored record, whatever its batch number;
    ``order`` only decides inside the batch.
    """
    new = _pick(batch, key, list(order), latest=True)
    if existing is None:
        return new
    new = new.select(*existing.columns)
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def insert_if_absent(existing: DataFrame | None, batch: DataFrame, key: str = "id",
                     order: tuple[str, ...] = ("batch_no", "id"),
                     enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """K5 + J3: rows of ``batch`` whose key is not yet present (first writer
    inside the batch wins) appended to ``existing``.

    ``order`` should end with a column that tells the batch's rows of one key
    apart.  ``enrich`` (e.g. the embedder) runs only on the surviving new
    rows: skip existing and duplicate records *before* the expensive step,
    and never carry its output through the de-duplication shuffle.
    """
    new = _pick(batch, key, list(order), latest=False)
    if existing is None:
        return enrich(new) if enrich else new
    if not enrich:
        new = new.select(*existing.columns)
    # only stored keys that the batch has too go into the anti join
    present = existing.select(key).join(new.select(key), key, "left_semi")
    fresh = new.join(present, key, "left_anti")
    if enrich:
        fresh = enrich(fresh).select(*existing.columns)
    return existing.unionByName(fresh)


# ---- persistent, versioned index folders -----------------------------------
_VER = re.compile(r"^v(\d{6})$")


def _versions(spark: SparkSession, base: str, complete: bool = True) -> list[int]:
    """Version numbers under ``base``: a store's commits, or folders; by
    default only complete ones (a ``_SUCCESS`` marker), so a write that died
    half-way is never read."""
    from . import store
    if commits := store.versions(spark, base):
        return commits
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        m = _VER.match(st.getPath().getName())
        if m and (not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))):
            out.append(int(m.group(1)))
    return sorted(out)


def index_exists(spark: SparkSession, base: str) -> bool:
    return bool(_versions(spark, base))


def create_if_absent(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """K3: an empty index with a fixed schema unless one exists already."""
    if not index_exists(spark, base):
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(os.path.join(base, "v000000"))
    return read_index(spark, base)


def read_index(spark: SparkSession, base: str) -> DataFrame:
    """The newest version of a store (``store.py``) or of a folder of whole versions."""
    from . import store
    if store.exists(spark, base):
        return store.read(spark, base)
    v = _versions(spark, base)
    if not v:
        raise FileNotFoundError(f"no index at {base}")
    return spark.read.parquet(os.path.join(base, f"v{v[-1]:06d}"))


def write_index(df: DataFrame, base: str, partition_by: str | None = "embedding_model") -> str:
    """Write a new version folder; readers of the old one are unaffected."""
    spark = df.sparkSession
    v = _versions(spark, base, complete=False)   # skip past a failed partial write too
    out = os.path.join(base, f"v{(v[-1] + 1 if v else 1):06d}")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(out)
    return out


def drop_index(spark: SparkSession, base: str) -> None:
    """K7: drop every version of an index."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def list_indexes(spark: SparkSession, root: str) -> DataFrame:
    """The indexes under ``root`` with their version count and latest
    version (plus bucketed index tables of the session catalog)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            if st.isDirectory():
                name = st.getPath().getName()
                v = _versions(spark, os.path.join(root, name))
                if v:
                    rows.append((name, "folder", len(v), f"v{v[-1]:06d}"))
    tables: dict[str, list[int]] = {}
    for t in spark.catalog.listTables():
        m = re.match(r"^(.*)__v(\d{6})$", t.name)
        if m:
            tables.setdefault(m.group(1), []).append(int(m.group(2)))
    rows += [(n, "table", len(v), f"{n}__v{max(v):06d}") for n, v in sorted(tables.items())]
    return spark.createDataFrame(rows, "name string, kind string, versions int, latest string")


def check_dimension(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """K3 dimension rule: rows whose vector length differs raise at run time."""
    return df.withColumn(col, F.when(F.size(col) == dim, F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"embedding dimension must be {dim}, got "),
                               F.size(col).cast("string")))))


def stats(index: DataFrame) -> DataFrame:
    """S8 + S9: vector count and dimension range per embedding model."""
    return index.groupBy("embedding_model").agg(
        F.count(F.lit(1)).alias("total_vector_count"),
        F.min(F.size("embedding")).cast("int").alias("min_dim"),
        F.max(F.size("embedding")).cast("int").alias("max_dim"))


# ---- bucketed index tables: merges that never shuffle the index -------------
def _table_versions(spark: SparkSession, name: str) -> list[int]:
    pat = re.compile(rf"^{re.escape(name.lower())}__v(\d{{6}})$")
    return sorted(int(m.group(1)) for t in spark.catalog.listTables()
                  if (m := pat.match(t.name.lower())))


def latest_table(spark: SparkSession, name: str) -> str | None:
    v = _table_versions(spark, name)
    return f"{name}__v{v[-1]:06d}" if v else None


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "id") -> str:
    """A new table version bucketed (and sorted) by ``key``: later merges
    join it without shuffling it."""
    v = _table_versions(df.sparkSession, name)
    table = f"{name}__v{(v[-1] + 1 if v else 1):06d}"
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return table


def merge_bucketed(spark: SparkSession, name: str, batch: DataFrame, buckets: int, rule: str = "upsert",
                   key: str = "id", order: tuple[str, ...] = ("batch_no", "file_path")) -> str:
    """Merge ``batch`` into the latest version of a bucketed index table and
    write the next version.

    The batch is de-duplicated with partial aggregation before its shuffle
    (a hot key is pre-reduced in every task), then hash-partitioned into the
    table's bucket layout; the merge is one full outer sort-merge join in
    which the bucketed index side has no exchange.  Only the batch moves.
    ``rule``: ``upsert`` (K4, the batch wins; inside it the greatest ``order``)
    or ``insert`` (K5, an existing record is kept; inside the batch the
    smallest ``order`` wins).
    """
    if rule not in ("upsert", "insert"):
        raise ValueError("rule must be 'upsert' or 'insert'")
    cur = latest_table(spark, name)
    latest = rule == "upsert"
    new = _pick(batch, key, list(order), latest=latest)
    if cur is None:
        return write_bucketed(new, name, buckets, key)
    old = spark.table(cur)
    new = new.select(*old.columns)
    j = old.alias("o").join(new.alias("n"), old[key] == new[key], "full_outer")
    if latest:
        take_new = F.col(f"n.{key}").isNotNull()
    else:
        take_new = F.col(f"o.{key}").isNull()
    cols = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)] + [F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
                           for c in old.columns if c != key]
    return write_bucketed(j.select(*cols), name, buckets, key)


# ---- bucket-partitioned index tables: merges that rewrite only what they touch
def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge_partitioned(spark: SparkSession, table: str, batch: DataFrame, buckets: int,
                      rule: str = "upsert", key: str = "id",
                      order: tuple[str, ...] = ("batch_no", "file_path")) -> None:
    """Merge ``batch`` into a catalog table partitioned by ``bucket`` (a hash
    of ``key``), rewriting only the partitions the batch touches.

    Only the touched buckets of the table are read (partition pruning); the
    merged rows are cut from their lineage into the shared checkpoint folder,
    then written back with dynamic partition overwrite, which replaces exactly
    those partitions.  A micro-batch costs the buckets it touches, written
    twice; a batch of more ids than there are buckets touches nearly all.  ``rule``: ``upsert`` (K4) or
    ``insert`` (K5, existing records are kept).
    """
    if rule not in ("upsert", "insert"):
        raise ValueError("rule must be 'upsert' or 'insert'")
    b = batch.withColumn("bucket", bucket_of(F.col(key), buckets))
    exists = spark.catalog.tableExists(table)
    if not exists:
        first = _pick(b, key, list(order), latest=(rule == "upsert"))
        first.write.partitionBy("bucket").mode("errorifexists").saveAsTable(table)
        return
    spark.catalog.refreshTable(table)          # see the files of the latest merge
    cur = spark.table(table)
    b = b.select(*cur.columns)
    touched = [r[0] for r in b.select("bucket").distinct().collect()]     # at most `buckets` values
    old = cur.filter(F.col("bucket").isin(touched))
    if rule == "upsert":
        new = _pick(b, key, list(order), latest=True)
        merged = old.join(new.select(key), key, "left_anti").unionByName(new.select(*cur.columns))
    else:
        new = _pick(b, key, list(order), latest=False)
        merged = old.unionByName(new.join(old.select(key), key, "left_anti"))
    from ..session import cut_lineage
    merged = cut_lineage(merged.select(*cur.columns))
    # dynamic partition overwrite replaces exactly the partitions present in
    # `merged`; the writer option is not honoured by insertInto, so the
    # session setting is switched for this write only (a static overwrite
    # here would drop every untouched partition)
    key_conf = "spark.sql.sources.partitionOverwriteMode"
    prev = spark.conf.get(key_conf)
    spark.conf.set(key_conf, "dynamic")
    try:
        merged.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key_conf, prev)
    spark.catalog.refreshTable(table)
