"""Stored indexes: a base, delta loads and a manifest.

A store is a folder::

    log/000000000003.json    one commit each: the whole manifest of that version
    data/<id>/bucket=7/...   rows of one load, or of a compaction
    dead/<id>/bucket=7/...   keys of older rows that a load replaces or removes

The manifest names dimension, metric, embedding model, key rule, row count and
the live segments.  It is taken by an atomic create of the next number, so of
two writers that began at one version the second sees the first one's commit,
checks its keys against that and takes the next number: neither load is lost.

A load writes its own rows and the keys that it replaces, never the rows that
stay.  Readers merge: a segment's row counts unless a later load names its key
as dead.  The anti join holds only dead keys (by measured size Spark
broadcasts them, else both sides are hashed), and there is none without dead
keys.  ``compact`` writes base and deltas as one new base, as a job of its
own beside running loads.  ``vacuum`` removes what no kept version names.

Keys are compared by their SHA-256 (32 bytes instead of a 512-character id),
kept with the rows and folded into ``buckets`` folders: a load reads only the
digests of the buckets that its own keys fall in.  Choose as many that a
bucket of the base is one task's work.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RULES = ("upsert", "insert")
METRICS = ("cosine", "dot", "l2")
ATTEMPTS = 20
_DIGEST, _BUCKET, _SEQ = "_digest", "bucket", "_seq"


class Conflict(RuntimeError):
    """Another writer took the version each time."""


# ---- files -------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _join(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    f = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def _create_atomic(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file with its whole content, or returns False if there is one.

    The content is written aside first.  A local link and Hadoop's rename
    without overwrite both fail when the target exists.
    """
    jvm = spark.sparkContext._jvm
    aside = f"{path}.{uuid.uuid4().hex}"
    p, fs = _fs(spark, aside)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getScheme() == "file":
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(target.toUri().getPath()).toPath(), jvm.java.io.File(p.toUri().getPath()).toPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p, target, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(p):
            fs.delete(p, False)


# ---- manifests ------------------------------------------------------------------
def _log(base: str, version: int) -> str:
    return _join(base, "log", f"{version:012d}.json")


def versions(spark: SparkSession, base: str) -> list[int]:
    return [int(n[:12]) for n in _names(spark, _join(base, "log")) if len(n) == 17 and n.endswith(".json")]


def exists(spark: SparkSession, base: str) -> bool:
    return bool(versions(spark, base))


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict:
    if version is None:
        have = versions(spark, base)
        if not have:
            raise FileNotFoundError(f"no index at {base}")
        version = have[-1]
    return json.loads(_read_text(spark, _log(base, version)))


def create(spark: SparkSession, base: str, schema: StructType, dim: int, metric: str = "cosine", model: str | None = None,
           rule: str = "upsert", key: str = "id", order: tuple[str, ...] = ("batch_no",), buckets: int = 16) -> dict:
    """K3: an empty store unless there is one; one of another dimension, metric, model or rule is refused.

    ``order`` decides among a load's rows of one key: the greatest wins under
    ``upsert``, the smallest under ``insert``; it should tell them apart.
    """
    if rule not in RULES or metric not in METRICS or dim < 1 or buckets < 1:
        raise ValueError(f"rule must be one of {RULES}, metric one of {METRICS}, dim and buckets positive")
    facts = {"dim": dim, "metric": metric, "model": model, "rule": rule, "key": key}
    for _ in range(ATTEMPTS):
        if exists(spark, base):
            have = manifest(spark, base)
            other = {k: have[k] for k, v in facts.items() if have[k] != v}
            if other:
                raise ValueError(f"index at {base} has {other}")
            return have
        new = {**facts, "version": 1, "order": list(order), "buckets": buckets, "schema": schema.jsonValue(), "rows": 0, "seq": 0,
               "segments": [], "loads": {}, "kind": "create", "time": time.time()}
        if _create_atomic(spark, _log(base, 1), json.dumps(new)):
            return new
    raise Conflict(base)


def open_first(spark: SparkSession, base: str, dim: int, model: str | None = None) -> str:
    """K3: the first store at ``base``, made if absent: cosine, the last writer wins."""
    from .index import FIRST_STORE_SCHEMA
    create(spark, base, FIRST_STORE_SCHEMA, dim, "cosine", model or f"hash-{dim}", "upsert", order=("batch_no", "file_path"))
    return base


def open_second(spark: SparkSession, base: str, dim: int, model: str | None = None) -> str:
    """K3: the second store at ``base``, made if absent: squared L2, a key's first record stays."""
    from .index import SECOND_STORE_SCHEMA
    create(spark, base, SECOND_STORE_SCHEMA, dim, "l2", model or f"hash-{dim}", "insert", order=("batch_no", "document"))
    return base


def _commit(spark: SparkSession, base: str, old: dict, **changes) -> dict | None:
    new = {**old, **changes, "version": old["version"] + 1, "time": time.time()}
    return new if _create_atomic(spark, _log(base, new["version"]), json.dumps(new)) else None


# ---- reading ---------------------------------------------------------------------
def _schema(m: dict) -> StructType:
    return StructType.fromJson(m["schema"])


def _digest(key: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(key.cast("string"), 256)), F.lit(b""))      # null is a key of its own


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(_DIGEST), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df if buckets is None else df.filter(F.col(_BUCKET).isin(buckets))


def _live(spark: SparkSession, base: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    """Live rows with ``_digest``, of all buckets or of these."""
    rows = StructType.fromJson(m["schema"]).add(_DIGEST, "binary").add(_BUCKET, "integer")
    keys = StructType().add(_DIGEST, "binary").add(_BUCKET, "integer")
    parts, dead = [], []
    for s in m["segments"]:
        if s.get("data"):
            parts.append(_folder(spark, _join(base, "data", s["data"]), rows, buckets).withColumn(_SEQ, F.lit(s["seq"])))
        if s.get("dead"):
            dead.append(_folder(spark, _join(base, "dead", s["dead"]), keys, buckets).select(
                F.col(_DIGEST).alias("_gone"), F.lit(s["seq"]).alias("_by")))
    if not parts:
        return spark.createDataFrame([], rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if dead:
        gone = dead[0]
        for d in dead[1:]:
            gone = gone.unionByName(d)
        if len(dead) > 1:       # replaced again and again: the last time counts
            gone = gone.groupBy("_gone").agg(F.max("_by").alias("_by"))
        out = out.join(gone, (F.col(_DIGEST) == F.col("_gone")) & (F.col(_SEQ) < F.col("_by")), "left_anti")
    return out.drop(_SEQ)


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The store's rows at a version, by default the newest."""
    m = manifest(spark, base, version)
    return _live(spark, base, m).select(*_schema(m).fieldNames())


# ---- writing ------------------------------------------------------------------------
def _winners(batch: DataFrame, m: dict) -> DataFrame:
    key = m["key"]
    cols = [c for c in batch.columns if c != key]
    rec, by = F.struct(*cols), F.struct(*m["order"])
    pick = F.max_by(rec, by) if m["rule"] == "upsert" else F.min_by(rec, by)
    won = batch.groupBy(key).agg(pick.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    return won.withColumn(_DIGEST, _digest(F.col(key))).withColumn(_BUCKET, _bucket(m["buckets"]))


def _checked(df: DataFrame, m: dict) -> DataFrame:
    """Rows of the manifest's schema; a vector of another dimension or model ends the load."""
    from .index import check_dimension
    names = _schema(m).fieldNames()
    if "embedding" in names:
        df = check_dimension(df, m["dim"])
    if m["model"] is not None and "embedding_model" in names:
        own = F.col("embedding_model").eqNullSafe(F.lit(m["model"]))
        df = df.withColumn("embedding_model", F.when(own, F.col("embedding_model")).otherwise(
            F.raise_error(F.concat(F.lit(f"embedding model must be {m['model']}, got "), F.coalesce("embedding_model", F.lit("none"))))))
    types = {f.name: f.dataType for f in _schema(m)}
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in names], _DIGEST, _BUCKET)


def load(spark: SparkSession, base: str, batch: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = None,
         name: str | None = None, number: int = 0) -> dict:
    """K4 / K5 + U2: adds a batch by the store's rule; returns the new manifest.

    ``enrich`` (the embedder) runs on the rows that are written only.  Loads
    of one ``name`` (a stream, say) come in the order of their ``number``; one
    that is not above the name's last committed number is skipped, so a
    replayed batch is not added twice.
    """
    from ..session import written
    m = manifest(spark, base)
    if name is not None and m["loads"].get(name, number - 1) >= number:
        return m
    won = _winners(batch, m)
    if m["rule"] == "upsert" and enrich:
        won = enrich(won)
    # computed once, whatever the number of attempts
    won = written(_checked(won, m) if m["rule"] == "upsert" else won, "store-batch")
    touched = [r[0] for r in won.select(_BUCKET).distinct().collect()]      # at most as many as there are buckets
    for _ in range(ATTEMPTS):
        if name is not None and m["loads"].get(name, number - 1) >= number:
            return m
        some = None if len(touched) == m["buckets"] else touched
        present = _live(spark, base, m, some).select(_DIGEST)
        segment: dict = {"seq": m["seq"] + 1}
        if m["rule"] == "upsert":
            gone = won.select(_DIGEST, _BUCKET).join(present, _DIGEST, "left_semi")
            segment["gone"] = _write_counted(spark, base, "dead", gone, m, segment)
            new = won
        else:
            new = won.join(present.join(won.select(_DIGEST), _DIGEST, "left_semi"), _DIGEST, "left_anti")
            new = _checked(enrich(new) if enrich else new, m)
            segment["gone"] = 0
        segment["rows"] = _write_counted(spark, base, "data", new, m, segment)
        done = _commit(spark, base, m, kind="load", seq=segment["seq"], rows=m["rows"] + segment["rows"] - segment["gone"],
                       segments=m["segments"] + ([segment] if segment["rows"] or segment["gone"] else []),
                       loads=m["loads"] | ({name: number} if name is not None else {}))
        if done:
            return done
        m = manifest(spark, base)
    raise Conflict(base)


def _write_counted(spark: SparkSession, base: str, kind: str, df: DataFrame, m: dict, segment: dict) -> int:
    """Rows written to a new folder of the segment; an empty one is not kept."""
    folder = uuid.uuid4().hex
    path = _join(base, kind, folder)
    df.repartition(m["buckets"], _BUCKET).sortWithinPartitions(_BUCKET, _DIGEST).write.partitionBy(_BUCKET).parquet(path)
    schema = StructType().add(_DIGEST, "binary").add(_BUCKET, "integer")
    n = spark.read.schema(schema).parquet(path).count()          # from the files' footers
    if n:
        segment[kind] = folder
    else:
        p, fs = _fs(spark, path)
        fs.delete(p, True)
    return n


def remove(spark: SparkSession, base: str, keys: DataFrame) -> dict:
    """Deletes the rows of these keys (a column of the key's name)."""
    m = manifest(spark, base)
    asked = keys.select(_digest(F.col(m["key"])).alias(_DIGEST)).distinct().withColumn(_BUCKET, _bucket(m["buckets"]))
    for _ in range(ATTEMPTS):
        segment = {"seq": m["seq"] + 1, "rows": 0}
        gone = asked.join(_live(spark, base, m).select(_DIGEST), _DIGEST, "left_semi")
        segment["gone"] = _write_counted(spark, base, "dead", gone, m, segment)
        done = _commit(spark, base, m, kind="remove", seq=segment["seq"], rows=m["rows"] - segment["gone"],
                       segments=m["segments"] + ([segment] if segment["gone"] else []))
        if done:
            return done
        m = manifest(spark, base)
    raise Conflict(base)


def compact(spark: SparkSession, base: str) -> dict:
    """Base and deltas as one new base.  Loads that commit meanwhile stay as deltas over it."""
    m = manifest(spark, base)
    if len(m["segments"]) < 2:
        return m
    old = {s["seq"] for s in m["segments"]}
    segment = {"seq": m["seq"], "gone": 0}
    segment["rows"] = _write_counted(spark, base, "data", _live(spark, base, m), m, segment)
    for _ in range(ATTEMPTS):
        if not old <= {s["seq"] for s in m["segments"]}:
            raise Conflict(f"{base}: compacted by another writer")
        later = [s for s in m["segments"] if s["seq"] not in old]
        done = _commit(spark, base, m, kind="compact", segments=([segment] if segment["rows"] else []) + later)
        if done:
            return done
        m = manifest(spark, base)
    raise Conflict(base)


def vacuum(spark: SparkSession, base: str, keep: int = 1, older_than: float = 7 * 86400) -> int:
    """Removes all but the newest ``keep`` versions, and folders that none of those names and that are
    older than ``older_than`` seconds (younger ones may belong to a writer at work); returns the number of folders."""
    have = versions(spark, base)
    kept = [manifest(spark, base, v) for v in have[-keep:]]
    named = {(k, s[k]) for m in kept for s in m["segments"] for k in ("data", "dead") if s.get(k)}
    gone = 0
    for kind in ("data", "dead"):
        for n in _names(spark, _join(base, kind)):
            p, fs = _fs(spark, _join(base, kind, n))
            if (kind, n) not in named and fs.getFileStatus(p).getModificationTime() / 1000 < time.time() - older_than:
                fs.delete(p, True)
                gone += 1
    for v in have[:-keep]:
        p, fs = _fs(spark, _log(base, v))
        fs.delete(p, False)
    return gone


def drop(spark: SparkSession, base: str) -> None:
    """K7: the store with all its versions."""
    p, fs = _fs(spark, base)
    if fs.exists(p):
        fs.delete(p, True)


# ---- facts ----------------------------------------------------------------------------
FACTS = "name string, version long, dimension int, metric string, embedding_model string, rule string, total_vector_count long, segments int"


def _facts(name: str, m: dict) -> tuple:
    return name, m["version"], m["dim"], m["metric"], m["model"], m["rule"], m["rows"], len(m["segments"])


def describe(spark: SparkSession, bases: dict[str, str]) -> DataFrame:
    """S8 + S9: each store's facts, from its manifest alone."""
    return spark.createDataFrame([_facts(n, manifest(spark, b)) for n, b in bases.items()], FACTS)


def list_stores(spark: SparkSession, root: str) -> DataFrame:
    """The stores under a folder."""
    return describe(spark, {n: _join(root, n) for n in _names(spark, root) if exists(spark, _join(root, n))})


def search(spark: SparkSession, base: str, questions: DataFrame, k: int = 5, equals: dict[str, str] | None = None,
           contains: str | None = None, **kw) -> DataFrame:
    """T1–T5 with the store's own metric.  Questions of another dimension or embedding model (F8) are refused."""
    from . import search as S
    m = manifest(spark, base)
    more = [c for c in ("embedding_model",) if c in questions.columns]
    asked = questions.select("question_id", "embedding", *more)
    if more and m["model"] is not None:
        other = asked.filter(~F.col("embedding_model").eqNullSafe(F.lit(m["model"]))).first()
        if other:
            raise ValueError(f"question {other['question_id']!r} is embedded with {other['embedding_model']}, the index with {m['model']}")
    wrong = asked.filter(F.size("embedding") != m["dim"]).first()
    if wrong:
        raise ValueError(f"question {wrong['question_id']!r} has {len(wrong['embedding'])} dimensions, the index {m['dim']}")
    rows = S.where(read(spark, base), equals, contains)
    return S.search(rows, asked.select("question_id", "embedding"), k=k, metric=m["metric"], **kw)
