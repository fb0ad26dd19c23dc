"""Top-k similarity search of a question batch against an index (J2, T1–T7,
F6–F10, J6).

Exact search plan
-----------------
The question side is small by contract and its size is checked: rows ×
dimension × 8 bytes must fit ``broadcast_budget``.  It is shipped once to
every executor as a broadcast NumPy matrix.  The index is never shuffled or
paired row-by-row with questions: each index partition is scored in Arrow
batches by a blocked matrix product (``mapInPandas``) in single precision, and
a pair that may be among the k, by a bound of that product's error, is scored
exactly; a running top-k per question is merged across the task's batches in
the final order (score, then id) and only it – at most questions × k rows –
leaves the task, once.  For many questions the index vectors are written
first, in even parts, and some of the rows, looked at by all questions side by
side, give each question a score that k rows reach: every task starts from
this bound and hands on nothing below it.  The
global top-k is a window ``row_number`` whose ``WindowGroupLimit`` again
trims partial results before the exchange, so shuffle volume is bounded by
tasks × questions × k whatever the index size.

Question sets above the budget are cut into hash batches that each fit; each
batch is searched and written under the shared checkpoint folder, then the
results are read back as one table.

Ranking is on the score rounded to 9 places with the id as tie-break, so
results are deterministic and equal to a SQL evaluation of the same rule.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V
from ..session import scratch_path, written

METRICS = ("cosine", "dot", "l2")
# Bytes of question matrix per broadcast.  PySpark loads a broadcast into
# every Python worker, i.e. once per executor core: 64 MiB × 8 cores stays
# around half a GiB per executor.  Larger question sets run in batches.
DEFAULT_BUDGET = 64 << 20
RANK_PLACES = 9                # scores are ranked after rounding to this
SCORE_PLACES = 6               # and reported rounded to this
# Score entries per NumPy block (questions × index rows): bounds task memory
# and fits a core's cache.
BLOCK_CELLS = 1 << 20
# Rows of the index in a block of questions that have a bound.
TILE_ROWS, TILE_QUESTIONS = 1024, 512
# Pairs scored exactly at a time, and rows at least that give a first bound.
PAIRS, FIRST_ROWS = 1 << 14, 1024
# Rows handed on at a time.
OUT_ROWS = 1 << 16
# From so many questions on, some rows give every task the first bounds: at most
# BOUND_ROWS, about where a pair more to look at costs as much as the pairs
# that a lower bound would leave to score (BOUND_COST of those looked at).
BOUND_QUESTIONS, BOUND_ROWS, BOUND_COST, BOUND_WIDTH = 1 << 13, 1 << 16, 1000, 1024


def _norms(X: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", X, X))


def _look(D: np.ndarray, metric: str):
    """A first look at a block in single precision: the rows as a float32
    matrix ``L``, a function ``ask(Q, floor)`` → ``(M, need, margin)`` and one
    ``reached(Q, s)``.

    A row whose rounded score reaches a question's floor has ``M @ L.T`` at or
    above ``need - margin``; one with ``M @ L.T`` at or above ``s`` has a
    rounded score of ``reached(Q, s)`` at least.  Rows and questions are scaled to length one at
    most, so the product's error is bounded by the dimension alone.
    """
    error = 8.0 * (D.shape[1] + 8) * 2.0 ** -24
    slack = 2.0 * 10.0 ** -RANK_PLACES
    norm = _norms(D)
    top = max(norm.max(initial=0.0), V.NORM_EPS)

    if metric == "cosine":
        def ask(Q, floor):
            return Q / np.maximum(_norms(Q), V.NORM_EPS)[:, None], floor, np.full(len(Q), error + slack)

        def reached(Q, s):
            return s - error - slack
        return D / np.maximum(norm, V.NORM_EPS)[:, None], ask, reached
    if metric == "dot":
        def ask(Q, floor):
            scale = np.maximum(_norms(Q), V.NORM_EPS) * top
            return Q * (top / scale)[:, None], floor / scale, error + slack / scale

        def reached(Q, s):
            return (s - error) * np.maximum(_norms(Q), V.NORM_EPS) * top - slack
        return D / top, ask, reached

    # -|d - q|² / 2 = dq - |d|²/2 - |q|²/2: the row's part is one more column
    def ask(Q, floor):
        q2 = np.einsum("ij,ij->i", Q, Q)
        scale = np.maximum(np.sqrt(q2), top)
        unit = 2.0 * top * scale
        return np.column_stack([Q / scale[:, None], top / (2.0 * scale)]), (floor + q2) / unit, error + (slack + 1e-14 * q2) / unit

    def reached(Q, s):
        q2 = np.einsum("ij,ij->i", Q, Q)
        return (s - error) * 2.0 * top * np.maximum(np.sqrt(q2), top) - q2 - slack - 1e-14 * q2
    return np.column_stack([D / top, -(norm / top) ** 2]), ask, reached


def _exact(D: np.ndarray, Q: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs in double precision."""
    out = np.empty(len(rows))
    for x in range(0, len(rows), PAIRS):                  # the gathered vectors are wide
        d, q = D[rows[x:x + PAIRS]], Q[cols[x:x + PAIRS]]
        if metric == "l2":
            d = d - q
            q = d
        s = np.einsum("ij,ij->i", d, q)
        if metric == "cosine":
            s = s / np.maximum(_norms(d), V.NORM_EPS) / np.maximum(_norms(q), V.NORM_EPS)
        out[x:x + PAIRS] = s
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, nulls last."""
    if ids.dtype.kind in "iuf":
        return ids
    codes = pd.factorize(ids, sort=True)[0]
    return np.where(codes < 0, len(ids), codes)


def _few_copies(D: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of a batch's rows without those that ``k`` rows of the same
    vector precede by id: they have no place among the k.  Nor have rows with
    a number that is none."""
    first = np.argsort(_order(ids), kind="stable")
    first = first[np.isfinite(_norms(D)[first])]
    rows = np.ascontiguousarray(D[first])
    if not len(rows):
        return first
    group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    by = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(group[by]) != 0))
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return np.sort(first[by[nth < k]])


def _offer(acc: _TopK, D: np.ndarray, ids: np.ndarray, Q: np.ndarray, number: np.ndarray, metric: str,
           pick: np.ndarray | None = None, meets: _Meets | None = None) -> None:
    """Hands the rows that may be among a question's k to ``acc``.

    All pairs are looked at in single precision, and those above the
    question's bound (its k-th so far, or in its first batch the k-th of some
    rows) scored exactly.  ``number``: the questions' places in ``acc``;
    ``pick``: the questions looked at, by default all; ``meets``: the pairs
    that count, by default all.
    """
    pick = np.arange(len(Q)) if pick is None else pick
    n = len(ids)
    if not n or not len(pick):
        return
    L, ask, _ = _look(D, metric)
    L = np.ascontiguousarray(L.T, dtype=np.float32)

    def score(r, c):
        """Exact scores of looked-at pairs; those that reach the bound count."""
        raw = _exact(D, Q, r, c, metric)
        key = np.round(-raw if metric == "l2" else raw, RANK_PLACES)
        best = key >= acc.floor[number[c]]
        acc.add(number[c[best]], key[best], raw[best], ids[r[best]])

    if meets is None:
        known = acc.floor[number[pick]] > -np.inf
        if known.any():
            _above(L, ask, Q, pick[known], acc, number, score)
            pick = pick[~known]
    some = slice(None, None, max(1, n // max(FIRST_ROWS, n // 4, acc.k)))
    step = max(16, BLOCK_CELLS // n)
    for q0 in range(0, len(pick), step):
        cols = pick[q0:q0 + step]
        M, need, margin = ask(Q[cols], acc.floor[number[cols]])
        S = M.astype(np.float32) @ L                       # questions × rows
        new = np.flatnonzero(need == -np.inf)
        if len(new):
            part = S[new, some]
            if meets is not None:
                part = np.where(meets.block(cols[new], some), part, -np.inf)
            if part.shape[1] >= acc.k:
                part = np.where(np.isnan(part), -np.inf, part)
                need[new] = np.partition(part, part.shape[1] - acc.k, axis=1)[:, part.shape[1] - acc.k]
            free = np.flatnonzero(need == -np.inf)         # without a bound every pair that counts is scored
            if len(free) and meets is not None:
                S[free] = np.where(meets.block(cols[free]), S[free], -np.inf)
        hit = S >= (need - margin).astype(np.float32)[:, None]
        if len(new):
            hit[new] &= S[new] > -np.inf
        c, r = np.divmod(np.flatnonzero(hit), n)
        c = cols[c]
        if meets is not None:
            met = meets.pairs(r, c)
            r, c = r[met], c[met]
        score(r, c)


def _above(L: np.ndarray, ask, Q: np.ndarray, pick: np.ndarray, acc: _TopK, number: np.ndarray, score) -> None:
    """``_offer`` for questions that have a bound: only those whose best row
    of a tile reaches it are looked at pair by pair."""
    tiles = [t for t in np.array_split(np.arange(L.shape[1]), math.ceil(L.shape[1] / TILE_ROWS)) if len(t)]
    parts = [np.ascontiguousarray(L[:, t[0]:t[-1] + 1]) for t in tiles]
    block = np.empty(TILE_QUESTIONS * len(tiles[0]), np.float32)
    for q0 in range(0, len(pick), TILE_QUESTIONS):
        cols = pick[q0:q0 + TILE_QUESTIONS]
        M, need, margin = ask(Q[cols], acc.floor[number[cols]])
        M, bound = M.astype(np.float32), (need - margin).astype(np.float32)
        rs, cs = [], []
        for t, part in zip(tiles, parts):
            S = np.matmul(M, part, out=block[:len(cols) * len(t)].reshape(len(cols), len(t)))
            some = np.flatnonzero(S.max(axis=1) >= bound)
            if len(some):
                c, r = np.divmod(np.flatnonzero(S[some] >= bound[some, None]), len(t))
                rs.append(r + t[0])
                cs.append(cols[some[c]])
        if rs:
            score(np.concatenate(rs), np.concatenate(cs))


class _TopK:
    """Running top-k per question inside one task, in the final order
    (rounded score descending, id ascending).

    Candidates of every Arrow batch are appended; when they exceed a few
    times ``questions × k`` they are cut back to exactly k per question, so
    a task emits at most ``questions × k`` rows, once.  Ties at the k-th
    score are resolved here by id exactly as the final window resolves
    them, so even a group of identical copies holding a third of the index
    sends only k rows per question out of each task.
    """

    def __init__(self, k: int, nq: int, floor: np.ndarray | None = None):
        self.k, self.nq = k, nq
        # a key that k rows of the index reach; the k-th so far, once there are k
        self.floor = np.full(nq, -np.inf) if floor is None else floor.copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, q, key, score, ids):
        if not len(q):
            return
        self.parts.append((q, key, score, ids))
        self.size += len(q)
        if self.size > 4 * self.nq * self.k + 65536:
            self._prune()

    def _prune(self):
        if not self.parts:
            return
        q, key, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        at = np.lexsort((_order(ids), -key, q))
        starts = np.flatnonzero(np.append(True, np.diff(q[at]) != 0))
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        at, last = at[nth < self.k], at[nth == self.k - 1]
        self.floor[q[last]] = key[last]
        self.parts, self.size = [(q[at], key[at], score[at], ids[at])], len(at)

    def result(self):
        self._prune()
        return self.parts[0] if self.parts else None

    def frames(self, qids: np.ndarray, id_col: str):
        res = self.result()
        for x in range(0, len(res[0]) if res else 0, OUT_ROWS):
            q, key, score, ids = (a[x:x + OUT_ROWS] for a in res)
            yield pd.DataFrame({"question_id": qids[q], id_col: ids, "_key": key, "score": score})


def _local_topk(bc, k: int, metric: str, id_col: str, vec_col: str, model_col: str | None = None):
    def parts(pdf, groups):
        """(rows, question numbers, question matrix) of each model"""
        if model_col is None:
            yield pdf, *groups[None]
            return
        for model, rows in pdf.groupby(model_col, dropna=False):
            key = None if pd.isna(model) else model
            if key in groups:
                yield rows, *groups[key]

    def run(batches):
        qids, groups, floor = bc.value
        acc = _TopK(k, len(qids), floor)
        for pdf, number, Q in ((p, n, q) for b in batches for p, n, q in parts(b[b[vec_col].notna()], groups)):
            nq, dim = Q.shape
            if pdf.empty or nq == 0:
                continue
            D = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64, copy=False)
            if D.shape[1] != dim:
                raise ValueError(f"index dimension {D.shape[1]} != question dimension {dim}")
            ids = pdf[id_col].to_numpy()
            few = _few_copies(D, ids, k)
            _offer(acc, D[few], ids[few], Q, number, metric)
        yield from acc.frames(qids, id_col)
    return run


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, none null, as rows."""
    if len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("vectors of more than one dimension")
    flat = pc.list_flatten(vectors).to_numpy().astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _models(rows: pa.Table, model_col: str | None) -> dict:
    """Numbers of the rows of each model; all under None without one."""
    if model_col is None:
        return {None: np.arange(len(rows))}
    members: dict = {}
    for i, m in enumerate(rows[model_col].to_pylist()):
        members.setdefault(m, []).append(i)
    return {m: np.array(ix, dtype=np.int64) for m, ix in members.items()}


def _with_bounds(index: DataFrame, questions: DataFrame, k: int, metric: str, vec_col: str, qvec_col: str,
                 model_col: str | None = None) -> DataFrame:
    """``questions`` with ``_floor``: a key that ``k`` rows of their model's
    index reach, by a first look at some of them; none known: -inf.

    The rows are dealt to ``BOUND_WIDTH`` columns; a column's best is a row,
    so that the k-th of the columns' bests is reached by k rows.
    """
    n = index.count()
    m = min(BOUND_ROWS, int(math.sqrt(BOUND_COST * k * n)))
    more = [model_col] if model_col else []
    some = index.select(vec_col, *more).filter(F.col(vec_col).isNotNull())
    some = some.sample(fraction=min(1.0, m / max(n, 1)), seed=1).limit(2 * BOUND_ROWS).toArrow()
    looks = {}
    for model, at in _models(some, model_col).items():
        vectors = some[vec_col].take(pa.array(at))
        if len(pc.unique(pc.list_value_length(vectors))) != 1:
            continue                                       # none, or the search refuses them
        D = _matrix(vectors)
        D = D[np.isfinite(_norms(D))]
        if len(D) >= k:
            looks[model] = D
    bc = index.sparkSession.sparkContext.broadcast(looks)

    def run(batches):
        cut, block = {}, np.empty(TILE_QUESTIONS * BOUND_WIDTH, np.float32)
        for model, D in bc.value.items():
            L, ask, reached = _look(D, metric)
            L = L.astype(np.float32)
            cut[model] = (D.shape[1], ask, reached, [np.ascontiguousarray(L[x:x + BOUND_WIDTH].T) for x in range(0, len(L), BOUND_WIDTH)])
        for pdf in batches:
            floor = np.full(len(pdf), -np.inf)
            models = pdf[model_col].to_numpy() if model_col else np.full(len(pdf), None)
            for model, (dim, ask, reached, tiles) in cut.items():
                mine = np.flatnonzero(pd.isna(models) if model is None else models == model)
                mine = mine[[len(v) == dim for v in pdf[qvec_col].iloc[mine]]]
                for x in range(0, len(mine), TILE_QUESTIONS):
                    at = mine[x:x + TILE_QUESTIONS]
                    Q = np.vstack(pdf[qvec_col].iloc[at].to_numpy()).astype(np.float64, copy=False)
                    M = ask(Q, np.zeros(len(Q)))[0].astype(np.float32)
                    best = M @ tiles[0]
                    for t in tiles[1:]:
                        S = np.matmul(M, t, out=block[:len(at) * t.shape[1]].reshape(len(at), -1))
                        np.maximum(best[:, :t.shape[1]], S, out=best[:, :t.shape[1]])
                    if best.shape[1] >= k:
                        kth = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k].astype(np.float64)
                        got = reached(Q, kth)
                        floor[at] = np.where(np.isfinite(got), got, -np.inf)
            pdf["_floor"] = floor
            yield pdf

    asked = questions.filter(F.col(qvec_col).isNotNull())
    return asked.mapInPandas(run, StructType([*asked.schema.fields, StructField("_floor", DoubleType())]))


def _search_batch(index: DataFrame, questions: DataFrame, k: int, metric: str,
                  id_col: str, vec_col: str, qid_col: str, qvec_col: str, with_broadcast: bool = False,
                  model_col: str | None = None):
    spark = index.sparkSession
    more = [model_col] if model_col else []
    bounds = ["_floor"] if "_floor" in questions.columns else []
    rows = questions.select(qid_col, qvec_col, *more, *bounds).filter(F.col(qvec_col).isNotNull()).toArrow()
    qids = np.array([*rows[qid_col].to_pylist(), None], dtype=object)[:-1]
    groups = {m: (ix, _matrix(rows[qvec_col].take(pa.array(ix)))) for m, ix in _models(rows, model_col).items()}
    bc = spark.sparkContext.broadcast((qids, groups, rows["_floor"].to_numpy() if bounds else None))
    qtype = questions.schema[qid_col].dataType
    schema = StructType([StructField("question_id", qtype),
                         index.schema[id_col],
                         StructField("_key", DoubleType()),
                         StructField("score", DoubleType())])
    cand = index.select(id_col, vec_col, *more).mapInPandas(
        _local_topk(bc, k, metric, id_col, vec_col, model_col), schema)
    return (cand, bc) if with_broadcast else cand


def _in_batches(index: DataFrame, questions: DataFrame, qid_col: str, qvec_col: str, need: int,
                budget: int, run_batch, more: list[str] | None = None) -> DataFrame:
    """Question sets above the broadcast budget: hash batches that each fit,
    searched one after the other, each written under the shared checkpoint
    folder (its broadcast released afterwards), read back as one table."""
    nb = math.ceil(need / budget)
    spark = index.sparkSession
    base = scratch_path(spark, f"search-{uuid.uuid4().hex}")
    # the question vectors are computed once and read back per batch
    questions = written(questions.select(qid_col, qvec_col, *(more or [])), "search-questions")
    for b in range(nb):
        part = questions.filter(F.pmod(F.xxhash64(F.col(qid_col)), F.lit(nb)) == b)
        cand_b, bc = run_batch(part)
        cand_b.write.mode("overwrite").parquet(f"{base}/b={b}")
        bc.unpersist()   # one batch's matrix at a time on the executors
    return spark.read.parquet(base).drop("b")


def search(index: DataFrame, questions: DataFrame, k: int = 5, metric: str = "cosine",
           id_col: str = "id", vec_col: str = "embedding", qid_col: str = "question_id",
           qvec_col: str = "embedding", broadcast_budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Exact top-k: ``hits(question_id, rank, id, score)``."""
    return search_bounded(index, questions, k, metric, id_col, vec_col, qid_col, qvec_col,
                          broadcast_budget)[0]


def search_bounded(index: DataFrame, questions: DataFrame, k: int = 5, metric: str = "cosine",
                   id_col: str = "id", vec_col: str = "embedding", qid_col: str = "question_id",
                   qvec_col: str = "embedding", broadcast_budget: int = DEFAULT_BUDGET,
                   model_col: str | None = None) -> tuple[DataFrame, int]:
    """Exact top-k plus a proven upper bound on its row count (questions × k).

    ``cosine`` and ``dot`` rank descending, ``l2`` (squared distance)
    ascending.  Filters (metadata equality F6, document contains F7, model
    equality F8) are applied to ``index`` by the caller *before* this call so
    they reach the Parquet scan.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be >= 1")
    more = [model_col] if model_col else []
    # counted and shipped: the question vectors are computed once
    questions = written(questions.select(qid_col, qvec_col, *more), "search-questions")
    st = questions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec_col)).alias("dim")).first()
    nq, dim = int(st["n"] or 0), int(st["dim"] or 0)
    need = nq * max(dim, 1) * 8
    if nq >= BOUND_QUESTIONS or need > broadcast_budget:
        # the vectors are computed once, and every task gets as many
        even = 2 * index.sparkSession.sparkContext.defaultParallelism
        index = written(index.select(id_col, vec_col, *more).repartition(even), "search-index")
        questions = _with_bounds(index, questions, k, metric, vec_col, qvec_col, model_col)
        more.append("_floor")
    if need <= broadcast_budget:
        cand = _search_batch(index, questions, k, metric, id_col, vec_col, qid_col, qvec_col, model_col=model_col)
    else:
        cand = _in_batches(index, questions, qid_col, qvec_col, need, broadcast_budget,
                           lambda part: _search_batch(index, part, k, metric, id_col, vec_col, qid_col,
                                                      qvec_col, with_broadcast=True, model_col=model_col), more)
    w = Window.partitionBy("question_id").orderBy(F.desc("_key"), F.asc(id_col))
    hits = (cand.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("question_id", F.col("rank").cast("int").alias("rank"), F.col(id_col).alias("id"),
                    F.round("score", SCORE_PLACES).alias("score")))
    return hits, nq * k


def search_same_model(index: DataFrame, questions: DataFrame, k: int = 5, metric: str = "cosine",
                      model_col: str = "embedding_model", **kw) -> tuple[DataFrame, int]:
    """F8: questions only meet index rows embedded by the same model.

    The model is a key inside one search: each task scores its rows of a
    model against that model's questions alone, whatever their number.
    """
    return search_bounded(index, questions, k=k, metric=metric, model_col=model_col, **kw)


def where(index: DataFrame, equals: dict[str, str] | None = None, contains: str | None = None,
          document_col: str = "document", metadata_col: str = "metadata") -> DataFrame:
    """The stores' ``where={field: value}`` and
    ``where_document={"$contains": s}`` as filters on the index, applied
    before the top-k.  A field that is a top-level column is filtered there
    (so it reaches the Parquet scan); otherwise the metadata map is read."""
    for field, value in (equals or {}).items():
        col = F.col(field) if field in index.columns else F.element_at(F.col(metadata_col), F.lit(field))
        index = index.filter(col == F.lit(value))
    if contains is not None:
        index = index.filter(F.col(document_col).contains(contains))
    return index


def retrieve(index: DataFrame, questions: DataFrame, k: int = 4, metric: str = "cosine",
             equals: dict[str, str] | None = None, contains: str | None = None, **kw) -> DataFrame:
    """The retriever the QA chain calls – filters (F6, F7), then top-k."""
    return search(where(index, equals, contains), questions, k=k, metric=metric, **kw)


def search_one(index: DataFrame, qvec: list[float], k: int = 5, metric: str = "cosine",
               id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """One question.  Score natively, ``orderBy(...).limit(k)`` plans as
    ``TakeOrderedAndProject`` (a per-partition top-k then a merge)."""
    q = F.array(*[F.lit(float(x)) for x in qvec])
    if metric == "cosine":
        s = V.cosine(F.col(vec_col), q)
    elif metric == "dot":
        s = V.dot(F.col(vec_col), q)
    else:
        s = V.squared_l2(F.col(vec_col), q)
    scored = index.select(F.col(id_col).alias("id"), s.alias("score"))
    key = F.round(F.col("score"), RANK_PLACES)
    order = key.asc() if metric == "l2" else key.desc()
    return scored.orderBy(order, F.asc("id")).limit(k).select("id", F.round("score", SCORE_PLACES).alias("score"))


def best_hit(hits: DataFrame) -> DataFrame:
    """Keep the first of the k hits per question."""
    return hits.filter(F.col("rank") == 1)


# ---- approximate search (J6) -----------------------------------------------
def _lsh_keys(X: np.ndarray, R: np.ndarray, width: float, tables: int, m: int) -> np.ndarray:
    """(n, tables) int64 bucket keys: each table ANDs ``m`` projections."""
    cells = np.floor((X @ R.T) / width).astype(np.int64).reshape(len(X), tables, m)
    key = np.zeros((len(X), tables), dtype=np.int64)
    for j in range(m):                         # polynomial mix of the m cell ids
        key = key * np.int64(1_000_003) + cells[:, :, j]
    return key


# Colliding pairs formed at a time, bounds task memory whatever the buckets hold.
LSH_PAIRS = 1 << 20
# Above one colliding pair (counted in each table) of so many, all are looked at.
LSH_DENSE = 16


class _Meets:
    """Which rows of a batch share a bucket with which questions: numbers of
    the buckets by table, -1 for a row's that no question has."""

    def __init__(self, rows: np.ndarray, questions: np.ndarray):
        self.rows, self.questions = rows, questions
        self.columns = np.ascontiguousarray(rows.T)

    def pairs(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r), bool)
        for x in range(0, len(r), LSH_PAIRS):
            y = slice(x, x + LSH_PAIRS)
            out[y] = (self.rows[r[y]] == self.questions[c[y]]).any(axis=1)
        return out

    def block(self, cols: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        columns = np.ascontiguousarray(self.columns[:, some])
        out = np.zeros((len(cols), columns.shape[1]), bool)
        for t, column in enumerate(columns):
            out |= self.questions[cols, t][:, None] == column[None, :]
        return out


def _lsh_local_topk(bc, k: int, id_col: str, vec_col: str, width: float, tables: int, m: int):
    def run(batches):
        qids, Q, R, qkeys, qorder = bc.value        # of each table: sorted keys, and the questions in that order
        number = np.arange(len(qids))
        buckets = np.empty((len(qids), tables), np.int32)
        for t in range(tables):
            buckets[qorder[t], t] = np.searchsorted(qkeys[t], qkeys[t], "left")
        acc = _TopK(k, len(qids))
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            if pdf.empty or len(qids) == 0:
                continue
            D = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64, copy=False)
            ids = pdf[id_col].to_numpy()
            few = _few_copies(D, ids, k)
            D, ids = D[few], ids[few]
            dn = np.maximum(_norms(D), V.NORM_EPS)
            keys = _lsh_keys(D / dn[:, None], R, width, tables, m)
            first = np.stack([np.searchsorted(qkeys[t], keys[:, t], "left") for t in range(tables)], axis=1)
            count = np.stack([np.searchsorted(qkeys[t], keys[:, t], "right") for t in range(tables)], axis=1) - first
            total = np.cumsum(count.sum(axis=1))
            if len(ids) and total[-1] * LSH_DENSE > len(ids) * len(qids):
                # most pairs collide: a look at all is cheaper than a list of them
                _offer(acc, D, ids, Q, number, "cosine", meets=_Meets(np.where(count > 0, first, -1).astype(np.int32), buckets))
                continue
            i = 0
            while i < len(ids):                      # runs of rows with a bounded number of pairs, one row at least
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LSH_PAIRS, "right")))
                pairs = []
                for t in range(tables):
                    n = count[i:j, t]
                    stop = np.cumsum(n)
                    at = np.repeat(first[i:j, t] - (stop - n), n) + np.arange(stop[-1])
                    pairs.append(np.repeat(np.arange(i, j), n) * len(qids) + qorder[t][at])
                pair = np.unique(np.concatenate(pairs))
                r, c = pair // len(qids), pair % len(qids)
                score = _exact(D, Q, r, c, "cosine")
                key = np.round(score, RANK_PLACES)
                best = key >= acc.floor[c]                    # rows below a question's k-th so far can't be among the k
                acc.add(c[best], key[best], score[best], ids[r[best]])
                i = j
        yield from acc.frames(qids, id_col)
    return run


def lsh_search(index: DataFrame, questions: DataFrame, k: int = 5, bucket_width: float = 1.0,
               num_tables: int = 16, num_projections: int = 2, id_col: str = "id",
               vec_col: str = "embedding", qid_col: str = "question_id", qvec_col: str = "embedding",
               seed: int = 7, broadcast_budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Approximate cosine top-k by random-projection LSH.

    Each of ``num_tables`` tables hashes a unit vector to the cell of
    ``num_projections`` Gaussian projections cut at ``bucket_width``; a
    question's candidates are the index rows sharing a cell in any table.
    The question side is size-checked and broadcast with its sorted keys;
    each index batch finds its keys by binary search and scores its candidates
    exactly, ``LSH_PAIRS`` at a time – or, where more than one pair of
    ``LSH_DENSE`` collides, looks at all pairs as the exact search does and
    drops those that share no cell; nothing is shuffled but the local top-k.
    Judge it by recall against ``search``: on the driver corpus (hash vectors
    all in one narrow cone) the defaults reach recall@5 ≈ 0.97 but score
    ≈ 89 % of pairs; with more tables/projections or a wider cell it trades
    recall for fewer candidates.  On such data the exact search is the
    better plan.
    """
    st = questions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec_col)).alias("dim")).first()
    nq, dim = int(st["n"] or 0), int(st["dim"] or 0)
    R = np.random.default_rng(seed).normal(size=(num_tables * num_projections, max(dim, 1)))

    def run_batch(qs: DataFrame):
        rows = qs.select(qid_col, qvec_col).filter(F.col(qvec_col).isNotNull()).collect()
        qids = np.array([r[0] for r in rows], dtype=object)
        Q = np.array([np.asarray(r[1], dtype=np.float64) for r in rows]) if rows else np.zeros((0, max(dim, 1)))
        qn = np.maximum(np.sqrt(np.einsum("ij,ij->i", Q, Q)), V.NORM_EPS) if len(Q) else np.ones(0)
        qkeys = _lsh_keys(Q / qn[:, None], R, bucket_width, num_tables, num_projections) if len(Q) \
            else np.zeros((0, num_tables), dtype=np.int64)
        order = [np.argsort(qkeys[:, t], kind="stable") for t in range(num_tables)]
        bc = index.sparkSession.sparkContext.broadcast((qids, Q, R, [qkeys[o, t] for t, o in enumerate(order)], order))
        schema = StructType([StructField("question_id", questions.schema[qid_col].dataType),
                             index.schema[id_col], StructField("_key", DoubleType()),
                             StructField("score", DoubleType())])
        cand = index.select(id_col, vec_col).mapInPandas(
            _lsh_local_topk(bc, k, id_col, vec_col, bucket_width, num_tables, num_projections), schema)
        return cand, bc

    # the matrix, and a sorted key and a question number for each table
    need = nq * (max(dim, 1) + 2 * num_tables) * 8
    if need <= broadcast_budget:
        cand = run_batch(questions)[0]
    else:
        # several passes: the index vectors are computed once
        index = written(index.select(id_col, vec_col), "search-index")
        cand = _in_batches(index, questions, qid_col, qvec_col, need, broadcast_budget, run_batch)
    w = Window.partitionBy("question_id").orderBy(F.desc("_key"), F.asc(id_col))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("question_id", F.col("rank").cast("int").alias("rank"), F.col(id_col).alias("id"),
                    F.round("score", SCORE_PLACES).alias("score")))


def _ivf_local_topk(bc, k: int, id_col: str, vec_col: str):
    def run(batches):
        qids, Q, probes = bc.value            # probes: cluster -> question indices
        number = np.arange(len(qids))
        acc = _TopK(k, len(qids))
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            if pdf.empty or len(qids) == 0:
                continue
            D = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64, copy=False)
            ids = pdf[id_col].to_numpy()
            few = _few_copies(D, ids, k)
            D, ids, cl = D[few], ids[few], pdf["_cluster"].to_numpy()[few]
            for c in np.unique(cl):
                asked = probes.get(int(c))
                if asked is not None:
                    rows = np.flatnonzero(cl == c)
                    _offer(acc, D[rows], ids[rows], Q, number, "cosine", pick=asked)
        yield from acc.frames(qids, id_col)
    return run


def ivf_search(index: DataFrame, questions: DataFrame, k: int = 5, nlist: int = 64, nprobe: int = 8,
               id_col: str = "id", vec_col: str = "embedding", qid_col: str = "question_id",
               qvec_col: str = "embedding", seed: int = 7, max_iter: int = 10,
               train_fraction: float = 1.0, broadcast_budget: int = DEFAULT_BUDGET) -> DataFrame:
    """J6, inverted-file form: approximate cosine top-k that adapts to the data.

    Spark ML k-means (distributed, on unit vectors) splits the index into
    ``nlist`` cells; every index row carries its cell id (a native
    ``transform``).  Each question probes its ``nprobe`` nearest centroids;
    the question matrix and the cell → questions map are broadcast (size
    checked, batched beyond the budget), and each index batch is scored
    exactly against only the questions probing its cells, with the same
    running per-task top-k and window merge as ``search``.  About
    ``nprobe / nlist`` of the pairs are scored.  Judge it by recall: on the
    driver corpus nlist 64 / nprobe 8 gives recall@5 0.92 (0.98 with
    nprobe 16), where the LSH form needs 89 % of pairs for 0.97.

    ``train_fraction < 1`` fits the centroids on a sample (each k-means
    iteration is a pass over the training rows); every index row is still
    assigned to a cell and searched.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    st = questions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec_col)).alias("dim")).first()
    nq, dim = int(st["n"] or 0), int(st["dim"] or 0)
    # null vectors train as zero vectors instead of being filtered: a filter
    # on the embedding would let Catalyst evaluate the embedder twice
    zero = F.array_repeat(F.lit(0.0), max(dim, 1))
    feats = index.select(id_col, vec_col) \
        .withColumn("_features", array_to_vector(V.l2_normalise(F.coalesce(F.col(vec_col), zero))))
    train = feats if train_fraction >= 1.0 else feats.sample(fraction=train_fraction, seed=seed)
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="_cluster").fit(train)
    C = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])   # nlist × dim
    C = C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), V.NORM_EPS)
    assigned = model.transform(feats).select(id_col, vec_col, "_cluster")

    def run_batch(qs: DataFrame):
        rows = qs.select(qid_col, qvec_col).filter(F.col(qvec_col).isNotNull()).collect()
        qids = np.array([r[0] for r in rows], dtype=object)
        Q = np.array([np.asarray(r[1], dtype=np.float64) for r in rows]) if rows else np.zeros((0, max(dim, 1)))
        probes: dict[int, np.ndarray] = {}
        if len(Q):
            Qn = Q / np.maximum(np.linalg.norm(Q, axis=1, keepdims=True), V.NORM_EPS)
            near = np.argsort(-(Qn @ C.T), axis=1)[:, :min(nprobe, len(C))]
            for c in range(len(C)):
                asked = np.flatnonzero((near == c).any(axis=1))
                if len(asked):
                    probes[c] = asked.astype(np.int32)
        bc = index.sparkSession.sparkContext.broadcast((qids, Q, probes))
        schema = StructType([StructField("question_id", questions.schema[qid_col].dataType),
                             index.schema[id_col], StructField("_key", DoubleType()),
                             StructField("score", DoubleType())])
        return assigned.mapInPandas(_ivf_local_topk(bc, k, id_col, vec_col), schema), bc

    need = nq * max(dim, 1) * 8 + nq * min(nprobe, nlist) * 8
    if need <= broadcast_budget:
        cand = run_batch(questions)[0]
    else:
        # several passes: vectors and cells are computed once
        assigned = written(assigned, "search-index")
        cand = _in_batches(index, questions, qid_col, qvec_col, need, broadcast_budget, run_batch)
    w = Window.partitionBy("question_id").orderBy(F.desc("_key"), F.asc(id_col))
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("question_id", F.col("rank").cast("int").alias("rank"), F.col(id_col).alias("id"),
                    F.round("score", SCORE_PLACES).alias("score")))


def join_context(hits: DataFrame, docs: DataFrame, doc_key: str = "doc_id",
                 cols: list[str] | None = None) -> DataFrame:
    """Hits → their documents, keeping hits whose document is gone
    (``missing = true``, document columns null).

    The hits are written once; by their measured size the planner broadcasts
    them, and the document table then streams through an inner hash join
    without a shuffle, or joins the sorted sides.  A left outer join could
    not build on its left side, so the missing hits come from an anti join
    against the found keys.  What is found is written too: it feeds both
    branches, and the documents are scanned once.
    """
    d = docs.select(F.col(doc_key).alias("id"), *list(cols or []))
    hits = written(hits, "search-hits")
    found = written(hits.join(d, "id", "inner"), "search-found")
    gone = hits.join(found.select("question_id", "id"), ["question_id", "id"], "left_anti")
    return (found.withColumn("missing", F.lit(False))
            .unionByName(gone.withColumn("missing", F.lit(True)), allowMissingColumns=True))
