import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search as S


def _brute(index, qs, k, metric):
    out = {}
    for qid, q in qs:
        rows = []
        for did, d in index:
            q_, d_ = np.asarray(q, float), np.asarray(d, float)
            if metric == "cosine":
                s = q_ @ d_ / max(np.linalg.norm(q_), 1e-12) / max(np.linalg.norm(d_), 1e-12)
                key = -round(s, 9)
            elif metric == "dot":
                s = q_ @ d_
                key = -round(s, 9)
            else:
                s = float(((q_ - d_) ** 2).sum())
                key = round(s, 9)
            rows.append((key, did, round(s, 6)))
        rows.sort()
        out[qid] = [(did, s) for _, did, s in rows[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_exact_search_equals_brute_force(spark, metric):
    rnd = np.random.default_rng(5)
    index = [(i, rnd.normal(size=8).round(2).tolist()) for i in range(300)]
    index += [(300 + i, index[i][1]) for i in range(10)]           # exact duplicates → ties
    index.append((999, [0.0] * 8))                                   # zero vector
    qs = [(f"q{i}", rnd.normal(size=8).round(2).tolist()) for i in range(12)] + [("qz", [0.0] * 8)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(4)
    qdf = spark.createDataFrame(qs, "question_id string, embedding array<double>")
    got = S.search(idf, qdf, k=5, metric=metric).collect()
    exp = _brute(index, qs, 5, metric)
    by_q = {}
    for r in sorted(got, key=lambda r: (r.question_id, r.rank)):
        by_q.setdefault(r.question_id, []).append((r.id, r.score))
    assert by_q == exp


def test_question_batches_beyond_budget(spark):
    rnd = np.random.default_rng(1)
    index = [(i, rnd.normal(size=4).tolist()) for i in range(100)]
    qs = [(i, rnd.normal(size=4).tolist()) for i in range(50)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>")
    qdf = spark.createDataFrame(qs, "question_id long, embedding array<double>")
    one = sorted(map(tuple, S.search(idf, qdf, k=3).collect()))
    many = sorted(map(tuple, S.search(idf, qdf, k=3, broadcast_budget=400).collect()))
    assert one == many and len(one) == 150


def test_search_one_and_fewer_than_k(spark):
    idf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    qdf = spark.createDataFrame([("a", [1.0, 0.1])], "question_id string, embedding array<double>")
    hits = S.search(idf, qdf, k=5).collect()
    assert [r.id for r in sorted(hits, key=lambda r: r.rank)] == [1, 2]
    one = S.search_one(idf, [1.0, 0.1], k=1).collect()
    assert one[0].id == 1


def test_dimension_mismatch_raises(spark):
    idf = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, embedding array<double>")
    qdf = spark.createDataFrame([("a", [1.0, 0.1])], "question_id string, embedding array<double>")
    with pytest.raises(Exception, match="dimension"):
        S.search(idf, qdf, k=1).collect()


def test_join_context_keeps_missing(spark):
    hits = spark.createDataFrame([("q", 1, 7, 0.9), ("q", 2, 8, 0.5)], "question_id string, rank int, id long, score double")
    docs = spark.createDataFrame([(7, "seven")], "doc_id long, text string")
    rows = {r.id: (r.text, r.missing) for r in S.join_context(hits, docs, cols=["text"]).collect()}
    assert rows == {7: ("seven", False), 8: (None, True)}


def test_lsh_recall(spark):
    # clustered data: a question's true neighbours are close, as in retrieval
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 16))
    base = np.repeat(centres, 10, axis=0) + rnd.normal(scale=0.15, size=(400, 16))
    index = [(i, v.tolist()) for i, v in enumerate(base)]
    qs = [(f"q{i}", (centres[i] + rnd.normal(scale=0.15, size=16)).tolist()) for i in range(20)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame(qs, "question_id string, embedding array<double>")
    exact = {(r.question_id, r.id) for r in S.search(idf, qdf, k=5).collect()}
    approx = S.lsh_search(idf, qdf, k=5).collect()
    got = {(r.question_id, r.id) for r in approx}
    assert len(exact & got) / len(exact) >= 0.8
    # scores of returned pairs are exact cosines
    ex_scores = {(r.question_id, r.id): r.score for r in S.search(idf, qdf, k=400).collect()}
    assert all(abs(ex_scores[(r.question_id, r.id)] - r.score) < 1e-6 for r in approx)


def test_many_small_batches_per_task(spark):
    """Per-task running top-k across many Arrow batches equals brute force."""
    rnd = np.random.default_rng(9)
    index = [(i, rnd.integers(0, 3, size=6).astype(float).tolist()) for i in range(500)]  # many ties
    qs = [(f"q{i}", rnd.normal(size=6).tolist()) for i in range(7)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        idf = spark.createDataFrame(index, "id long, embedding array<double>").coalesce(2)
        qdf = spark.createDataFrame(qs, "question_id string, embedding array<double>")
        for metric in ("cosine", "l2"):
            got = S.search(idf, qdf, k=4, metric=metric).collect()
            by_q = {}
            for r in sorted(got, key=lambda r: (r.question_id, r.rank)):
                by_q.setdefault(r.question_id, []).append((r.id, r.score))
            assert by_q == _brute(index, qs, 4, metric), metric
        lsh = S.lsh_search(idf, qdf, k=4).collect()
        assert len({(r.question_id, r.rank) for r in lsh}) == len(lsh)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_same_model_rule(spark):
    idf = spark.createDataFrame([(1, [1.0, 0.0], "m1"), (2, [0.9, 0.1], "m2"), (3, [0.0, 1.0], "m1")],
                                "id long, embedding array<double>, embedding_model string")
    qdf = spark.createDataFrame([("a", [1.0, 0.0], "m2"), ("b", [0.1, 1.0], "m1")],
                                "question_id string, embedding array<double>, embedding_model string")
    hits, bound = S.search_same_model(idf, qdf, k=5)
    got = sorted((r.question_id, r.rank, r.id) for r in hits.collect())
    assert got == [("a", 1, 2), ("b", 1, 3), ("b", 2, 1)] and bound == 10


def test_copies_send_only_k_per_task(spark):
    # 300 identical copies + 20 others: every question ties on the copies
    index = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(1000 + i, [0.0, 1.0, float(i)]) for i in range(20)]
    qs = [("a", [1.0, 0.0, 0.0]), ("b", [1.0, 0.1, 0.0])]
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame(qs, "question_id string, embedding array<double>")
    got = sorted((r.question_id, r.rank, r.id) for r in S.search(idf, qdf, k=3).collect())
    assert got == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 1, 0), ("b", 2, 1), ("b", 3, 2)]
    # the candidates leaving the tasks are bounded by tasks × questions × k
    cand, _ = S._search_batch(idf, qdf, 3, "cosine", "id", "embedding", "question_id", "embedding",
                              with_broadcast=True)
    assert cand.count() <= 3 * 2 * 3


def test_lsh_batches_beyond_budget(spark):
    rnd = np.random.default_rng(4)
    index = [(i, rnd.normal(size=8).tolist()) for i in range(200)]
    qs = [(i, rnd.normal(size=8).tolist()) for i in range(30)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>")
    qdf = spark.createDataFrame(qs, "question_id long, embedding array<double>")
    one = sorted(map(tuple, S.lsh_search(idf, qdf, k=3).collect()))
    many = sorted(map(tuple, S.lsh_search(idf, qdf, k=3, broadcast_budget=1000).collect()))
    assert one == many and len(one) > 0


def test_ivf_recall_and_exact_scores(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(20, 12))
    base = np.repeat(centres, 15, axis=0) + rnd.normal(scale=0.1, size=(300, 12))
    index = [(i, v.tolist()) for i, v in enumerate(base)]
    qs = [(f"q{i}", (centres[i] + rnd.normal(scale=0.1, size=12)).tolist()) for i in range(20)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame(qs, "question_id string, embedding array<double>")
    exact = {(r.question_id, r.id): r.score for r in S.search(idf, qdf, k=5).collect()}
    approx = S.ivf_search(idf, qdf, k=5, nlist=10, nprobe=2).collect()
    got = {(r.question_id, r.id) for r in approx}
    assert len(set(exact) & got) / len(exact) >= 0.9
    allsc = {(r.question_id, r.id): r.score for r in S.search(idf, qdf, k=300).collect()}
    assert all(abs(allsc[(r.question_id, r.id)] - r.score) < 1e-6 for r in approx)
    # all probes = exact search
    full = {(r.question_id, r.id) for r in S.ivf_search(idf, qdf, k=5, nlist=10, nprobe=10).collect()}
    assert full == set(exact)


def test_where_filters_before_topk(spark):
    idf = spark.createDataFrame(
        [("a", [1.0, 0.0], "public", {"classification": "public", "lang": "en"}, "apache iceberg table"),
         ("b", [1.0, 0.05], "restricted", {"classification": "restricted", "lang": "en"}, "iceberg"),
         ("c", [0.0, 1.0], "public", {"classification": "public", "lang": "de"}, "other text")],
        "id string, embedding array<double>, classification string, metadata map<string,string>, document string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, embedding array<double>")
    ids = lambda df: [r.id for r in sorted(df.collect(), key=lambda r: r.rank)]
    assert ids(S.retrieve(idf, q, k=3)) == ["a", "b", "c"]
    assert ids(S.retrieve(idf, q, k=3, equals={"classification": "public"})) == ["a", "c"]
    assert ids(S.retrieve(idf, q, k=3, equals={"lang": "en"}, contains="iceberg")) == ["a", "b"]
    plan = S.where(idf, {"classification": "public"})._jdf.queryExecution().optimizedPlan().toString()
    assert "classification" in plan


def test_l2_of_large_vectors_is_exact(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64) * 1e5
    index = [(i, [float(x) for x in base + rng.normal(size=64) * 1e-4]) for i in range(400)]
    q = base + rng.normal(size=64) * 1e-4
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame([("q", [float(x) for x in q])], "question_id string, embedding array<double>")
    got = [r.id for r in sorted(S.search(idf, qdf, k=5, metric="l2").collect(), key=lambda r: r.rank)]
    d = sorted((round(sum((a - b) ** 2 for a, b in zip(v, q)), 9), i) for i, v in index)
    assert got == [i for _, i in d[:5]]


def test_many_models_in_one_search(spark):
    idf = spark.createDataFrame([(i, [1.0, float(i % 7)], f"m{i % 150}") for i in range(600)],
                                "id long, embedding array<double>, embedding_model string")
    qdf = spark.createDataFrame([(i, [1.0, 3.0], f"m{i}") for i in range(150)] + [(999, [1.0, 1.0], "none")],
                                "question_id long, embedding array<double>, embedding_model string")
    hits, _ = S.search_same_model(idf, qdf, k=2)
    rows = hits.collect()
    assert len(rows) == 300 and all(r.id % 150 == r.question_id for r in rows)
    small, _ = S.search_same_model(idf, qdf, k=2, broadcast_budget=256)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, rows))


def test_first_look_loses_no_close_rival(spark):
    # scores apart by far less than single precision, long and short vectors, copies in bulk
    rnd = np.random.default_rng(11)
    base = rnd.normal(size=16)
    D = np.vstack([base + rnd.normal(size=(400, 16)) * 1e-7, np.repeat(rnd.normal(size=(3, 16)), 200, axis=0) * 1e3,
                   rnd.normal(size=(200, 16)) * 1e-3])
    Q = np.vstack([base, D[450], D[1100], np.zeros(16)])
    index = [(i, d.tolist()) for i, d in enumerate(D)]
    qs = [(i, q.tolist()) for i, q in enumerate(Q)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(2)
    qdf = spark.createDataFrame(qs, "question_id long, embedding array<double>")
    for metric in S.METRICS:
        got = {}
        for r in S.search(idf, qdf, k=7, metric=metric).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append(r.id)
        assert got == {q: [i for i, _ in hits] for q, hits in _brute(index, qs, 7, metric).items()}


def test_few_cells_at_a_time_whatever_the_questions():
    # a batch against many questions holds one block of scores, and as few pairs as the first bound allows
    rnd = np.random.default_rng(3)
    D, Q = rnd.normal(size=(2000, 8)), rnd.normal(size=(3000, 8))
    acc, pairs = S._TopK(5, len(Q)), []
    keep = acc.add
    acc.add = lambda *a: (pairs.append(len(a[0])), keep(*a))
    S._offer(acc, D, np.arange(2000), Q, np.arange(3000), "cosine")
    assert max(pairs) < S.BLOCK_CELLS // 20 and len(pairs) > 3
    q, key, score, ids = acc.result()
    assert len(q) == 15000
    norm = lambda X: X / np.linalg.norm(X, axis=1)[:, None]
    exact = np.argsort(-(norm(Q) @ norm(D).T), axis=1)[:, :5]
    assert (ids.reshape(-1, 5) == exact).all()


def test_lsh_looks_at_all_or_lists_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    idf = spark.createDataFrame([(i, (rnd.normal(size=8) + 1).tolist()) for i in range(300)], "id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, (rnd.normal(size=8) + 1).tolist()) for i in range(40)], "question_id long, embedding array<double>")
    hits = []
    for dense in (0, 10 ** 9):
        monkeypatch.setattr(S, "LSH_DENSE", dense)
        hits.append(sorted(map(tuple, S.lsh_search(idf, qdf, k=5, num_tables=2, num_projections=6, bucket_width=0.7).collect())))
    assert hits[0] == hits[1] and 0 < len(hits[0]) < 200


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_bounds_of_many_questions(spark, monkeypatch, metric):
    """Some rows of the index give every task a score that k rows reach: the
    hits stay those of all pairs, and tasks hand on little more than them."""
    rnd = np.random.default_rng(11)
    index = [(i, (rnd.normal(size=8) * 3).round(2).tolist()) for i in range(2000)]
    index += [(3000 + i, index[i % 3][1]) for i in range(30)]       # copies → ties
    index += [(4000, [0.0] * 8), (4001, None), (4002, [float("nan")] * 8)]
    qs = [(f"q{i}", (rnd.normal(size=8) * 3).round(2).tolist()) for i in range(40)] + [("qz", [0.0] * 8)]
    qs += [(f"c{i}", index[i][1]) for i in range(3)]
    idf = spark.createDataFrame(index, "id long, embedding array<double>").repartition(8).cache()
    qdf = spark.createDataFrame([*qs, ("qn", None)], "question_id string, embedding array<double>")
    exp = _brute([r for r in index if r[0] < 4001], qs, 5, metric)
    keys = {q: [s if metric != "l2" else -s for _, s in v] for q, v in exp.items()}
    bounded = S._with_bounds(idf, qdf, 5, metric, "embedding", "embedding").cache()
    for r in bounded.collect():
        assert -np.inf < r._floor <= keys[r.question_id][-1] + 1e-6, r
    given = S._search_batch(idf, bounded, 5, metric, "id", "embedding", "question_id", "embedding").count()
    assert given < 0.5 * 8 * 5 * len(qs)
    monkeypatch.setattr(S, "BOUND_QUESTIONS", 1)
    for more in ({}, {"broadcast_budget": 700}):
        by_q = {}
        for r in sorted(S.search(idf, qdf, k=5, metric=metric, **more).collect(), key=lambda r: (r.question_id, r.rank)):
            by_q.setdefault(r.question_id, []).append((r.id, r.score))
        assert by_q == exp


def test_bounds_by_model_and_few_rows(spark, monkeypatch):
    """A model's bound comes from its own rows; fewer than k give none."""
    monkeypatch.setattr(S, "BOUND_QUESTIONS", 1)
    idf = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], None), (4, [1.0, 0.0, 0.0], "b")],
                                "id long, embedding array<double>, m string")
    qdf = spark.createDataFrame([("q", [0.0, 1.0], "a"), ("r", [1.0, 0.0], None), ("s", [0.0, 1.0, 0.0], "b"), ("t", [1.0, 0.0], "c")],
                                "question_id string, embedding array<double>, m string")
    for k in (1, 2):
        got = {(r.question_id, r.rank, r.id) for r in S.search_same_model(idf, qdf, k=k, model_col="m")[0].collect()}
        assert got == {("q", 1, 2), ("r", 1, 3), ("s", 1, 4)} | ({("q", 2, 1)} if k == 2 else set())
    empty = S.search(idf.filter("id > 9"), qdf.filter("m = 'a'"), k=2)
    assert empty.count() == 0


def test_questions_with_a_bound_look_at_tiles():
    """Without a row above its bound a question has no pair scored; blocks need not divide rows or questions."""
    rnd = np.random.default_rng(4)
    D, Q = rnd.normal(size=(2 * S.TILE_ROWS + 5, 6)), rnd.normal(size=(S.TILE_QUESTIONS + 3, 6))
    ids, number = np.arange(len(D)), np.arange(len(Q))
    key = np.round((Q / np.linalg.norm(Q, axis=1)[:, None]) @ (D / np.linalg.norm(D, axis=1)[:, None]).T, 9)
    floor = np.sort(key, axis=1)[:, -3] - 1e-7
    floor[7] = 2.0
    acc = S._TopK(3, len(Q), floor)
    S._offer(acc, D, ids, Q, number, "cosine")
    q, _, _, got = acc.result()
    assert 7 not in q and len(q) == 3 * (len(Q) - 1)
    for i in np.unique(q):
        assert set(got[q == i]) == set(np.argsort(-key[i])[:3])


def test_question_vectors_are_computed_once(spark, monkeypatch):
    idx = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id long, embedding array<double>")
    for least in (1 << 13, 2):                    # as they are, and with first bounds
        monkeypatch.setattr(S, "BOUND_QUESTIONS", least)
        calls = spark.sparkContext.accumulator(0)

        def vector(i):
            calls.add(1)
            return [float(i), 2.0]

        made = F.udf(vector, "array<double>").asNondeterministic()
        qs = spark.range(6).select(F.col("id").cast("string").alias("question_id"), made("id").alias("embedding"))
        assert S.search(idx, qs, k=2).count() == 12
        assert calls.value == 6
