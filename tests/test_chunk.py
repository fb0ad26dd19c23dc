import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators.chunk import chunk, chunk_ends

import re


def model(text, step=500):
    """The cut rule as SURVEY states it: the window of a chunk starting at s
    ends at min(s + step, n - 1); the chunk ends at the last sentence-ending
    word inside (s, window end], or at the window end when there is none."""
    words = re.sub(r"[^A-Za-z0-9 .,?!]", "", text).split()
    n, start, out = len(words), 0, []
    while start < n:
        window_end = min(start + step, n - 1)
        closers = [i for i in range(start + 1, window_end + 1) if words[i][-1] in ".!?"]
        end = closers[-1] if closers else window_end
        out.append((start, end, " ".join(words[start:end + 1])))
        start = end + 1
    return out


def spark_chunks(spark, texts, step=500, route="txt"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = chunk(df, step=step, route=route).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.chunk_ix, r.start_word, r.end_word, r.text, r.n_words))
    return {k: sorted(v) for k, v in got.items()}


def words(n, ends=()):
    return " ".join(f"w{i}." if i in ends else f"w{i}" for i in range(n))


def test_fixture_cases(spark):
    cases = [
        "", "one", words(500), words(501), words(502),
        words(600, ends={0}),            # terminator at the start word is never used
        words(600, ends={1}),            # two-word chunk
        words(1200, ends={400, 1100}),   # last window cut, tail is its own chunk
        words(700, ends={300}) .replace("w300.", "w300,"),  # comma is not a terminator
        words(2500, ends=set(range(0, 2500, 37))),
        "Hello world! How are you? Fine.",
    ]
    got = spark_chunks(spark, cases)
    for i, t in enumerate(cases):
        exp = model(t)
        g = got.get(i, [])
        assert [(s, e, x) for _, s, e, x, _ in g] == exp, i
        assert all(n <= 501 for *_, n in g)
        assert [ix for ix, *_ in g] == list(range(len(exp)))


def test_small_step_and_routes(spark):
    t = "Line one ends here.\nsecond line\r\nthird: line! and\tmore words here? yes"
    txt = spark_chunks(spark, [t], step=3, route="txt")[0]
    pdf = spark_chunks(spark, [t], step=3, route="pdf")[0]
    assert [x for *_, x, _ in txt] == [c[2] for c in model(t, 3)]
    assert [x for *_, x, _ in pdf] == [c[2] for c in model(re.sub(r"\r\n|[\n\r]", " ", t), 3)]
    # the txt route glues words across a line break
    assert any("here.second" in x for *_, x, _ in txt)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["", "", "", ".", "!", "?", ","])),
                max_size=300), st.integers(1, 40))
def test_chunk_ends_property(tokens, step):
    wl = ["x" * n + p for n, p in tokens]
    bounds = [i for i, w in enumerate(wl) if w[-1] in ".!?"]
    import numpy as np
    ends = chunk_ends(len(wl), np.array(bounds, dtype=np.int64), step)
    exp = model(" ".join(wl), step)
    assert ends == [e for _, e, _ in exp]
    # chunks tile the word list exactly
    starts = [0] + [e + 1 for e in ends[:-1]]
    assert sum(e - s + 1 for s, e in zip(starts, ends)) == len(wl)
    assert all(e - s + 1 <= step + 1 for s, e in zip(starts, ends))


def test_random_documents_equal_model(spark):
    rnd = random.Random(3)
    vocab = ["a", "bb", "ccc.", "dd!", "e?", "ff,", "Ünï", "g\nh", "i\tj", "k$"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 1500))) for _ in range(30)]
    got = spark_chunks(spark, texts, step=50)
    for i, t in enumerate(texts):
        assert [(s, e, x) for _, s, e, x, _ in got.get(i, [])] == model(t, 50)


def test_native_fold_equals_rule_many_steps(spark):
    """cut_ends (the JVM fold) against the plain rule, many random documents
    and steps, in one Spark job."""
    import numpy as np
    from pyspark.sql import functions as F
    from quarry.operators.chunk import cut_ends
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        n = rnd.randint(0, 400)
        p = rnd.choice([0.0, 0.01, 0.05, 0.3, 0.9])
        bounds = [j for j in range(n) if rnd.random() < p]
        rows.append((i, n, bounds, rnd.choice([1, 2, 3, 7, 25, 50, 500])))
    df = spark.createDataFrame(rows, "i int, n int, b array<int>, step int")
    for step in sorted({r[3] for r in rows}):
        got = {r.i: r.e for r in df.filter(F.col("step") == step)
               .select("i", cut_ends(F.col("n"), F.col("b"), step).alias("e")).collect()}
        for i, n, b, st in rows:
            if st == step:
                assert got[i] == chunk_ends(n, np.array(b, dtype=np.int64), step), (i, n, step)


def test_null_and_empty_texts(spark):
    from quarry.operators import embed as EM
    from quarry.operators import search as SR
    df = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "One. Two!")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in chunk(df).collect()]
    assert got == [(4, "One. Two!")]
    vec = EM.hash_embed(df, "text", 8).select(F_col("doc_id").alias("id"), "embedding")
    emb = {r.id: r.embedding for r in vec.collect()}
    assert emb[1] is None and emb[2] == [0.0] * 8 and sum(emb[4]) > 0
    q = spark.createDataFrame([("q", [1.0] * 8)], "question_id string, embedding array<double>")
    hits = SR.search(vec, q, k=5).collect()
    assert {r.id for r in hits} == {2, 3, 4}          # the null vector is skipped, zero vectors score 0


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)
