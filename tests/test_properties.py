"""Property tests (hypothesis): each example is one small Spark job over a
generated batch of inputs."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.functions import vectors as V
from quarry.operators import index as IX

SET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
seg = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789-_", min_size=1, max_size=8)


@SET
@given(st.lists(st.tuples(seg, st.lists(seg, min_size=0, max_size=4), seg), min_size=1, max_size=20))
def test_https_html_round_trip(spark, parts):
    """N6 then N7 gives back an https link that ended in .html."""
    urls = [f"https://{h}.example.com/{'/'.join(p + [last])}.html" for h, p, last in parts]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    path = U.path_from_url(U.strip_html_suffix("url"))
    got = [r.ref for r in df.select(U.url_from_source(path).alias("ref")).collect()]
    assert got == [f"[Reference 1]({u})" for u in urls]


@SET
@given(st.lists(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=16), min_size=1, max_size=20))
def test_normalised_vectors_have_unit_norm(spark, vecs):
    df = spark.createDataFrame([(v,) for v in vecs], "v array<double>")
    for r, v in zip(df.select(V.l2_norm(V.l2_normalise("v")).alias("n")).collect(), vecs):
        if math.sqrt(sum(x * x for x in v)) > 1e-9:
            assert abs(r.n - 1.0) < 1e-9
        else:
            assert r.n <= 1.0


rec = st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.sampled_from(["/p1", "/p2", "/p3"]), st.integers(0, 3))


@SET
@given(st.lists(rec, min_size=0, max_size=12), st.lists(rec, min_size=1, max_size=12))
def test_upsert_and_insert_are_idempotent(spark, old_rows, new_rows):
    schema = "id string, file_path string, batch_no int"
    # an existing index has unique ids: build it with the operator itself
    old = IX.upsert(None, spark.createDataFrame(old_rows, schema)) if old_rows else None
    new = spark.createDataFrame(new_rows, schema)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    up = IX.upsert(old, new)
    assert key(IX.upsert(up, new)) == key(up)
    # last writer wins: the later load, and in it the greatest (batch_no, file_path)
    exp = {}
    for rows in (old_rows, new_rows):
        exp.update({i: max(((b, p) for j, p, b in rows if j == i))[::-1] for i, _, _ in rows})
    assert key(up) == sorted((i, p, b) for i, (p, b) in exp.items())
    ins = IX.insert_if_absent(old, new, order=("batch_no", "file_path"))
    assert key(IX.insert_if_absent(ins, new, order=("batch_no", "file_path"))) == key(ins)
    assert ins.count() == ins.select("id").distinct().count()
