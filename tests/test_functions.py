import json

from pyspark.sql import functions as F

from quarry.functions import prompts as P
from quarry.functions import text as T
from quarry.functions import urls as U
from quarry.operators import evaluate as EV
from quarry.operators import generate as G
from quarry.operators.html import html_to_text


def one(spark, col, *vals, schema="a string"):
    df = spark.createDataFrame([tuple(vals)], schema)
    return df.select(col.alias("x")).first().x


def test_url_rules(spark):
    urls = ["https://h.com/a/b.html", "http://h.com/x/", "HTTP://h.com/y", "www.h.com/z",
            "https://h.com//a//b?q=1#f", "  https://h.com/s  "]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select(U.link_line("url").alias("u")).select(
        "u", U.is_valid_url("u").alias("ok"), U.tld("u").alias("tld"),
        U.path_from_url(U.strip_html_suffix("u")).alias("path")).collect()
    got = {r.u: (r.ok, r.tld, r.path) for r in rows}
    assert got["https://h.com/a/b.html"] == (True, "https://h.com", "/data/https:/h.com/a/b.txt")
    assert got["http://h.com/x/"] == (True, "http://h.com", "/data/http:/h.com/x.txt")
    assert got["HTTP://h.com/y"][0] is False and got["www.h.com/z"][0] is False
    assert got["https://h.com//a//b?q=1#f"][2] == "/data/https:/h.com/a/b?q=1#f.txt"
    assert "https://h.com/s" in got


def test_reference_round_trip(spark):
    url = "https://docs.example.com/guide/page.html"
    path = U.path_from_url(U.strip_html_suffix(F.lit(url)))
    ref = spark.range(1).select(U.url_from_source(path).alias("r")).first().r
    assert ref == f"[Reference 1]({url})"
    # http links do not survive the round trip (as in the original)
    path2 = U.path_from_url(U.strip_html_suffix(F.lit("http://x.org/a.html")))
    assert "http://x.org" not in spark.range(1).select(U.url_from_source(path2).alias("r")).first().r


def test_text_cleaning(spark):
    assert one(spark, T.clean_for_chunking(F.col("a")), "Héllo,\nwörld! $5 (ok)?") == "Hllo,wrld! 5 ok?"
    assert one(spark, T.remove_non_ascii(F.col("a")), "aé b") == "ab"
    assert one(spark, T.newline_to_space(F.col("a")), "a\nb\r\nc") == "a b\r c"
    assert one(spark, T.normalise_lines(F.col("a")), "a\r\nb c\x0bd") == "a b c d"
    assert one(spark, T.last_token(F.col("a")), "foo bar  Positive \n") == "Positive"
    assert one(spark, T.last_token(F.col("a")), "   ") is None
    assert one(spark, T.stem(F.col("a")), "/x/y/file.tar.pdf") == "file.tar"


def test_html_to_text():
    h = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x}</style>"
         "<script>var s=\"</p>\";</script></head><body><nav>N</nav><!-- c -->"
         "<p>a&nbsp;b &copy; &amp c&#33; &#x41;</p><template>no</template></body></html>")
    assert html_to_text(h) == "T & tNa\xa0b \xa9 & c! A"


def test_prompt_fill_rules(spark):
    df = spark.createDataFrame([("what is {{CONTEXT}}?", "ctx $1 \\ done")], "q string, c string")
    r = df.select(P.completion_prompt("q", "c").alias("p"), P.completion_prompt("q", F.lit("")).alias("p0"),
                  P.hosted_prompt("q", "c").alias("h"), P.qa_chain_prompt("q", "c").alias("qa")).first()
    exp = (P.COMPLETION_WITH_CONTEXT.replace("{{QUESTION}}", "what is {{CONTEXT}}?")
           .replace("{{CONTEXT}}", "ctx $1 \\ done"))
    assert r.p == exp
    assert r.p0 == P.COMPLETION_NO_CONTEXT.replace("{{QUESTION}}", "what is {{CONTEXT}}?").replace("{{CONTEXT}}", "")
    assert r.h == P.HOSTED_WITH_CONTEXT.format(sys=P.HOSTED_SYS, question="what is {{CONTEXT}}?",
                                               context="ctx $1 \\ done")
    assert r.qa == P.QA_CHAIN.format(question="what is {{CONTEXT}}?", context="ctx $1 \\ done")


def test_request_response_json(spark):
    df = spark.createDataFrame([("p" * 10, "250", 0.5)], "prompt string, tok string, t double")
    b1 = json.loads(df.select(F.to_json(P.request_completion("prompt", "tok", "t")).alias("j")).first().j)
    assert b1 == {"prompt": "p" * 10, "max_tokens_to_sample": 250, "temperature": 0.5, "top_k": 250,
                  "top_p": 1.0, "stop_sequences": []}
    b2 = json.loads(df.select(F.to_json(P.request_hosted("prompt", "t", "tok")).alias("j")).first().j)
    assert b2 == {"request": {"prompt": "p" * 10, "temperature": 0.5, "max_new_tokens": "250",
                              "repetition_penalty": 1.0}}
    r = spark.createDataFrame([('{"completion": "hi"}',), ('{"x": 1}',), ("not json",)], "r string")
    assert [x.c for x in r.select(P.parse_completion("r").alias("c")).collect()] == ["hi", None, None]
    h = spark.createDataFrame([('{"response": {"prediction": {"response": "PROMPT-abcdef ANSWER"}}}',
                                "PROMPT-abcdef")], "r string, p string")
    assert h.select(P.strip_echo(P.parse_hosted("r"), F.col("p")).alias("a")).first().a == "abcdef ANSWER"


def test_settings_validation(spark):
    df = spark.createDataFrame([("0.5", "250", "none"), ("1.5", "7", "x"), ("0.123", "50", "first"),
                                ("abc", "50", "second")], "t string, n string, s string")
    got = [r.p for r in df.select(P.settings_problems("t", "n", "s", ("none", "first", "second")).alias("p")).collect()]
    assert got[0] == []
    assert set(got[1]) == {"temperature out of range", "token count not offered", "unknown vector store"}
    assert got[2] == ["temperature not in steps of 0.01"]
    assert got[3] == ["temperature is not a number"]


def test_model_errors_become_rows(spark):
    def flaky():
        def run(bodies):
            if any("boom" in b for b in bodies):
                raise RuntimeError("boom")
            return [b.upper() for b in bodies]
        return run
    df = spark.createDataFrame([("ok",), ("boom",)], "body string").coalesce(1)
    got = {r.body: (r.response, r.error) for r in G.call_model(df, "body", flaky, "flaky").collect()}
    assert got["ok"] == ("OK", None)
    assert got["boom"][0] is None and "RuntimeError: boom" in got["boom"][1]


def test_accuracy(spark):
    df = spark.createDataFrame([("p1", "x Positive", 1), ("p1", "x negative", 1), ("p2", "maybe", 0),
                                ("p2", "", 0)], "prompt string, generated string, label int")
    acc = EV.accuracy_by(EV.predictions(df))
    got = {r.prompt: r.accuracy for r in acc.collect()}
    assert got == {"p1": 0.5, "p2": 0.0}
    assert EV.best_variant(acc).first().best_prompt == "p1"


def test_model_names_and_metadata(spark):
    from quarry.functions.text import model_repo_name, model_short_name
    df = spark.createDataFrame([("sentence-transformers/all-mpnet-base-v2", {"file_path": "/a.txt"})],
                               "m string, metadata map<string,string>")
    r = df.select(model_short_name("m").alias("s"), model_repo_name(model_short_name("m")).alias("r"),
                  F.element_at("metadata", F.lit("file_path")).alias("fp")).first()
    assert (r.s, r.r, r.fp) == ("all-mpnet-base-v2", "sentence-transformers/all-mpnet-base-v2", "/a.txt")


def test_new_links_anti_join(spark):
    from quarry.streaming.ingest import new_links
    links = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "url string")
    seen = spark.createDataFrame([("a",)], "url string")
    assert sorted(r.url for r in new_links(links, seen).collect()) == ["b", "c"]
    assert sorted(r.url for r in new_links(links, None).collect()) == ["a", "b", "c"]


def test_padding_and_mask(spark):
    from quarry.functions import vectors as V
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    r = df.select(V.pad("a", 5, 0).alias("p"), V.attention_mask("a", 5).alias("m"),
                  V.truncate("a", 2).alias("t")).first()
    assert (r.p, r.m, r.t) == ([1, 2, 3, 0, 0], [1, 1, 1, 0, 0], [1, 2])


def test_mean_pool_all_masked(spark):
    from quarry.operators.embed import mean_pool
    toks = spark.createDataFrame([("d", 0, 0, [1.0, 2.0]), ("e", 0, 1, [1.0, 3.0]), ("e", 1, 1, [3.0, 1.0]),
                                  ("e", 2, 0, [9.0, 9.0])], "doc_id string, pos int, mask int, vec array<double>")
    got = {r.doc_id: r.embedding for r in mean_pool(toks, normalise=False).collect()}
    assert got == {"d": [0.0, 0.0], "e": [2.0, 2.0]}


def test_fast_cleaning_equals_class_rule(spark):
    import re
    texts = ["".join(chr(i) for i in range(128)), "Héllo wörld! Ça va? 😀 done.\r\n\ttab",
             "\x00a\x7fb\u0085c d", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(T.clean_for_chunking("t").alias("x")).collect()]
    assert got == [re.sub(r"[^A-Za-z0-9 .,?!]", "", t) for t in texts]


def test_last_token_python_whitespace_and_source_note(spark):
    s = "answer Positive negative　"
    assert one(spark, T.last_token(F.col("a")), s) == s.split()[-1]
    assert one(spark, P.with_source_note(F.col("a")), "X") == "X\n\n For additional info see source information below"


def test_plugin_embedder_equals_native(spark):
    import numpy as np
    from quarry.operators import embed as EM
    df = spark.createDataFrame([(1, "Hello World hello"), (2, "Ünïcode text, with PUNCT!"), (3, "")],
                               "id long, text string")
    native = {r.id: r.embedding for r in EM.hash_embed(df, "text", 16).collect()}
    plug = {r.id: r.embedding for r in
            EM.embed_with(df, "text", lambda: EM.hash_encoder(16), 16, "hash16-test").collect()}
    for k in native:
        assert np.allclose(native[k], plug[k])
    import pytest
    with pytest.raises(Exception, match="expected"):
        EM.embed_with(df, "text", lambda: (lambda texts: np.zeros((len(texts), 3))), 16, "bad-dim").collect()


def test_short_replies_are_errors(spark):
    from quarry.operators import generate as G

    def short():
        return lambda bodies: bodies[:-1]

    def whole():
        return lambda bodies: [b.upper() for b in bodies]

    df = spark.createDataFrame([(i, f"r{i}") for i in range(4)], "id long, body string").coalesce(1)
    rows = G.call_model(df, "body", short, "m").collect()
    assert all(r.response is None and "0 replies to 1 requests" in r.error for r in rows)
    # another loader of the same name is another model
    assert [r.response for r in G.call_model(df, "body", whole, "m").orderBy("id").collect()] == ["R0", "R1", "R2", "R3"]
