"""Prompt, model and evaluation jobs: summaries (Q11), few-shot evaluation
(Q9), chat history (N25), upload manifest (K9), question settings (M7/M8)
and the routed question answering job (Q6)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import evaluate as EV
from ..operators import generate as G
from ..operators import search as S
from ..session import cut_lineage, written
from ..sources import tables as TB
from . import indexing, retrieval

# Fixed values of the summary request (the reference's notebook settings).
SUMMARY_MAX_TOKENS = 4096
SUMMARY_TEMPERATURE = 0.6

STORES = ("none", "first", "second")
MODELS = ("completion", "hosted")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: summary prompt for every whole document → body 1 → model → text."""
    d = TB.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    req = d.select("doc_id", P.summary_prompt("text").alias("prompt"))
    body = P.request_completion(F.col("prompt"), F.lit(SUMMARY_MAX_TOKENS), F.lit(SUMMARY_TEMPERATURE))
    req = req.withColumn("body", F.to_json(body))
    out = G.call_model(req, "body", G.completion_echo, "completion-echo")
    return out.select("doc_id", F.length("prompt").cast("bigint").alias("prompt_chars"),
                      T.word_count(F.col("prompt")).alias("prompt_words"),
                      P.fits_window(F.col("prompt")).alias("fits_window"),
                      body["max_tokens_to_sample"].alias("max_tokens_to_sample"),
                      body["temperature"].alias("temperature"), body["top_k"].alias("top_k"),
                      body["top_p"].alias("top_p"), F.size(body["stop_sequences"]).alias("n_stop"),
                      P.parse_completion("response").alias("summary"), "error")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled examples: document text with its quality label (J4 by id)."""
    lab = TB.read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    docs = TB.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.join(lab, "doc_id").select("doc_id", F.col("text").alias("sentence"),
                                           F.col("quality").alias("label"))


def _predicted(ex: DataFrame, prompts: list[str]) -> DataFrame:
    """Examples under prompt variants (J5 as an explode, no join), model
    continuation, last token, label map."""
    variants = F.array(*[F.struct(F.lit(n).alias("prompt"), P.few_shot_prompt(n, F.col("sentence")).alias("text")) for n in prompts])
    runs = ex.select("doc_id", "label", F.explode(variants).alias("v")) \
        .select("doc_id", "label", F.col("v.prompt").alias("prompt"), F.col("v.text").alias("prompt_text"))
    gen = G.call_model(runs, "prompt_text", G.sentiment_stub, "sentiment-stub", out_col="generated")
    return EV.predictions(gen, "generated").select("doc_id", "prompt", "label", "prediction", "prediction_int")


def fewshot_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: every example under the three prompt variants."""
    return _predicted(examples(spark, sf_dir), list(P.FEW_SHOT))


def fewshot_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 / A3: accuracy per prompt variant."""
    return EV.accuracy_by(fewshot_predictions(spark, sf_dir)) \
        .select("prompt", F.round("accuracy", 6).alias("accuracy"), "n")


def fewshot_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = EV.accuracy_by(fewshot_predictions(spark, sf_dir))
    return EV.best_variant(acc).select("best_prompt", F.round("best_accuracy", 6).alias("best_accuracy"))


def fewshot_preview(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """``head()`` of the last evaluation run (prompt 3), in id order.
    The limit is the feature here; it is taken before the model is called."""
    return _predicted(examples(spark, sf_dir).orderBy("doc_id").limit(n), ["prompt_3"])


def chat_history(spark: SparkSession, sf_dir: str, block_turns: int | None = None) -> DataFrame:
    """Each conversation's user/assistant turns joined by ``; `` in turn
    order, one string a conversation.

    The string is one value, so one task builds it: its memory follows the
    longest conversation.  With ``block_turns`` the history comes in blocks
    of so many turns (``block`` 0, 1, ...) whose concatenation with ``; `` is
    the whole, and no task holds more than a block."""
    c = TB.read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    c = c.filter(F.col("role").isin("user", "assistant"))
    keys = ["conv_id"]
    if block_turns:
        c = c.withColumn("block", F.floor(F.col("turn") / block_turns).cast("bigint"))
        keys.append("block")
    h = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return h.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), "; ").alias("history"),
                    F.size("t").alias("n_turns"))


def upload_manifest(spark: SparkSession, sf_dir: str, staged_dir: str = "staged_files") -> DataFrame:
    """K9 + N9: where each uploaded file goes and its status line."""
    d = TB.documents(spark, sf_dir, with_text=False)
    name = T.basename(F.col("path"))
    stem = T.stem(F.col("path"))
    return d.select("doc_id", "path", name.alias("file_name"),
                    F.concat(F.lit(staged_dir + "/"), name).alias("staged_path"),
                    F.concat(stem, F.lit(".txt")).alias("text_name"),
                    F.replace(F.lit(P.UPLOAD_STATUS), F.lit("{name}"), name).alias("status"))


# ---- questions with settings (D14) -----------------------------------------
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with chat settings cycling through the offered domain."""
    c = TB.read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    c = c.filter(F.col("role") == "user")
    tokens = F.array(*[F.lit(t) for t in P.TOKEN_CHOICES])
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        "text",
        F.when(F.col("conv_id") % 2 == 0, "completion").otherwise("hosted").alias("model"),
        ((F.col("conv_id") * 7 + F.col("turn")) % 100 + 1).cast("double").__truediv__(100).alias("temperature"),
        F.element_at(tokens, (F.col("conv_id") % 5 + 1).cast("int")).alias("token_count"),
        F.element_at(F.array(*[F.lit(s) for s in STORES]), (F.col("turn") % 3 + 1).cast("int")).alias("store"),
        F.lit(indexing.MODEL).alias("embedding_model"))


def question_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + M8: typed settings and the list of problems (empty = accepted)."""
    q = questions(spark, sf_dir)
    probs = P.settings_problems(F.col("temperature"), F.col("token_count"), F.col("store"), STORES)
    return q.select("question_id", F.col("temperature").try_cast("double").alias("temperature"),
                    F.col("token_count").try_cast("int").alias("max_tokens"), "store",
                    F.array_join(probs, "; ").alias("problems"), (F.size(probs) == 0).alias("accepted"))


def settings_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the reject table of settings as users might send them: words for
    numbers, values out of range or off the steps, choices not offered."""
    q = questions(spark, sf_dir)
    conv, turn = (F.element_at(F.split("question_id", ":"), i).cast("bigint") for i in (1, 2))
    sent = q.withColumn("temperature", F.when(conv % 7 == 0, "warm").when(conv % 7 == 1, "1.5").when(conv % 7 == 2, "0.005")
                        .otherwise("0.5")) \
        .withColumn("token_count", F.when(conv % 5 == 3, "300").otherwise(F.col("token_count"))) \
        .withColumn("store", F.when(turn % 4 == 2, "other").otherwise(F.col("store")))
    probs = P.settings_problems(F.col("temperature"), F.col("token_count"), F.col("store"), STORES)
    return sent.withColumn("_p", probs).filter(F.size("_p") > 0).select(
        "question_id", "temperature", "token_count", "store", F.array_join("_p", "; ").alias("problems"))


def upload_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N22 (second form), N23: the upload app's answers with its fixed source
    note, and the previews of the context it shows."""
    best = retrieval.best_context(spark, sf_dir).select("question_id", "context")
    q = TB.user_questions(spark, sf_dir).join(best, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    rq = q.withColumn("prompt", P.hosted_prompt("text", "context", form="upload"))
    rq = rq.withColumn("body", F.to_json(P.request_hosted(F.col("prompt"), F.lit(0.5), F.lit(250))))
    out = G.call_model(rq, "body", G.hosted_echo, "hosted-echo")
    reply = P.strip_echo(P.parse_hosted("response"), F.col("prompt"))
    return out.select("question_id", F.substring("context", 1, 10).alias("preview_10"), F.substring("context", 1, 4).alias("preview_4"),
                      P.with_source_note(reply).alias("answer"))


# Second hosted request form (no retrieval): fixed settings of the notebook.
PLAIN_TEMPERATURE, PLAIN_MAX_NEW_TOKENS, PLAIN_REPETITION_PENALTY = 0.0, 50, 0.5


def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt form of the apps for each user question
    with its best context (Q5); prompts are reported by length and MD5."""
    best = retrieval.best_context(spark, sf_dir).select("question_id", "context")
    q = TB.user_questions(spark, sf_dir).join(best, "question_id", "left") \
        .withColumn("context", F.coalesce("context", F.lit("")))
    forms = {
        "prototype": P.prototype_prompt("text", "context"),
        "upload": P.hosted_prompt("text", "context", form="upload"),
        "upload_plain": P.hosted_prompt("text", F.lit(""), form="upload"),
        "tagged": P.plain_prompt("text", tagged=True),
        "untagged": P.plain_prompt("text", tagged=False),
    }
    cols = []
    for name, expr in forms.items():
        cols += [F.length(expr).cast("bigint").alias(f"{name}_chars"), F.md5(expr).alias(f"{name}_md5")]
    body = F.to_json(P.request_hosted(P.plain_prompt("text", tagged=False), F.lit(PLAIN_TEMPERATURE),
                                      F.lit(PLAIN_MAX_NEW_TOKENS), PLAIN_REPETITION_PENALTY))
    req = F.from_json(body, "request struct<prompt string, temperature double, max_new_tokens int, "
                            "repetition_penalty double>")["request"]
    return q.select("question_id", *cols, req["max_new_tokens"].alias("max_new_tokens"),
                    req["repetition_penalty"].alias("repetition_penalty"))


def chat_model():
    """Default model for the routed job: dispatches on the body shape."""
    comp, host = G.completion_echo(), G.hosted_echo()

    def run(bodies: list[str]) -> list[str]:
        return [host([b])[0] if "request" in json.loads(b) else comp([b])[0] for b in bodies]
    return run


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: route every question by (model × store), retrieve, prompt, call the
    model, parse, and add the source reference (F11, F12, U1, N11, N14, G1–G4,
    N21, N22)."""
    q = questions(spark, sf_dir)
    # question vectors feed both searches (each sizes, then collects them)
    qv = cut_lineage(retrieval.question_vectors_of(q).join(q.select("question_id", "embedding_model"),
                                                           "question_id"))

    # Each store feeds its search and the join back to its records: build it
    # once and keep it in the shared checkpoint folder (as an index job would).
    # First store: cosine top-5, best hit, context read from the document file.
    a_idx = written(indexing.first_store(spark, sf_dir)
                    .select("id", "embedding", "file_path", "embedding_model"), "answer-first")
    a_hits, _ = S.search_same_model(a_idx.select("id", "embedding", "embedding_model"),
                                          qv.join(q.filter(F.col("store") == "first").select("question_id"),
                                                  "question_id", "left_semi"), k=5, metric="cosine")
    # the hits have a measured size; small ones are broadcast and the index
    # and document tables stream through the joins
    a_best = written(S.best_hit(a_hits), "answer-hits").join(a_idx.select("id", "file_path"), "id")
    docs = TB.documents(spark, sf_dir).select("path", "text")
    a_ctx = written(a_best.select("question_id", "file_path"), "answer-paths").join(docs, F.col("file_path") == F.col("path"), "left").select(
        "question_id", F.coalesce("text", F.lit("")).alias("context"), F.col("file_path").alias("source"))

    # Second store: squared-L2 top-1, context is the stored document.
    b_idx = written(indexing.second_store(spark, sf_dir)
                    .select("id", "embedding", "document", "embedding_model"), "answer-second")
    b_hits, _ = S.search_same_model(b_idx.select("id", "embedding", "embedding_model"),
                                          qv.join(q.filter(F.col("store") == "second").select("question_id"),
                                                  "question_id", "left_semi"), k=1, metric="l2")
    b_ctx = written(S.best_hit(b_hits), "answer-hits").join(b_idx.select("id", "document"), "id").select(
        "question_id", F.col("document").alias("context"), F.col("id").alias("source"))

    none = q.filter(F.col("store") == "none").select("question_id", F.lit("").alias("context"),
                                                     F.lit(None).cast("string").alias("source"))
    ctx = cut_lineage(none.unionByName(a_ctx).unionByName(b_ctx))
    rq = q.join(ctx, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.when(F.col("model") == "completion", P.completion_prompt("text", "context")) \
        .otherwise(P.hosted_prompt("text", "context"))
    rq = rq.withColumn("prompt", prompt)
    body = F.when(F.col("model") == "completion",
                  F.to_json(P.request_completion(F.col("prompt"), F.col("token_count"), F.col("temperature")))) \
        .otherwise(F.to_json(P.request_hosted(F.col("prompt"), F.col("temperature"), F.col("token_count"))))
    out = G.call_model(rq.withColumn("body", body), "body", chat_model, "chat-echo")
    reply = F.when(F.col("model") == "completion", P.parse_completion("response")) \
        .otherwise(P.strip_echo(P.parse_hosted("response"), F.col("prompt")))
    answer = F.when((F.col("store") == "none") | F.col("source").isNull(), reply) \
        .otherwise(P.with_reference(reply, U.url_from_source(F.col("source"))))
    return out.select("question_id", "model", "store", "source",
                      F.length("prompt").cast("bigint").alias("prompt_chars"),
                      answer.alias("answer"), "error")
