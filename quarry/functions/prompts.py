"""Prompt templates and request/response JSON (N11–N18, N21–N24, G1–G5,
F12, M7, M8).

Two fill rules exist and are kept apart:

* ``fill_chain`` – literal ``replace`` of each placeholder in turn (N11): a
  question that itself holds ``{{CONTEXT}}`` is filled too.  Never
  ``regexp_replace``: ``$`` and ``\\`` in a context would be interpreted.
* ``fill_once`` – the template is cut at its placeholders and the pieces are
  concatenated, like a Python f-string: inserted text is never re-scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# ============================ fixed values ====================================
# Instruction prompts of the completion-style model (request body 1).
COMPLETION_NO_CONTEXT = (
    "Human: You are a helpful, honest, and courteous assistant. If you don't know the answer, simply "
    "state I don't know the answer to that question. Please provide an honest response to the user "
    "question enclosed in <question></question> tags. Do not repeat the question in the output.\n"
    "    \n    <question>{{QUESTION}}</question>\n                    Assistant:")
COMPLETION_WITH_CONTEXT = (
    "Human: You are a helpful, honest, and courteous assistant. If you don't know the answer, simply "
    "state I don't know the answer to that question. Please read the text provided between the tags "
    "<text></text> and provide an honest response to the user question enclosed in <question></question> "
    "tags. Do not repeat the question in the output.\n    <text>{{CONTEXT}}</text>\n    \n"
    "    <question>{{QUESTION}}</question>\n                    Assistant:")
# Summary prompt.
SUMMARY = (
    "Human: Please provide a summary of the text inside <text></text> XML tags. Do not add any "
    "information that is not mentioned in this text. \n                             Provide no more "
    "than 3 bullet points in the summary, each being a complete sentece. \n                             "
    "Start your summary with simply saying \"Here's a brief summary of the provided text:\". \n"
    "                    <text>{{USER_TEXT}}</text>\n                    Assistant:")
# Hosted instruction model, final chat app.
HOSTED_SYS = ("<s>[INST]You are a helpful, respectful and honest assistant. If you are unsure about an "
              "answer, truthfully say \"I don't know\".")
HOSTED_NO_CONTEXT = "{sys} Please answer the user question.[/INST]</s> \n [INST] {question} [/INST]"
HOSTED_WITH_CONTEXT = ("{sys} Anser the user's question based on the folloing information:\n {context}"
                       "[/INST]</s> \n[INST] {question} [/INST]")
# Same, upload app (N15): single quotes, no line break before the context.
UPLOAD_SYS = ("<s>[INST]You are a helpful, respectful and honest assistant. If you are unsure about an "
              "answer, truthfully say 'I don't know'.")
UPLOAD_NO_CONTEXT = "{sys} Please answer the user question.[/INST]</s> [INST] {question} [/INST]"
UPLOAD_WITH_CONTEXT = ("{sys} Anser the user's question based on the folloing information: {context}"
                       "[/INST]</s> \n[INST] {question} [/INST]")
# Prototype app.
PROTOTYPE = ("<<SYS>>\n You are a helpful, respectful and honest assistant. If you are unsurae about an "
             "answer, truthfully say \"I don't know\".\n<</SYS>>\n\n [INST]Use your own knowledge and "
             "additionally use the following information to answer the user's question: {context} "
             "[/INST] [INST] User: Answer this question based on the given context. Question: {question} "
             "[/INST]")
# Hosted model without retrieval, two forms.
PLAIN_TAGGED = ("<<SYS>>\n You are a helpful and honest assistant. If you are unsure about an answer, "
                "truthfully say \"I don't know\".\n<</SYS>>\n\n [INST]Use your knowledge to answer the "
                "user's question. [/INST] [INST] User: {question} [/INST]")
PLAIN_UNTAGGED = ("You are a helpful and honest assistant. If you are unsure about an answer, truthfully "
                  "say \"I don't know\". Use your knowledge to answer the user's question. Please see "
                  "question below: {question}")
# Retrieval QA chain prompt.
QA_CHAIN = ("You are a helpful AI assistant. Use only the below provided Context to answer the following "
            "question. If you do not know the answer respond with \"I don't know.\"\nContext:{context}\n"
            ">>QUESTION<<{question}\n>>ANSWER<<")
# Few-shot sentiment prompts.
FEW_SHOT = {
    "prompt_1": ("Review: The movie was horrible\nSentiment: Negative\n\nReview: The movie was the best "
                 "movie I have watched all year!!!\nSentiment: Positive\n\nReview: The film was a disaster\n"
                 "Sentiment: Negative\n\nReview: {review}\nSentiment:"),
    "prompt_2": ("Review: This has been the worst trade deal in the history of trade deals, maybe ever\n"
                 "  Sentiment: Negative\n\n  Review: Amazing introduction assignment on how to use large "
                 "language models\n  Sentiment: Positive\n\n  Review: This code is full of bugs, it's "
                 "impossible to run it\n  Sentiment: Negative\n\n  Review: {review}\n  Sentiment:"),
    "prompt_3": ("The sentiment of the sentence \"I hate this world.\" is negative\n\n  The sentiment of the "
                 "sentence \"I love you all!\" is positive\n\n  The sentiment of the sentence \"It will "
                 "never work.\" is negative\n\n  The sentiment of the sentence {review} is"),
}
# Request body 1 constants (G1) and body 2 repetition penalty.
TOP_K = 250
TOP_P = 1.0
REPETITION_PENALTY = 1.0
# Answer suffixes.
SEE_ALSO = "\n\n For additional info see: "
SEE_BELOW = "\n\n For additional info see source information below"
# Cut of the echoed prompt in hosted responses.
ECHO_CUT = 6
# Stated prompt window of the completion model, in words.
PROMPT_WINDOW_WORDS = 9000
# Settings domain (M8).
TOKEN_CHOICES = ("50", "100", "250", "500", "1000")
TEMPERATURE_MIN, TEMPERATURE_MAX = 0.01, 1.0
# Upload status line (K9).
UPLOAD_STATUS = "File {name} has been uploaded and moved to 'staged_files'."
# =============================================================================


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_chain(template: str, *pairs: tuple[str, Column]) -> Column:
    """Literal replace of each placeholder in the given order."""
    out = F.lit(template)
    for ph, val in pairs:
        out = F.replace(out, F.lit(ph), _c(val))
    return out


_PH = re.compile(r"\{([a-z_]+)\}")


def fill_once(template: str, **values) -> Column:
    """f-string fill: ``{name}`` placeholders, inserted text not re-scanned."""
    parts: list[Column] = []
    pos = 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(F.lit(v) if isinstance(v, str) and m.group(1) == "sys" else _c(v))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def completion_prompt(question, context) -> Column:
    """N14 (completion model) with the F12 branch on an empty context."""
    q, c = _c(question), _c(context)
    return F.when(c == "", fill_chain(COMPLETION_NO_CONTEXT, ("{{QUESTION}}", q), ("{{CONTEXT}}", c))) \
        .otherwise(fill_chain(COMPLETION_WITH_CONTEXT, ("{{QUESTION}}", q), ("{{CONTEXT}}", c)))


def hosted_prompt(question, context, form: str = "final") -> Column:
    """N14 / N15 (hosted instruction model) with the F12 branch."""
    if form == "final":
        sys_, t0, t1 = HOSTED_SYS, HOSTED_NO_CONTEXT, HOSTED_WITH_CONTEXT
    elif form == "upload":
        sys_, t0, t1 = UPLOAD_SYS, UPLOAD_NO_CONTEXT, UPLOAD_WITH_CONTEXT
    else:
        raise ValueError("form must be 'final' or 'upload'")
    q, c = _c(question), _c(context)
    return F.when(c == "", fill_once(t0, sys=sys_, question=q)) \
        .otherwise(fill_once(t1, sys=sys_, question=q, context=c))


def prototype_prompt(question, context) -> Column:
    """N13."""
    return fill_once(PROTOTYPE, question=_c(question), context=_c(context))


def plain_prompt(question, tagged: bool = True) -> Column:
    """N16."""
    return fill_once(PLAIN_TAGGED if tagged else PLAIN_UNTAGGED, question=_c(question))


def summary_prompt(text) -> Column:
    """N12."""
    return fill_chain(SUMMARY, ("{{USER_TEXT}}", _c(text)))


def qa_chain_prompt(question, context) -> Column:
    """N17."""
    return fill_once(QA_CHAIN, question=_c(question), context=_c(context))


def few_shot_prompt(name: str, review) -> Column:
    """N18."""
    return fill_once(FEW_SHOT[name], review=_c(review))


# ---- request / response JSON ----------------------------------------------
def request_completion(prompt, max_tokens, temperature) -> Column:
    """G1 body as a struct (``to_json`` of it is the wire form)."""
    return F.struct(_c(prompt).alias("prompt"),
                    _c(max_tokens).cast("int").alias("max_tokens_to_sample"),
                    _c(temperature).cast("double").alias("temperature"),
                    F.lit(TOP_K).alias("top_k"), F.lit(TOP_P).alias("top_p"),
                    F.array().cast("array<string>").alias("stop_sequences"))


def request_hosted(prompt, temperature, max_new_tokens, repetition_penalty: float = REPETITION_PENALTY) -> Column:
    """G2 body: ``{"request": {prompt, temperature, max_new_tokens, repetition_penalty}}``."""
    return F.struct(F.struct(_c(prompt).alias("prompt"), _c(temperature).alias("temperature"),
                             _c(max_new_tokens).alias("max_new_tokens"),
                             F.lit(repetition_penalty).alias("repetition_penalty")).alias("request"))


COMPLETION_RESPONSE = StructType([StructField("completion", StringType())])


def parse_completion(resp) -> Column:
    """``completion`` of response body 1 (null when missing or not JSON)."""
    return F.from_json(_c(resp), COMPLETION_RESPONSE, {"mode": "PERMISSIVE"})["completion"]


def parse_hosted(resp) -> Column:
    """``response.prediction.response`` of response body 2."""
    return F.get_json_object(_c(resp), "$.response.prediction.response")


def strip_echo(resp, prompt) -> Column:
    """Drop the echoed prompt but its last six characters."""
    return F.substring(_c(resp), F.length(_c(prompt)) - (ECHO_CUT - 1), F.lit(1 << 30))


def with_reference(answer, reference) -> Column:
    """Answer plus a pointer to its source."""
    return F.concat(_c(answer), F.lit(SEE_ALSO), _c(reference))


def with_source_note(answer) -> Column:
    """N22, upload-app form: a fixed pointer to the source panel."""
    return F.concat(_c(answer), F.lit(SEE_BELOW))


def fits_window(prompt, limit: int = PROMPT_WINDOW_WORDS) -> Column:
    """Prompt word count within the model window."""
    from .text import word_count
    return word_count(prompt) <= limit


def settings_problems(temperature, token_count, store, stores: tuple[str, ...]) -> Column:
    """M7 + M8: array of problems with a question's settings (empty = valid)."""
    t = _c(temperature).try_cast("double")
    n = _c(token_count)
    cents = F.round(t * 100)
    return F.filter(F.array(
        F.when(t.isNull(), F.lit("temperature is not a number")),
        F.when(t.isNotNull() & ((t < TEMPERATURE_MIN) | (t > TEMPERATURE_MAX)), F.lit("temperature out of range")),
        F.when(t.isNotNull() & (F.abs(t * 100 - cents) > 1e-9), F.lit("temperature not in steps of 0.01")),
        F.when(~F.coalesce(n.isin(*TOKEN_CHOICES), F.lit(False)), F.lit("token count not offered")),
        F.when(~F.coalesce(_c(store).isin(*stores), F.lit(False)), F.lit("unknown vector store"))),
        lambda x: x.isNotNull())
