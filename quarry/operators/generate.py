"""Model calls as a plug-in (Y2), and the deterministic default models.

``call_model`` sends a JSON request column through ``model(list[str]) ->
list[str]`` in Arrow batches; no other column goes to Python.  The model is built once per
Python worker.  A failing batch is retried a bounded number of times, then
row by row; a row that still fails gets ``response = null`` and the error
text in ``error`` (the reference handed the exception object back as the
answer).  No network client ships here; real endpoints plug in through
``loader``.

The default models are pure functions of the request so every pipeline runs
offline and can be checked by SQL:

* ``completion_echo`` answers body 1 with
  ``{"completion": " Echo: " + last 40 characters of the prompt}``.
* ``hosted_echo`` answers body 2 like a text-generation server: the prompt
  followed by the generated text, ``prompt + " Echo: " + last 40 chars``.
* ``sentiment_stub`` continues a few-shot prompt with one word chosen by the
  prompt length mod 3: ``Positive``, ``negative`` or ``maybe``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ECHO_TAIL = 40
_MODELS: dict[str, Callable[[list[str]], list[str]]] = {}


def completion_echo() -> Callable[[list[str]], list[str]]:
    def run(bodies: list[str]) -> list[str]:
        out = []
        for b in bodies:
            p = json.loads(b)["prompt"]
            out.append(json.dumps({"completion": " Echo: " + p[-ECHO_TAIL:]}))
        return out
    return run


def hosted_echo() -> Callable[[list[str]], list[str]]:
    def run(bodies: list[str]) -> list[str]:
        out = []
        for b in bodies:
            p = json.loads(b)["request"]["prompt"]
            out.append(json.dumps({"response": {"prediction": {"response": p + " Echo: " + p[-ECHO_TAIL:]}}}))
        return out
    return run


SENTIMENT_WORDS = ("Positive", "negative", "maybe")


def sentiment_stub() -> Callable[[list[str]], list[str]]:
    def run(prompts: list[str]) -> list[str]:
        return [p + " " + SENTIMENT_WORDS[len(p) % 3] for p in prompts]
    return run


def call_model(df: DataFrame, request_col: str, loader: Callable[[], Callable[[list[str]], list[str]]],
               name: str, out_col: str = "response", error_col: str = "error",
               max_tries: int = 3, pause_s: float = 0.0) -> DataFrame:
    """Y2: add ``out_col`` (model reply) and ``error_col`` for every row."""
    # two loaders of one name are two models
    key = f"{name}:{hashlib.sha1(cloudpickle.dumps(loader)).hexdigest()}"

    def model():
        m = _MODELS.get(key)
        if m is None:
            m = _MODELS[key] = loader()
        return m

    def replies(m, bodies):
        got = list(m(bodies)) if bodies else []
        if len(got) != len(bodies):
            raise ValueError(f"the model gave {len(got)} replies to {len(bodies)} requests")
        return got

    def one(m, body):
        last = None
        for _ in range(max_tries):
            try:
                return replies(m, [body])[0], None
            except Exception as e:  # noqa: BLE001 - errors become data
                last = e
                if pause_s:
                    time.sleep(pause_s)
        return None, f"{type(last).__name__}: {last}"

    # not deterministic for the planner: the model is called once for each row
    @F.pandas_udf(StructType([StructField("response", StringType()), StructField("error", StringType())]))
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model()
        for column in batches:
            bodies = column.tolist()
            live = [i for i, b in enumerate(bodies) if b is not None]
            resp: list = [None] * len(bodies)
            err: list = [None] * len(bodies)
            done = False
            for _ in range(max_tries):
                try:
                    for i, r in zip(live, replies(m, [bodies[i] for i in live])):
                        resp[i] = r
                    done = True
                    break
                except Exception:  # noqa: BLE001
                    if pause_s:
                        time.sleep(pause_s)
            if not done:
                for i in live:
                    resp[i], err[i] = one(m, bodies[i])
            yield pd.DataFrame({"response": pd.Series(resp, dtype=object), "error": pd.Series(err, dtype=object)})

    reply = "_reply"
    called = df.withColumn(reply, call.asNondeterministic()(F.col(request_col)))
    return called.select(*[F.col(c) for c in df.columns if c not in (out_col, error_col)],
                         F.col(f"{reply}.response").alias(out_col), F.col(f"{reply}.error").alias(error_col))
