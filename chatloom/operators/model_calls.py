"""Model calls as pluggable functions with retries, several in flight at once; stubs answer offline.

A client is made once per partition. A request is a list of one prompt and the number of the attempt; with ports, also that which the
request shall use. For its prompt the client gives an answer (a text, or a :class:`Reply` with the tokens that it used), nothing, or the
exception that befell it, which it may raise too. With a window of more than one request it is called from several threads.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.operators.in_flight import Ports, answered
from chatloom.runtime import ship


@dataclass(frozen=True)
class Reply:
    text: str | None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class Rejected(Exception):
    """A request that will never be answered, as the service says: it is not sent again."""


Client = Callable[..., list]
#: Fixed value: what stands for a response that could not be had.
FALLBACK = "Failed to generate response."
_USAGE = [T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("total_tokens", T.LongType())]


def route(model: Column) -> Column:
    """Which client serves a model, by its name's begin in lower case; others go to a server of one's own."""
    name = F.lower(model)
    return F.when(name.startswith("claude"), "claude").when(name.startswith("gpt"), "gpt").when(name.startswith("gemini"), "gemini").otherwise("local")


def is_hosted(model: Column) -> Column:
    return route(model) != "local"


def _pause(wait: float, n: int, jitter: float) -> None:
    if wait or jitter:
        time.sleep(wait * 2**n + random.uniform(0, jitter))


def sender(client: Callable[[], Client], ports: list[int] | None) -> Callable[..., Reply | Exception]:
    """A function that sends one prompt and gives the reply, or the exception that came instead."""
    ask, free = client(), Ports(ports) if ports else None

    def send(prompt: str, *more) -> Reply | Exception:
        try:
            if free is None:
                (got,) = ask([prompt], *more)
            else:
                with free.one() as port:
                    (got,) = ask([prompt], *more, port)
        except Exception as e:  # noqa: BLE001  reported with the row
            return e
        return got if isinstance(got, Reply | Exception) else Reply(got)

    # a client may take the prompts only
    takes = getattr(getattr(ask, "__code__", None), "co_argcount", 2)
    return send if takes > 1 or free else lambda prompt, *_: send(prompt)


def call(
    rows: DataFrame, prompt: str, answer: str, client: Callable[[], Client], attempts: int = 4, wait: float = 0.0, jitter: float = 0.0,
    fallback: str | None = None, usage: bool = False, strict: bool = False, check: Callable[[str], bool] | None = None, window: int = 1, ports: list[int] | None = None,
) -> DataFrame:
    """``rows`` with ``answer``, ``status`` ("ok" or "failed") and ``error``; with ``usage`` also three token counts.

    A partition has ``window`` requests in flight at most, on the ``ports`` with the fewest; answers come in the rows' order.
    Empty answers, and such as ``check`` refuses, are asked for again at once, at most ``attempts`` times in all; after an exception the
    row, and no other, pauses for ``wait * 2**n`` and a random part of ``jitter``, and :class:`Rejected` ends it. What has no answer then
    gets ``fallback``, and the last exception's text as ``error``; ``strict`` raises it instead. Token counts are those of the last reply.
    """
    ship(rows.sparkSession)
    names = rows.columns
    made = [T.StructField(answer, T.StringType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), *(_USAGE if usage else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = sender(client, ports)

        def one(row: tuple) -> tuple[str | None, str | None, Reply]:
            used, error = Reply(None), None
            for n in range(attempts):
                r = send(row[0], n)
                if isinstance(r, Exception):
                    error = f"{type(r).__name__}: {r}"
                    if isinstance(r, Rejected):
                        break
                    if n + 1 < attempts:
                        _pause(wait, n, jitter)
                    continue
                used = r
                if r.text and (check is None or check(r.text)):
                    return r.text, None, used
            if strict:
                raise RuntimeError(f"no answer after {attempts} attempts: {error or 'it was empty'}")
            return None, error, used

        for b, got in answered(batches, [prompt], one, window):
            cols = [pa.array([a or fallback for a, _, _ in got], pa.string()), pa.array(["ok" if a else "failed" for a, _, _ in got], pa.string()), pa.array([e for _, e, _ in got], pa.string())]
            if usage:
                used = [u for _, _, u in got]
                total = [None if u.prompt_tokens is None or u.completion_tokens is None else u.prompt_tokens + u.completion_tokens for u in used]
                cols += [pa.array([u.prompt_tokens for u in used], pa.int64()), pa.array([u.completion_tokens for u in used], pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], *cols], [*names, *(f.name for f in made)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *made]))


def respond(rows: DataFrame, prompt: str, client: Callable[[], Client], attempts: int = 8, **options) -> DataFrame:
    """Responses with token counts; a fixed text where there is none."""
    return call(rows, prompt, "response", client, attempts, fallback=FALLBACK, usage=True, **options)


Checker = Callable[[Column], tuple[Column, Column]]
_CHECKERS: dict[str, Checker] = {}


def register_checker(name: str, checker: Checker) -> None:
    """A safety checker: of a text column it makes (is it safe, a report)."""
    _CHECKERS[name] = checker


def safety_checks(rows: DataFrame, text: str, enabled: list[str]) -> DataFrame:
    """``rows`` once for each enabled checker, with ``checker``, ``is_safe`` and ``report``."""
    unknown = [n for n in enabled if n not in _CHECKERS]
    if unknown:
        raise KeyError(f"no safety checker {unknown[0]!r}")
    made = []
    for name in enabled:
        safe, report = _CHECKERS[name](F.col(text))
        made.append(F.struct(F.lit(name).alias("checker"), safe.alias("is_safe"), report.cast("string").alias("report")))
    return rows.withColumn("__c", F.explode(F.array(*made))).select(*rows.columns, "__c.*")


def _stub() -> Client:
    return lambda texts: [f"You are a user chatting with an assistant language model to {t}" for t in texts]


def stub_intents(first_turns: DataFrame) -> DataFrame:
    """conv_id, intent, status from the offline client."""
    return call(first_turns, "text", "intent", _stub, jitter=0.0).select("conv_id", "intent", "status")
