"""Calling engines behind a service: requests of a table, a bounded number of them in flight, answers and errors as columns.

A transport is a function of (body, attempt) that returns (status, text), or raises TimeoutError or OSError. It runs in the tasks'
Python, so it has to be picklable; http() makes one. What is asked in the same words is asked once, whatever the number of rows.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..sources.shared import settled

Transport = Callable[[str, int], tuple[int, str]]
#: Kinds of errors. Those of PASSING may be gone when one asks again.
PASSING = ("timeout", "unreachable", "throttled", "failed")
KINDS = (*PASSING, "rejected", "malformed")


def http(url: str, headers: dict[str, str], seconds: float = 60.0) -> Transport:
    """Posts the body, as JSON unless headers say otherwise; an answer that is an error has its status and text."""

    def send(body: str, attempt: int) -> tuple[int, str]:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310  the caller's own address
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            with e:
                return e.code, e.read().decode("utf-8", "replace")

    return send


def asked(transport: Transport, body: str, retries: int, pause: float) -> tuple[str | None, str | None, str | None, int]:
    """(reply, error, message, attempts): an error of PASSING is tried again up to `retries` times, after pauses that double."""
    attempt = 0
    while True:
        reply = error = message = None
        try:
            status, text = transport(body, attempt)
            if 200 <= status < 300:
                reply = text
            else:
                error = "throttled" if status == 429 else "failed" if status >= 500 else "timeout" if status == 408 else "rejected"
                message = f"{status}: {text[:500]}"
        except TimeoutError as e:
            error, message = "timeout", str(e)[:500]
        except OSError as e:
            error = "timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "unreachable"
            message = str(e)[:500]
        attempt += 1
        if error not in PASSING or attempt > retries:
            return reply, error, message, attempt
        time.sleep(pause * 2 ** (attempt - 1))


def in_order(bodies: Iterable[str], transport: Transport, in_flight: int, retries: int, pause: float) -> Iterator[tuple]:
    """asked() of each body, in their order, at most in_flight at a time; the next one starts as soon as one is through."""
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque[Future] = deque()
        for body in bodies:
            waiting.append(pool.submit(asked, transport, body, retries, pause))
            if len(waiting) >= 4 * in_flight:  # answers that wait for a slow one before them are bounded too
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def called(rows: DataFrame, body: Column, transport: Transport, in_flight: int = 8, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """rows with reply, error (one of KINDS, null without one), message and attempts of the request that body says.

    Equal bodies are one request; answers are a table in the shared folder, so that nothing is asked again when a later
    job reads them or an executor is lost. A null body is not asked: all four are null. Each task has in_flight requests
    under way. Columns of these names are replaced.
    """
    rows = rows.drop("reply", "error", "message", "attempts").withColumn("_body", body)
    todo = rows.select("_body").filter("_body is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("_body", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("message", pa.string()), ("attempts", pa.int32())]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                bodies = b["_body"].slice(at, 256).to_pylist()
                found = list(zip(bodies, *zip(*in_order(bodies, transport, in_flight, retries, pause))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found), kinds)], [n for n, _ in kinds])

    answers = settled(todo.mapInArrow(run, "_body string, reply string, error string, message string, attempts int"), "answers")
    return rows.join(answers, "_body", "left").drop("_body")


def _checked(rows: DataFrame, text: Column, column: str, strict: bool) -> DataFrame:
    """rows(reply, error) with column from the reply; a reply without it is malformed. strict: an error ends the job."""
    bare = F.col("reply").isNotNull() & text.isNull()
    error = F.when(bare, "malformed").otherwise(F.col("error"))
    said = F.when(bare, F.substring("reply", 1, 500)).otherwise(F.col("message"))
    out = rows.withColumns({column: text, "error": error, "message": said})
    if strict:
        ends = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error"), F.lit(": "), F.coalesce("message", F.lit("")))).cast("string"))
        out = out.withColumn("error", ends)
    return out


def chat_body(messages: Column, model: str, temperature: float = 0.2) -> Column:
    """The JSON of a chat completion's request."""
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature")))


def chat_translator(transport: Transport, model: str, source_lang: str, target_lang: str, style: str = "balanced", strict: bool = True, **how) -> Callable[[DataFrame], DataFrame]:
    """An engine for translate_stage: rows(source, preceding, following, terms) with translation and translation_confidence.

    Blank sources are not sent. With strict an error that retries do not mend ends the job, so that no page counts as
    translated that is not; without it such rows have no translation, and error and message tell why.
    """

    def translate(rows: DataFrame) -> DataFrame:
        messages = prompts.translation_messages(F.col("source"), F.col("preceding"), F.col("following"), F.col("terms"), source_lang, target_lang, style)
        sent = F.when(F.trim("source") != "", chat_body(messages, model))
        done = _checked(called(rows, sent, transport, **how), prompts.chat_text(F.col("reply")), "translation", strict)
        return done.withColumn("translation_confidence", F.lit(None).cast("double"))

    return translate


def service_translator(transport: Transport, source_lang: str, target_lang: str, strict: bool = True, **how) -> Callable[[DataFrame], DataFrame]:
    """An engine like chat_translator for a translation service, which is sent the source alone."""

    def translate(rows: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(F.array("source").alias("text"), F.lit(prompts.service_language(source_lang)).alias("source_lang"), F.lit(prompts.service_language(target_lang)).alias("target_lang")))
        done = _checked(called(rows, F.when(F.trim("source") != "", body), transport, **how), prompts.translations_text(F.col("reply")), "translation", strict)
        return done.withColumn("translation_confidence", F.lit(None).cast("double"))

    return translate


def chat_corrector(transport: Transport, model: str, source_lang: str, most: int = 3, strict: bool = True, **how) -> Callable[[DataFrame], DataFrame]:
    """An engine for ocr_correct_stage: rows(text) with proposed; a reply without a JSON object is malformed."""

    def correct(rows: DataFrame) -> DataFrame:
        sent = chat_body(prompts.correction_messages(F.col("text"), source_lang, most), model)
        reply = prompts.chat_text(F.col("reply"))
        return _checked(called(rows, sent, transport, **how), prompts.corrected(reply, most)["alternatives"], "proposed", strict)

    return correct
