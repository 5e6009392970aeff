"""Steps that may fail, and text generation: errors become data, never a failed job."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexiflume.functions.text import chosen_letters, tokens

# The answer that stands for an error, and the wait between attempts in seconds.
ERROR_ANSWER = "[Lỗi sinh câu trả lời: {}]"
FIRST_WAIT, LONGEST_WAIT = 2.0, 15.0
#: How the error of a call that took too long begins.
TOO_LONG = "Timeout: "
#: Texts of an Arrow batch that are Python strings at once.
AT_ONCE = 500


def wait_before(attempt: int) -> float:
    """Seconds to wait after the given attempt failed: doubled each time up to the longest."""
    return min(FIRST_WAIT * 2 ** (attempt - 1), LONGEST_WAIT)


def with_retry(call: Callable[[str], str], attempts: int = 3, spacing: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """The call, at least ``spacing`` seconds after the one before, tried again after errors; the last error is raised."""
    last = [0.0]

    def run(prompt: str) -> str:
        gap = spacing - (time.monotonic() - last[0])
        if last[0] and gap > 0:
            sleep(gap)
        last[0] = time.monotonic()
        for attempt in range(1, attempts + 1):
            try:
                return call(prompt)
            except Exception:
                if attempt == attempts:
                    raise
                sleep(wait_before(attempt))
        raise ValueError("attempts must be at least 1")

    return run


class TooLong(TimeoutError):
    """A call took longer than it may."""


def limited(call: Callable[[str], str], seconds: float) -> Callable[[str], str]:
    """The call, which fails after so many seconds (E16). It runs in a thread of its own, which goes on by itself if it is late; later calls don't wait for it."""

    def run(text: str) -> str:
        got: queue.Queue = queue.Queue(1)

        def work() -> None:
            try:
                got.put((call(text), None))
            except Exception as e:
                got.put((None, e))

        threading.Thread(target=work, daemon=True).start()
        try:
            value, error = got.get(timeout=seconds)
        except queue.Empty:
            raise TooLong(f"{TOO_LONG}{seconds:g}s") from None
        if error:
            raise error
        return value

    return run


def attempted(c: Column | str, call: Callable[[str], str]) -> Column:
    """struct(value, error, latency_ms) of the call on each text; one failing row leaves the others alone."""

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), AT_ONCE):
            rows = []
            for text in texts.slice(at, AT_ONCE).to_pylist():
                began, value, error = time.perf_counter(), None, None
                try:
                    value = call(text)
                except Exception as e:
                    error = str(e) or type(e).__name__
                rows.append({"value": value, "error": error, "latency_ms": round((time.perf_counter() - began) * 1000, 2)})
            parts.append(pa.array(rows, kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    kind = pa.struct([("value", pa.string()), ("error", pa.string()), ("latency_ms", pa.float64())])
    return F.arrow_udf(run, "value string, error string, latency_ms double")(c)


def chained(df: DataFrame, column: str, steps: list[tuple[str, Callable[[str], str]]]) -> DataFrame:
    """The steps one after another on a text column (R17): "base" is passed over, and where a step fails the value before stays. Adds errors,
    an array of "name: message"."""
    out = df.withColumn("errors", F.array().cast("array<string>"))
    for name, call in steps:
        if name != "base":
            out = out.withColumn("_tried", attempted(column, call))
            failed = F.col("_tried.error")
            out = out.withColumn("errors", F.when(failed.isNotNull(), F.array_append("errors", F.concat(F.lit(f"{name}: "), failed))).otherwise(F.col("errors")))
            out = out.withColumn(column, F.when(failed.isNull(), F.col("_tried.value")).otherwise(F.col(column))).drop("_tried")
    return out


def first_sentence(prompt: str) -> str:
    """Stand-in for a model: the first line of the prompt's context."""
    inside = prompt.partition("<context>\n")[2].partition("\n</context>")[0]
    return inside.strip().split("\n")[0]


def answers(prompts: DataFrame, call: Callable[[str], str] = first_sentence) -> DataFrame:
    """prompts (query_id, prompt, ...): answer, failed, latency_ms; an error becomes the answer's text."""
    tried = prompts.withColumn("_tried", attempted("prompt", call))
    lead, tail = ERROR_ANSWER.split("{}")
    answer = F.when(F.col("_tried.error").isNull(), F.coalesce("_tried.value", F.lit(""))).otherwise(F.concat(F.lit(lead), F.col("_tried.error"), F.lit(tail)))
    return tried.withColumns({"answer": answer, "failed": F.col("_tried.error").isNotNull(), "latency_ms": F.col("_tried.latency_ms")}).drop("_tried")


def choice_prompt(question: Column | str, passages: Column | str, longest: int = 1200) -> Column:
    """Question and lettered passages, each on one line and cut."""
    lined = F.transform(passages, lambda p, i: F.concat(F.char(i + 65), F.lit(". "), F.translate(F.substring(p, 1, longest), "\n", " ")))
    return F.concat(F.lit("Question: "), F.translate(question, "\n", " "), F.lit("\n"), F.array_join(lined, "\n"))


def overlap_choice(prompt: str) -> str:
    """Stand-in for a model: letters of the passages that share most words with the question, best first."""
    lines = prompt.split("\n")
    words = set(lines[0].lower().split()[1:])
    shared = [(-len(words & set(x.lower().split()[1:])), x[:1]) for x in lines[1:]]
    return "Correct Answer: " + ", ".join(letter for n, letter in sorted(shared) if n < 0)


def multi_choice(rows: DataFrame, call: Callable[[str], str] = overlap_choice, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows (query, passages): choices, the places of the passages that the model names, in its order; none where it fails."""
    tried = rows.withColumn("_tried", attempted(choice_prompt(F.col("query"), F.col("passages")), with_retry(call, attempts, sleep=sleep)))
    return tried.withColumn("choices", chosen_letters(F.coalesce("_tried.value", F.lit("")), 26)).withColumn("choices", F.filter("choices", lambda i: i < F.size("passages"))).drop("_tried")


def judged_answers(rows: DataFrame) -> DataFrame:
    """rows (question, answer, truth, contexts array): lexical proxies of the four judge metrics, not a model's.

    faithfulness: share of the answer's words that the contexts have; answer_relevancy: share of the question's words that the answer
    has; context_precision: share of contexts that hold a word of the truth; context_recall: share of the truth's words that the contexts
    have. Nothing to share gives 0."""
    words = lambda c: F.array_distinct(tokens(c))
    share = lambda a, b: F.round(F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0), 4)
    w = rows.withColumns({"_q": words("question"), "_a": words("answer"), "_t": words("truth"), "_c": words(F.array_join("contexts", " "))})
    useful = F.filter("contexts", lambda c: F.arrays_overlap(tokens(c), F.col("_t")))
    precise = F.round(F.when(F.size("contexts") > 0, F.size(useful) / F.size("contexts")).otherwise(0.0), 4)
    return w.withColumns({"faithfulness": share(F.col("_a"), F.col("_c")), "answer_relevancy": share(F.col("_q"), F.col("_a")), "context_precision": precise, "context_recall": share(F.col("_t"), F.col("_c"))}).drop("_q", "_a", "_t", "_c")
