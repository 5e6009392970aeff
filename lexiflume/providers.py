"""Model providers with deterministic defaults in plain expressions. Real models plug in as functions of the same shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lexiflume.functions.metrics import let, token_f1
from lexiflume.functions.text import tokens


def lexical_score(query: Column, text: Column) -> Column:
    """Reranker stand-in: token F1 of query and text, rounded to 4 places."""
    return F.round(token_f1(tokens(query), tokens(text)), 4)


def coverage(query: Column, text: Column) -> Column:
    """Entailment stand-in: share of the query's distinct tokens that the text has."""
    share = lambda q, t: F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))
    return let(share, F.array_distinct(tokens(query)), tokens(text))


def nli(query: Column, text: Column) -> Column:
    """Label, confidence and probabilities of a (question, context) pair."""

    def judged(p):
        return F.struct(F.when(p >= 0.5, "entailment").otherwise("other").alias("label"), F.greatest(p, 1 - p).alias("confidence"), F.create_map(F.lit("entailment"), p, F.lit("other"), F.round(1 - p, 4)).alias("probabilities"))

    return let(judged, F.round(coverage(query, text), 4))


def templates(query: Column, n: int = 4) -> Column:
    """Query expansion stand-in (R07): fixed paraphrase frames."""
    frames = ("what is {}", "explain {}", "rules about {}", "examples of {}")
    return F.slice(F.array(*[F.concat(F.lit(a), query, F.lit(b)) for a, b in (f.split("{}") for f in frames)]), 1, n)


def yes_no(query: Column, text: Column) -> Column:
    """Probabilities of the answers yes and no to "is the text relevant": its share of the query's tokens, and the rest. A text with none of
    them gives neither answer."""
    return let(lambda p: F.struct(p.alias("p_yes"), F.when(p > 0, 1 - p).otherwise(F.lit(0.0)).alias("p_no")), F.round(coverage(query, text), 4))


def choose(query: Column, passages: Column) -> Column:
    """Answer of a multiple-choice model: letters of the passages that share tokens with the query, best first."""
    scored = F.transform(passages, lambda p, i: F.struct((-lexical_score(query, p)).alias("s"), i.alias("i")))
    letters = F.transform(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), lambda x: F.concat(F.lit("("), F.char(x["i"] + 65), F.lit(")")))
    return F.concat(F.lit("Correct Answer: "), F.array_join(letters, ", "))


def hypothetical(query: Column) -> Column:
    """Stand-in for a passage that a model would write to answer the query."""
    return F.concat(F.lit("The answer to this: "), query)


@dataclass(frozen=True)
class Providers:
    """Functions of columns; ``available`` tells whether a remote one may be asked (R24). embed turns texts (id, text) into (id, embedding); external
    gives hits (query_id, chunk_id, content, rank) of another source for queries (query_id, query)."""

    rerank: Callable[[Column, Column], Column] = lexical_score
    entail: Callable[[Column, Column], Column] = coverage
    expand: Callable[[Column], Column] = templates
    rewrite: Callable[[Column], Column] = field(default=lambda q: q)
    yes_no: Callable[[Column, Column], Column] = yes_no
    choose: Callable[[Column, Column], Column] = choose
    hypothetical: Callable[[Column], Column] = hypothetical
    embed: Callable[[DataFrame], DataFrame] | None = None
    external: Callable[[DataFrame], DataFrame] | None = None
    available: Callable[[], bool] = field(default=lambda: True)


DEFAULT = Providers()
