"""Greedy search for a system prompt: instructions are added while answers get better by enough."""

from __future__ import annotations

import dataclasses
import functools
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import generation

#: Fixed values.
INSTRUCTIONS = (
    "Respond with concise bullet points and cite chunk ids inline.",
    "Lead with a single-sentence executive summary before details.",
    "Highlight any location-specific policies explicitly.",
    "Include a short 'Recommended Actions' section at the end.",
    "Surface confidentiality levels and departments alongside each fact.",
    "Prefer quoting the original text verbatim when referencing procedures.",
)


@dataclass(frozen=True)
class Search:
    max_steps: int = 3
    min_gain: float = 0.01
    sample_size: int | None = None
    mutations_per_step: int = 4
    instructions: tuple[str, ...] = field(default=INSTRUCTIONS)
    seed: int = 0


def candidates(prompt: str, settings: Search, step: int = 0) -> list[str]:
    """The prompt with one instruction that it lacks, in seeded order, up to the number of a step."""
    said = prompt.casefold()
    lacking = [x for x in dict.fromkeys(map(str.strip, settings.instructions)) if x and x.casefold() not in said]
    drawn = random.Random(f"{settings.seed}-{step}").sample(lacking, min(settings.mutations_per_step, len(lacking)))
    return ["\n\n".join((prompt.strip(), x)) for x in drawn]


def scored(prompts: list[str], held: DataFrame, examples: DataFrame, model: Callable[[Column], Column] | None = None) -> dict[str, float]:
    """Mean F1 of the answers to all examples under each prompt, in one job: contexts don't depend on the prompt."""
    given = examples.sparkSession.createDataFrame(list(enumerate(prompts)), "n int, system string")
    rows = held.join(examples.select("query_id", "reference_answer"), "query_id").crossJoin(F.broadcast(given))  # a few prompts
    said = generation.answers(
        rows.select(
            "query_id",
            "question",
            "items",
            "n",
            "system",
            "reference_answer",
        ).withColumn("query_id", F.struct("query_id", "n", "reference_answer")),
        F.col("system"),
        model,
    )
    means = said.select(
        F.col("query_id.n").alias("n"),
        tx.prompt_f1(F.col("query_id.reference_answer"), F.col("answer")).alias("f"),
    ).groupBy("n").agg(F.avg("f").alias("f"))
    found = {r["n"]: r["f"] for r in means.collect()}
    return {p: found.get(i, 0.0) for i, p in enumerate(prompts)}


@dataclass(frozen=True)
class Trial:
    step: int
    score: float
    prompt: str


def chosen(held: Trial, tried: Sequence[Trial], gain: float) -> Trial:
    """What is held after the trials, each of which must beat what is held by more than a gain."""
    return functools.reduce(lambda best, trial: trial if trial.score > best.score + gain else best, tried, held)


def trials(
    prompt: str,
    step: int,
    held: DataFrame,
    examples: DataFrame,
    settings: Search,
    model: Callable[[Column], Column] | None,
) -> list[Trial]:
    """A step's candidates with their scores, from one job."""
    texts = candidates(prompt, settings, step) if step else [prompt]
    found = scored(texts, held, examples, model) if texts else {}
    return [Trial(step, found[t], t) for t in texts]


def history(
    base: str,
    held: DataFrame,
    examples: DataFrame,
    settings: Search | None = None,
    model: Callable[[Column], Column] | None = None,
) -> list[Trial]:
    """The base prompt and each prompt that replaced the one before it, until a step brings nothing or steps run out."""
    settings = settings or Search()
    if examples.isEmpty():
        raise ValueError("no examples to search with")
    if settings.sample_size:
        examples = examples.orderBy(F.xxhash64(F.lit(settings.seed), "query_id")).limit(settings.sample_size)
    kept = trials(base.strip(), 0, held, examples, settings, model)
    while len(kept) <= settings.max_steps:
        new = chosen(kept[-1], trials(kept[-1].prompt, len(kept), held, examples, settings, model), settings.min_gain)
        if new is kept[-1]:
            break
        kept.append(new)
    return kept


def optimize(
    base: str,
    held: DataFrame,
    examples: DataFrame,
    settings: Search | None = None,
    model: Callable[[Column], Column] | None = None,
) -> tuple[str, list[dict]]:
    """The best prompt, and what led to it."""
    kept = history(base, held, examples, settings, model)
    return kept[-1].prompt, [dataclasses.asdict(t) for t in kept]
