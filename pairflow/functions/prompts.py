"""Prompt columns: one expression per strategy, built from fixed texts and the pair columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow import domain
from pairflow.functions.text import checked_strategy

Example = tuple[str, str, str]


def fill(template: str, **values: Column | str) -> Column:
    """Concatenate literal pieces and columns in the order the template names them."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            value = values[piece]
            parts.append(F.lit(value) if isinstance(value, str) else value)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def zero_shot(premise: Column, hypothesis: Column) -> Column:
    return fill(_with_instruction(domain.ZERO_SHOT_TEXT), premise=premise, hypothesis=hypothesis)


def one_shot(premise: Column, hypothesis: Column) -> Column:
    return fill(_with_instruction(domain.ONE_SHOT_TEXT), premise=premise, hypothesis=hypothesis)


def few_shot(premise: Column, hypothesis: Column, examples: list[Example] | None = None,
             count: int = domain.FEW_SHOT_DEFAULT_COUNT) -> Column:
    """count applies to the built-in examples only; a list given by the caller is used whole."""
    if examples is None:
        examples = domain.FEW_SHOT_EXAMPLES[:count]
    block = "".join(domain.FEW_SHOT_EXAMPLE.format(premise=p, hypothesis=h, label=l) for p, h, l in examples)
    head = domain.FEW_SHOT_HEADER.format(system_instruction=domain.SYSTEM_INSTRUCTION)
    return F.concat(F.lit(head + block), fill(domain.FEW_SHOT_FOOTER, premise=premise, hypothesis=hypothesis))


def few_shot_from(premise: Column, hypothesis: Column, examples: Column) -> Column:
    """As few_shot, with the examples in an array<struct<premise,hypothesis,label>> column."""
    block = F.array_join(F.transform(examples, lambda e: fill(
        domain.FEW_SHOT_EXAMPLE, premise=e["premise"], hypothesis=e["hypothesis"], label=e["label"])), "")
    head = domain.FEW_SHOT_HEADER.format(system_instruction=domain.SYSTEM_INSTRUCTION)
    return F.concat(F.lit(head), block, fill(domain.FEW_SHOT_FOOTER, premise=premise, hypothesis=hypothesis))


def chain_of_thought(premise: Column, hypothesis: Column, with_example: bool = True) -> Column:
    template = domain.COT_WITH_EXAMPLE_TEXT if with_example else domain.COT_TEXT
    return fill(template, premise=premise, hypothesis=hypothesis)


def six_shot_cot(premise: Column, hypothesis: Column) -> Column:
    return fill(_with_instruction(domain.SIX_SHOT_COT_TEXT), premise=premise, hypothesis=hypothesis)


def prompt(strategy: Column | str, premise: str = "premise", hypothesis: str = "hypothesis",
           examples: list[Example] | None = None, allowed: list[str] | None = None) -> Column:
    """Prompt of each row's own strategy; a strategy outside allowed raises at run time."""
    p, h = F.col(premise), F.col(hypothesis)
    name = checked_strategy(F.col(strategy) if isinstance(strategy, str) else strategy, allowed)
    return (
        F.when(name == "zero-shot", zero_shot(p, h))
        .when(name == "one-shot", one_shot(p, h))
        .when(name == "few-shot", few_shot(p, h, examples))
        .when(name == "6-shot", few_shot(p, h, count=6))
        .when(name == "6-shot-cot", six_shot_cot(p, h))
        .when(name == "cot", chain_of_thought(p, h))
    )


def with_prompt(df: DataFrame, strategy: str = "strategy", output: str = "prompt",
                examples: list[Example] | None = None, allowed: list[str] | None = None) -> DataFrame:
    return df.withColumn(output, prompt(strategy, examples=examples, allowed=allowed))


def text_pieces(strategy: str) -> list[str]:
    """A strategy's prompt with the built-in examples as fixed texts (at even places) and names of a pair's columns."""
    examples = domain.FEW_SHOT_EXAMPLES[:6 if strategy == "6-shot" else domain.FEW_SHOT_DEFAULT_COUNT]
    block = "".join(domain.FEW_SHOT_EXAMPLE.format(premise=p, hypothesis=h, label=l) for p, h, l in examples)
    several = _with_instruction(domain.FEW_SHOT_HEADER) + block
    template = {"zero-shot": domain.ZERO_SHOT_TEXT, "one-shot": domain.ONE_SHOT_TEXT, "few-shot": domain.FEW_SHOT_FOOTER,
                "6-shot": domain.FEW_SHOT_FOOTER, "6-shot-cot": domain.SIX_SHOT_COT_TEXT, "cot": domain.COT_WITH_EXAMPLE_TEXT}[strategy]
    first, *rest = re.split(r"\{(premise|hypothesis)\}", _with_instruction(template))
    return [(several if strategy in ("few-shot", "6-shot") else "") + first, *rest]


def fixed_chars(strategy: str) -> int:
    """Characters of a strategy's prompt besides the pair's two texts."""
    return sum(map(len, text_pieces(strategy)[::2]))


def managed_prompt(strategy: Column | str, premise: str = "premise", hypothesis: str = "hypothesis",
                   examples: list[Example] | None = None) -> Column:
    """The narrower surface that accepts the four base strategies only."""
    return prompt(strategy, premise, hypothesis, examples, domain.BASE_STRATEGIES)


def _with_instruction(template: str) -> str:
    return template.replace("{system_instruction}", domain.SYSTEM_INSTRUCTION)
