"""A small scorer: labels a pair by the share of hypothesis words that its premise has.

It reads the two texts and the prompt only. Strategies differ in their thresholds; a hypothesis without words can't be
judged, one of a single word is not decided.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
import regex
from pyspark import cloudpickle

from pairflow.operators.scoring import Answer
from pairflow.sources.fixtures import THRESHOLDS

# Ship this module's functions with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = regex.compile(r"[\p{L}\p{N}_]+")
ASCII_WORD = re.compile(r"[a-z0-9_]+")


def word_set(text: str) -> frozenset[str]:
    lowered = text.lower()
    return frozenset((ASCII_WORD if lowered.isascii() else WORD).findall(lowered))


class RuleScorer:
    def __init__(self, thresholds: dict[str, tuple[float, float]]):
        self.thresholds = thresholds

    def answer(self, batch: pd.DataFrame) -> list[Answer]:
        # A sentence is the hypothesis of one pair and the premise of the next, for every strategy.
        texts = set(batch["premise"])
        texts.update(batch["hypothesis"])
        words = {text: word_set(text) for text in texts}
        answers, premise, hypothesis = [], None, None
        for strategy, p, h, prompt in zip(*[batch[c].tolist() for c in ("strategy", "premise", "hypothesis", "prompt")]):
            if p is not premise or h is not hypothesis:  # a pair's strategies follow one another
                premise, hypothesis, wanted = p, h, len(words[h])
                shared = len(words[p] & words[h])
            answers.append(self._one(strategy, shared, wanted, prompt))
        return answers

    def _one(self, strategy: str, shared: int, wanted: int, prompt: str) -> Answer:
        tokens = len(prompt) // 4 + 1
        if not wanted:
            return Answer("", tokens, 0, success=False, error="Nothing to judge")
        low, high = self.thresholds[strategy]
        overlap = shared / wanted
        word = "entailment" if overlap >= high else "contradiction" if overlap <= low else "neutral"
        if wanted == 1:
            text = "cannot decide"
        elif strategy.endswith("cot"):
            text = f"Shared words: {shared} of {wanted}. Classification: {word}"
        else:
            text = word
        return Answer(text, tokens, len(text) // 4 + 1)


def rule_factory():
    """Factory for operators.scoring.score."""
    settings = dict(THRESHOLDS)

    def make() -> RuleScorer:
        return RuleScorer(settings)

    return make
