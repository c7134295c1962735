"""A small averaged perceptron that ranks choices described by named features."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable


class Perceptron:
    """Weights by feature name. A choice is a list of features; the best-scored choice wins."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: Iterable[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def best(self, choices: list[list[str]]) -> int:
        scores = [self.score(c) for c in choices]
        return scores.index(max(scores))

    @classmethod
    def fit(cls, examples: list[tuple[list[list[str]], int]], epochs: int = 6, seed: int = 11, steps: list[float] | None = None) -> Perceptron:
        """Train on (choices, number of the right one); returns the average of all steps.

        `steps` tells how far each example moves the weights, by default 1.
        """
        weights: dict[str, float] = defaultdict(float)
        totals: dict[str, float] = defaultdict(float)
        since: dict[str, int] = defaultdict(int)
        rng, step, examples = random.Random(seed), 0, list(zip(examples, steps or [1.0] * len(examples)))
        for _ in range(epochs):
            rng.shuffle(examples)
            for (choices, right), far in examples:
                step += 1
                scores = [sum(weights[f] for f in c) for c in choices]
                guess = scores.index(max(scores))
                if guess == right:
                    continue
                for sign, c in ((far, choices[right]), (-far, choices[guess])):
                    for f in c:
                        totals[f] += (step - since[f]) * weights[f]
                        since[f] = step
                        weights[f] += sign
        return cls({f: (totals[f] + (step + 1 - since[f]) * w) / max(step, 1) for f, w in weights.items() if w or totals[f]})


def yes_no(features: list[str]) -> list[list[str]]:
    """Choices of a yes-or-no question: 0 has no features, 1 has them all."""
    return [[], features]
