"""Finite-state transducers over a small alphabet: tables that run one after another, or composed into one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step`` and ``out`` hold the next state and the output of (state, input); state 0 starts."""

    step: np.ndarray
    out: np.ndarray
    final: np.ndarray

    def run(self, symbols: Iterable[int]) -> tuple[list[int], bool]:
        """Outputs, and whether the last state accepts."""
        state, got = 0, []
        for x in symbols:
            got.append(int(self.out[state, x]))
            state = int(self.step[state, x])
        return got, bool(self.final[state])


def build(states: int, alphabet: int, rule: Callable[[int, int], tuple[int, int]], final: Callable[[int], bool] = lambda s: True) -> Transducer:
    """A table from a rule (state, input) -> (state, output)."""
    cells = np.array([[rule(s, x) for x in range(alphabet)] for s in range(states)], np.int64)
    return Transducer(cells[:, :, 0], cells[:, :, 1], np.array([final(s) for s in range(states)]))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of what ``first`` puts out, as one machine over pairs of states; it accepts if both do."""
    a, b = np.divmod(np.arange(len(first.step) * len(second.step)), len(second.step))
    between = first.out[a]
    step = first.step[a] * len(second.step) + second.step[b[:, None], between]
    return Transducer(step, second.out[b[:, None], between], first.final[a] & second.final[b])


def cascade(machines: Iterable[Transducer]) -> Transducer:
    return reduce(compose, machines)
