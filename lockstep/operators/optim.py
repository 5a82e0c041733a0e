"""Update rules for weights: pure functions of weights, gradient and memory, over NumPy arrays.

The descent rule takes an uphill gradient (w - rate * g), the others a downhill one. Memory is a plain dict of lists, so that it can be part of a job's state and
survives a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

# Fixed values of the rules.
DECAY = 1e-4
EPSILON = 0.35
ZERO = 1e-17
SIGN_TOLERANCE = 1e-13
GROW, SHRINK = 1.2, 0.5
LEAST_STEP, FIRST_STEP, MOST_STEP = 1e-6, 0.1, 50.0

Memory = dict[str, list[float]]
Step = tuple[np.ndarray, Memory]


def _past(memory: Memory | None, name: str, n: int, default: float = 0.0) -> np.ndarray:
    return np.array(memory[name], float) if memory and memory.get(name) else np.full(n, default)


def descent(w: np.ndarray, g: np.ndarray, memory: Memory | None, rate: float, **_: float) -> Step:
    return w - rate * g, {}


def back_propagation(w: np.ndarray, g: np.ndarray, memory: Memory | None, rate: float, momentum: float = 0.0, **_: float) -> Step:
    step = rate * g + momentum * _past(memory, "step", len(w))
    return w + step, {"step": step.tolist()}


def quick_propagation(w: np.ndarray, g: np.ndarray, memory: Memory | None, rate: float, n_train: float = 1.0, **_: float) -> Step:
    """Without a last step only the linear term is left. Else that is added where the slope still points along the step, and the rest is a parabola's
    minimum, or the last step times the rate where the slope is so close to the one before, or beyond it, that the parabola isn't to be trusted."""
    last, previous = _past(memory, "step", len(w)), -_past(memory, "gradient", len(w))
    slope, side = DECAY * w - g, np.sign(last)
    linear = -EPSILON / n_train * slope
    beyond = side * slope <= side * previous * rate / (1 + rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        curved = np.where(beyond, rate * last, last * slope / (previous - slope))
    step = np.where(side == 0, linear, curved + np.where(side * slope < 0, linear, 0.0))
    return w + step, {"step": step.tolist(), "gradient": g.tolist()}


def manhattan(w: np.ndarray, g: np.ndarray, memory: Memory | None, rate: float, **_: float) -> Step:
    return w + rate * np.where(np.abs(g) < ZERO, 0.0, np.sign(g)), {}


def resilient(w: np.ndarray, g: np.ndarray, memory: Memory | None, rate: float = 0.0, **_: float) -> Step:
    """A size for each weight: it grows while the gradient keeps its sign; when that turns, the size shrinks and the last step is taken back."""
    n = len(w)
    sign = lambda x: np.where(np.abs(x) < SIGN_TOLERANCE, 0.0, np.sign(x))
    size, last = _past(memory, "size", n, FIRST_STEP), _past(memory, "step", n)
    turn = sign(g * _past(memory, "gradient", n))
    size = np.select([turn > 0, turn < 0], [np.minimum(GROW * size, MOST_STEP), np.maximum(SHRINK * size, LEAST_STEP)], size)
    step = np.where(turn < 0, -last, sign(g) * size)
    return w + step, {"step": step.tolist(), "size": size.tolist(), "gradient": np.where(turn < 0, 0.0, g).tolist()}


def scaled_conjugate(w: np.ndarray, g: np.ndarray, memory: Memory | None, rate: float = 0.0, **_: float) -> Step:
    raise NotImplementedError("scaled conjugate gradient has no definition here")


RULES: dict[str, Callable[..., Step]] = {"descent": descent, "B": back_propagation, "Q": quick_propagation, "M": manhattan, "R": resilient, "S": scaled_conjugate}


def update(rule: str, weights: Sequence[float], gradient: Sequence[float], memory: Memory | None = None, *, rate: float, **parameters: float) -> tuple[list[float], Memory]:
    """The new weights and memory. Rules: descent, B(ack), Q(uick), M(anhattan), R(esilient); case doesn't matter. Others raise."""
    names = {k.lower(): f for k, f in RULES.items()}
    if rule.lower() not in names:
        raise ValueError(f"unknown rule {rule}; there are {', '.join(RULES)}")
    w, after = names[rule.lower()](np.array(weights, float), np.array(gradient, float), memory, rate, **parameters)
    return w.tolist(), after
