"""What to forecast with: rows that say which kind of fit sees which columns. Plain values, kept on the driver.

A model is a name, a kind and what the kind needs:

==============  ===========================================  =====================
kind            forecast                                     ``weight``
==============  ===========================================  =====================
``regression``  intercept and slopes on the regressors       penalty on the slopes
``smoothing``   fixed-weight average of past targets         decay, 0: the last one
``own``         ``rule.fit(X, y).predict(X)`` of the user's  (none)
==============  ===========================================  =====================
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any, NamedTuple

#: Weights a kind allows, as a half-open interval.
WEIGHTS = {"regression": (0.0, math.inf), "smoothing": (0.0, 1.0), "own": (0.0, math.inf)}


class ModelSpec(NamedTuple):
    """One row of the table above; made by the functions below, which check it."""

    name: str
    kind: str
    regressors: tuple[str, ...] = ()
    weight: float = 0.0
    rule: Any = None


def _row(name: str, kind: str, regressors: Sequence[str] = (), weight: float = 0.0, rule: Any = None) -> ModelSpec:
    low, high = WEIGHTS[kind]
    faults = {
        "name": not (isinstance(name, str) and name.strip()),
        "regressors": isinstance(regressors, str) or not all(isinstance(c, str) and c.strip() for c in regressors)
        or len({*regressors}) < len(regressors),
        "weight": isinstance(weight, bool) or not isinstance(weight, (int, float)) or not low <= weight < high,
        "rule": (kind == "own") != hasattr(rule, "fit"),
    }
    if bad := [part for part, wrong in faults.items() if wrong]:
        raise ValueError(f"{kind} model {name!r}: unusable {', '.join(bad)}")
    return ModelSpec(name, kind, tuple(regressors), float(weight), rule)


def regression(name: str, regressors: Sequence[str] = (), *, penalty: float = 0.0) -> ModelSpec:
    """Least squares with a free intercept; without regressors, the mean of past targets."""
    return _row(name, "regression", regressors, penalty)


def smoothing(name: str, decay: float) -> ModelSpec:
    return _row(name, "smoothing", weight=decay)


def own_rule(name: str, rule: Any, regressors: Sequence[str] = ()) -> ModelSpec:
    """A rule of the user's own: ``fit(X, y)`` returns the fitted rule, ``predict(X)`` an array.

    A fitted rule that also has ``update(X, y)``, which returns the rule fitted on more observations, is fitted once per
    series and then updated with what became known since, so its cost grows with the rows and not with their square.
    """
    return _row(name, "own", regressors, rule=rule)
