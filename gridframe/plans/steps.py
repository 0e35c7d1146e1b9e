"""Steps by name with typed parameters, checked before any of them runs."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from gridframe.plans.parameters import ConfigError, checked

STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers a function of DataFrames and keyword parameters."""
    STEPS[f.__name__] = f
    return f


def lint(description: list[dict[str, Any]], inputs: set[str]) -> list[str]:
    """What is wrong with a description: unknown steps, parameters and inputs, values that a step's
    signature doesn't allow, and outputs made twice."""
    known, wrong = set(inputs), []
    for i, d in enumerate(description):
        f = STEPS.get(d.get("type", ""))
        if f is None:
            wrong.append(f"step {i}: no step {d.get('type')!r}")
            continue
        try:
            inspect.signature(f).bind(*d.get("in", []), **d.get("params", {}))
        except TypeError as e:
            wrong.append(f"step {i}: {e}")
        wrong += [f"step {i}: {x}" for x in checked(f, d.get("params", {}))[1]]
        wrong += [f"step {i}: nothing makes {x!r}" for x in d.get("in", []) if x not in known]
        if d.get("out") in known:
            wrong.append(f"step {i}: {d['out']!r} is made twice")
        known.add(d.get("out", ""))
    return wrong


def build(description: list[dict[str, Any]], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All named results as lazy DataFrames; Spark runs what is used of them."""
    if wrong := lint(description, set(inputs)):
        raise ConfigError("; ".join(wrong))
    made = dict(inputs)
    for d in description:
        f = STEPS[d["type"]]
        made[d["out"]] = f(*[made[x] for x in d.get("in", [])], **checked(f, d.get("params", {}))[0])
    return made
