"""Parameters of steps that are checked before anything runs.

A step states what a parameter may be in its signature, as ``Annotated[float, between(0, 1)]``; the check
takes the value that is given and returns the one that the step gets.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

Check = Callable[[Any], Any]


class ConfigError(ValueError):
    """A description of steps is wrong."""


def between(low: float, high: float) -> Check:
    """A number within bounds, both allowed."""

    def check(value: Any) -> float:
        number = float(value)
        if not low <= number <= high:
            raise ConfigError(f"{value!r} is not between {low} and {high}")
        return number

    return check


def one_of(*options: Any) -> Check:
    def check(value: Any) -> Any:
        if value not in options:
            raise ConfigError(f"{value!r} is none of {list(options)}")
        return value

    return check


def list_of(kind: type | tuple[type, ...] | None = None, length: int | None = None, at_most: int | None = None) -> Check:
    """A list, maybe of one kind, of a length or a greatest length."""

    def check(value: Any) -> list:
        if not isinstance(value, list | tuple):
            raise ConfigError(f"{value!r} is no list")
        for i, x in enumerate(value):
            if kind is not None and not isinstance(x, kind):
                raise ConfigError(f"{x!r} at place {i} is of type {type(x).__name__}")
        if length is not None and len(value) != length:
            raise ConfigError(f"{len(value)} values, not {length}")
        if at_most is not None and len(value) > at_most:
            raise ConfigError(f"{len(value)} values, {at_most} at most")
        return list(value)

    return check


def utc_seconds(value: Any) -> float:
    """Seconds since 1970 of a number, a datetime or ISO text; times without a zone are UTC."""
    if isinstance(value, bool):
        raise ConfigError(f"{value!r} is no time")
    if isinstance(value, int | float):
        return float(value)
    try:
        stamp = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{value!r} is no time") from e
    return (stamp if stamp.tzinfo else stamp.replace(tzinfo=UTC)).timestamp()


def checks(step: Callable) -> dict[str, list[Check]]:
    """The checks that a step's signature states, by parameter."""
    hints = typing.get_type_hints(step, include_extras=True)
    return {name: [c for c in getattr(kind, "__metadata__", ()) if callable(c)] for name, kind in hints.items()}


def checked(step: Callable, params: dict[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """The parameters as the step gets them, and what is wrong with those given.

    A value that is not annotated is handed on; a default is taken to be right."""
    out, wrong = dict(params), []
    known = checks(step)
    for name, value in params.items():
        for check in known.get(name, ()):
            try:
                value = check(value)
            except (TypeError, ValueError) as e:
                wrong.append(f"{name}: {e}")
                break
        out[name] = value
    return out, wrong


def template(step: Callable) -> dict[str, Any]:
    """The keyword parameters of a step with their defaults (those that must be given: None)."""
    return {n: None if p.default is p.empty else p.default for n, p in inspect.signature(step).parameters.items() if p.kind is p.KEYWORD_ONLY or p.default is not p.empty}
