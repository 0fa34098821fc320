"""Losses by name, alone or combined with weights, as columns; others can be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import huber, pinball

Loss = Callable[[Column, Column], Column]
_LOSSES: dict[str, Callable[..., Loss]] = {}


def loss(name: str) -> Callable[[Callable[..., Loss]], Callable[..., Loss]]:
    """Register what makes a loss of its parameters under a name."""

    def keep(make: Callable[..., Loss]) -> Callable[..., Loss]:
        _LOSSES[name] = make
        return make

    return keep


def available() -> list[str]:
    return list(_LOSSES)


def build(name: str, **parameters) -> Loss:
    """The loss (y, prediction) -> column of that name; its mean over rows is what models are judged by."""
    if name not in _LOSSES:
        raise ValueError(f"loss {name!r} is not registered; there are {', '.join(_LOSSES)}")
    return _LOSSES[name](**parameters)


@loss("mse")
def _mse() -> Loss:
    return lambda y, p: (y - p) * (y - p)


@loss("mae")
def _mae() -> Loss:
    return lambda y, p: F.abs(y - p)


@loss("huber")
def _huber(delta: float = 1.0) -> Loss:
    return lambda y, p: huber(y, p, delta)


@loss("pinball")
def _pinball(tau: float) -> Loss:
    return lambda y, p: pinball(y, p, tau)


@loss("combined")
def _combined(components: list[dict]) -> Loss:
    """Weighted sum; a component is {"name", "weight"} and the parameters of its loss."""
    parts = [(float(c["weight"]), build(c["name"], **{k: v for k, v in c.items() if k not in ("name", "weight")})) for c in components]
    return lambda y, p: sum((w * one(y, p) for w, one in parts), F.lit(0.0))
