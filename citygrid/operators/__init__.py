"""Operators: functions from DataFrames to a DataFrame, declared by their plan in SQL or Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Operator:
    """``inputs`` are named in the text as {input}; each is a binding or another operator.

    An input ``stream:x`` is the binding x over a stream of its table.

    The plan is ``text`` (SQL) or ``plan`` (a function of the inputs). ``duck`` is the
    oracle, where it is not the text itself; a plan without one is tested on fixtures.

    Spark guesses the size of an input from compressed files. The next join of an input
    that is named in ``merged`` is a merge, so that it is not broadcast by such a guess.
    """

    name: str
    inputs: tuple[str, ...]
    text: str = ""
    duck: str | None = None
    plan: Callable[..., DataFrame] | None = None
    merged: tuple[str, ...] = ()

    def __call__(self, **frames: DataFrame) -> DataFrame:
        if self.plan:
            return self.plan(*(frames[k] for k in self.inputs))
        return next(iter(frames.values())).sparkSession.sql(self.text, **{k: frames[k].hint("merge") if k in self.merged else frames[k] for k in self.inputs})

    @property
    def oracle(self) -> str | None:
        return self.duck or self.text or None


OPERATORS: dict[str, Operator] = {}


def operator(name: str, inputs: str, text: str, duck: str | None = None, merged: str = "") -> None:
    OPERATORS[name] = Operator(name, tuple(inputs.split()), text, duck, merged=tuple(merged.split()))


def planned(name: str, inputs: str, duck: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """The decorated function is the operator's plan; its arguments are the inputs in their order."""

    def register(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[name] = Operator(name, tuple(inputs.split()), duck=duck, plan=plan)
        return plan

    return register
