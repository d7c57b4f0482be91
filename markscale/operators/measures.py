"""Statistics of a report as mergeable states.

A measure says which aggregates make up its state in the finest groups, how the states of several groups
become the state of their union, and what follows from a state. All of it is built-in aggregates over columns, so states
are merged within every task before anything is shuffled. The report takes any list of measures.

An own measure, the share of scores of at least one half::

    Measure(
        initial=lambda score: {"high": F.count_if(score >= 0.5), "n": F.count(score)},
        merge=lambda state: {"high": F.sum(state["high"]), "n": F.sum(state["n"])},
        finish=lambda state: {"high_share": state["high"] / F.nullif(state["n"], F.lit(0))},
    )
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

State = dict[str, Column]


@dataclass(frozen=True)
class Measure:
    """``initial(score)``: aggregates over rows. ``score`` is the row's score or NULL; the columns of the row, ``llm_label``
    and ``is_correct`` can be named as well. ``merge(state)``: the same names as aggregates over states.
    ``finish(state)``: the measure's columns from one state.

    ``centred(state, merged)``, if given, are aggregates that also need what the others came to: ``merged`` is the union's state.
    """

    initial: Callable[[Column], State]
    merge: Callable[[State], State]
    finish: Callable[[State], State]
    centred: Callable[[State, State], State] | None = None


def row_count(name: str = "n_total") -> Measure:
    return Measure(
        initial=lambda score: {"n": F.count(F.lit(1))},
        merge=lambda state: {"n": F.sum(state["n"])},
        finish=lambda state: {name: state["n"]},
    )


def count_where(name: str, condition: Callable[[], Column]) -> Measure:
    """The rows for which ``condition()`` holds."""
    return Measure(
        initial=lambda score: {"n": F.count_if(condition())},
        merge=lambda state: {"n": F.sum(state["n"])},
        finish=lambda state: {name: state["n"]},
    )


def share(name: str, condition: Callable[[], Column]) -> Measure:
    """The share of rows for which ``condition()`` holds, and its standard error."""

    def finish(state: State) -> State:
        part = state["hits"] / state["n"]
        return {name: part, f"{name}_se": F.sqrt(part * (1 - part) / state["n"])}

    return Measure(
        initial=lambda score: {"hits": F.count_if(condition()), "n": F.count(F.lit(1))},
        merge=lambda state: {"hits": F.sum(state["hits"]), "n": F.sum(state["n"])},
        finish=finish,
    )


def mean(name: str, value: Callable[[Column], Column] = lambda score: score) -> Measure:
    """Mean and standard error of a value (the score by default); NULL values do not count.

    The state is count, mean and sum of squared distances from the mean. Distances of a union are taken from the
    union's own mean, so nothing is lost where the spread is small against the values.
    """

    def initial(score: Column) -> State:
        x = value(score)
        return {"n": F.count(x), "mean": F.avg(x), "m2": F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))}

    def merge(state: State) -> State:
        return {"n": F.sum(state["n"]), "mean": F.sum(state["mean"] * state["n"]) / F.nullif(F.sum(state["n"]), F.lit(0))}

    def centred(state: State, merged: State) -> State:
        apart = state["mean"] - merged["mean"]
        return {"m2": F.sum(state["m2"] + F.coalesce(state["n"] * apart * apart, F.lit(0.0)))}

    def finish(state: State) -> State:
        n = state["n"]
        error = F.sqrt(state["m2"] / F.nullif(n - 1, F.lit(0))) / F.sqrt(n)
        known = F.when(n == 1, F.lit(0.0)).when(n > 1, F.nanvl(error, F.lit(None).cast("double")))
        return {f"{name}_mean": state["mean"], f"{name}_se": known}

    return Measure(initial, merge, finish, centred)
