"""Accuracy and mean similarity, with standard errors, by model, language, task and item.

Rows are aggregated once, into the finest groups that the wanted tables need, with partial aggregation in every
task (so a group that holds most rows still shuffles as one small row per task). The states of these
groups are written, and the coarser tables are merged from them, each from the smallest table that has its keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.functions.fields import (
    coerce_score,
    is_correct,
    language_from_id,
    task_from_id,
    verdict_label,
)
from markscale.operators.measures import Measure, State, count_where, mean, row_count, share
from markscale.operators.model_jobs import JUDGE_COLUMN
from markscale.operators.skew import lookup_join
from markscale.session import materialise

SCORE = "similarity"
FALLBACK_SCORE = "strict_semantic_score"

# The result tables and their keys; ``source_file`` is a leading key of each.
TABLES = {
    "by_model": ["model"],
    "by_model_language": ["model", "language"],
    "by_model_language_id": ["model", "language", "id"],
    "by_model_task": ["model", "task_type"],
}
BY_FILE = "by_file"

# The columns of the standard measures.
MEASURES = ["n_total", "similarity_mean", "similarity_se", "accuracy", "accuracy_se"]
STANDARD = (row_count(), mean("similarity"), share("accuracy", lambda: F.col("is_correct")))
UNKNOWN_VERDICTS = count_where("n_unknown", lambda: F.col("llm_label") == "unknown")

_KEYS = ["source_file", "model", "language", "id", "task_type"]
_ROWS, _HAS = "_rows", "_has_score"


def derive_fields(df: DataFrame, *, judge_col: str = JUDGE_COLUMN) -> DataFrame:
    """Add label, correctness, language and task; cast the id to a string.

    Without a verdict column every row is ``unknown``. The language comes from the id, whatever
    language tag the row has.
    """
    if "id" not in df.columns:
        raise ValueError("the report needs an id column")
    verdict = F.col(f"`{judge_col}`") if judge_col in df.columns else F.lit(None).cast("string")
    item = F.col("id").cast("string")
    return df.withColumns(
        {
            "id": item,
            "llm_label": verdict_label(verdict),
            "language": language_from_id(item),
            "task_type": task_from_id(item),
        }
    ).withColumn("is_correct", is_correct(F.col("llm_label")))


class _States:
    """The states of all measures over one or more score columns, as columns of one table."""

    def __init__(self, scores: Sequence[str], measures: Sequence[Measure]):
        self.parts = []
        for score in scores:
            for k, measure in enumerate(measures):
                prefix, initial = f"_{score}_{k}_", measure.initial(F.col(score))
                self.parts.append((prefix, initial, {name: F.col(f"{prefix}{name}") for name in initial}, measure))

    def _all(self, of) -> State:
        return {f"{prefix}{name}": value for prefix, initial, state, m in self.parts for name, value in of(prefix, initial, state, m).items()}

    def initial(self) -> State:
        return self._all(lambda prefix, initial, state, m: initial)

    def merge(self) -> State:
        return self._all(lambda prefix, initial, state, m: m.merge(state))

    def centred(self) -> State:
        def of(prefix, initial, state, m):
            return m.centred(state, {name: F.col(f"_to{prefix}{name}") for name in m.merge(state)}) if m.centred else {}

        return self._all(of)

    def finish(self, pick: Column | None = None) -> State:
        """The measures' columns; with two scores those of the first where ``pick`` holds, else of the second."""
        found = [m.finish(state) for _, _, state, m in self.parts]
        if pick is None:
            return {name: value for columns in found for name, value in columns.items()}
        half = len(found) // 2
        pairs = zip(found[:half], found[half:])
        return {name: F.when(pick, a[name]).otherwise(b[name]) for a, b in pairs for name in a}


def _extra(initial: bool, by_file: bool) -> State:
    if not by_file:
        return {}
    rows = {_ROWS: F.count(F.lit(1)) if initial else F.sum(_ROWS)}
    return rows | {_HAS: F.max("has_score" if initial else _HAS)}


def _aggregated(df: DataFrame, keys: list[str], values: State) -> DataFrame:
    return df.groupBy(*keys).agg(*(value.alias(name) for name, value in values.items()))


def _merged(groups: DataFrame, keys: list[str], states: _States, by_file: bool) -> DataFrame:
    """The groups of fewer ``keys`` from the states of finer ones."""
    merge, centred = states.merge() | _extra(False, by_file), states.centred()
    if not centred:
        return _aggregated(groups, keys, merge)
    # What the union comes to goes back to its parts: one row per coarse group, so a small side of the join.
    whole = states.merge()
    totals = _aggregated(groups, keys, whole).select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(F.col(c).alias(f"_to{c}") for c in whole))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return _aggregated(groups.join(totals, same), keys, merge | centred)


def _rolled_up(rows: DataFrame, tables: dict[str, list[str]], states: _States) -> dict[str, DataFrame]:
    """The groups of every table. ``rows`` is read once."""
    by_file = BY_FILE in tables
    sets = {name: ["source_file", *keys] for name, keys in tables.items()}
    finest = [key for key in _KEYS if any(key in keys for keys in sets.values())]
    initial = states.initial() | _extra(True, by_file)
    base = _aggregated(rows, finest, initial)
    if list(sets.values()) == [finest]:
        return {name: base for name in sets}
    # Each table is made of the smallest other one that has its keys. An id has one language and one task, so
    # the finest groups with ids are those of the table by id.
    base = materialise(base, "report-groups")
    implied = {"language", "task_type"} if "id" in finest else set()
    found = {name: base for name, keys in sets.items() if set(keys) | implied >= set(finest)}
    rest = sorted((name for name in sets if name not in found), key=lambda name: -len(sets[name]))
    parents = {name: min((p for p in rest if set(sets[name]) < set(sets[p])), key=lambda p: len(sets[p]), default=None) for name in rest}
    for name in rest:
        made = _merged(found.get(parents[name], base), sets[name], states, by_file)
        found[name] = materialise(made, f"report-{name}") if name in parents.values() else made
    return found


def _together(found: dict[str, DataFrame]) -> DataFrame:
    """All tables as one; keys that a table lacks are NULL."""

    def shaped(name: str, groups: DataFrame) -> DataFrame:
        own = ["source_file", *TABLES.get(name, [])]
        keys = [F.col(k) if k in own else F.lit(None).cast("string").alias(k) for k in _KEYS]
        return groups.select(F.lit(name).alias("table"), *keys, *(c for c in groups.columns if c not in _KEYS))

    return reduce(lambda a, b: a.unionByName(b), (shaped(*item) for item in found.items()))


def _streamed(rows: DataFrame, tables: dict[str, list[str]], states: _States) -> DataFrame:
    """All tables in one aggregation over grouping sets: a stream can be aggregated only once."""
    sets = {name: ["source_file", *keys] for name, keys in tables.items()}
    table = F.coalesce(
        *(
            F.when(reduce(and_, (F.grouping(key) == int(key not in keys) for key in _KEYS)), F.lit(name))
            for name, keys in sets.items()
        )
    )
    grouped = rows.groupingSets(list(sets.values()), *_KEYS)
    return grouped.agg(table.alias("table"), *(value.alias(name) for name, value in states.initial().items()))


def _complete_keys(groups: DataFrame) -> DataFrame:
    """Drop the groups of missing models, and of missing ids in the table keyed by id."""
    no_id = (F.col("table") == "by_model_language_id") & F.col("id").isNull()
    return groups.filter(F.col("model").isNotNull() & ~no_id)


def _result(groups: DataFrame, values: State) -> DataFrame:
    return groups.select("table", *_KEYS, *(value.alias(name) for name, value in values.items()))


def report(
    df: DataFrame,
    *,
    judge_col: str = JUDGE_COLUMN,
    tables: Sequence[str] = tuple(TABLES),
    score_source: str = "by_file",
    measures: Sequence[Measure] = STANDARD,
    count_unknown: bool = False,
) -> DataFrame:
    """One row per group of each of ``tables``: ``table``, the keys, and the columns of the ``measures``.

    ``score_source`` names the score column, or is ``"by_file"``: then a file uses ``similarity``
    if any of its rows has the key, else ``strict_semantic_score``. If both columns exist, both are
    aggregated in the one pass and the choice is made on the small result. ``count_unknown`` adds
    ``n_unknown``, the rows without a readable verdict.

    With more than one table the rows are aggregated, and the finest groups written, when this is called. A
    stream is aggregated over grouping sets instead.
    """
    if "source_file" not in df.columns:
        df = df.withColumn("source_file", F.lit("all"))
    if "model" not in df.columns:
        raise ValueError("the report needs a model column")
    types = {field.name: field.dataType for field in df.schema.fields}
    known = [name for name in (SCORE, FALLBACK_SCORE) if name in types]
    if score_source != "by_file":
        if score_source not in types:
            raise ValueError(f"no column {score_source!r}")
        known = [score_source]
    if count_unknown:
        measures = [*measures, UNKNOWN_VERDICTS]
    if len(known) == 2:
        return choose_score(two_score_groups(df, measures, tables=tables, judge_col=judge_col), measures)

    value = coerce_score(F.col(f"`{known[0]}`"), types[known[0]]) if known else F.lit(None).cast("double")
    rows = derive_fields(df.filter(F.col("model").isNotNull()).withColumn("score", value), judge_col=judge_col)
    states, wanted = _States(["score"], measures), {t: TABLES[t] for t in tables}
    groups = _streamed(rows, wanted, states) if df.isStreaming else _together(_rolled_up(rows, wanted, states))
    return _result(_complete_keys(groups), states.finish())


def two_score_groups(
    df: DataFrame,
    measures: Sequence[Measure] = STANDARD,
    *,
    tables: Sequence[str] = tuple(TABLES),
    judge_col: str = JUDGE_COLUMN,
) -> DataFrame:
    """Groups with the states of both scores, and one group per file. Aggregates the rows when it is called."""
    types = {field.name: field.dataType for field in df.schema.fields}
    scored = df.withColumns(
        {
            "has_score": F.col(SCORE).isNotNull(),
            "score": coerce_score(F.col(SCORE), types[SCORE]),
            "fallback": coerce_score(F.col(FALLBACK_SCORE), types[FALLBACK_SCORE]),
        }
    )
    sets = {**{t: TABLES[t] for t in tables}, BY_FILE: []}
    return _together(_rolled_up(derive_fields(scored, judge_col=judge_col), sets, _States(["score", "fallback"], measures)))


def choose_score(groups: DataFrame, measures: Sequence[Measure] = STANDARD) -> DataFrame:
    """Pick the score of every file from the groups of :func:`two_score_groups`. Counts the files' rows when it is called."""
    files = groups.filter(F.col("table") == BY_FILE).select("source_file", F.col(_HAS).alias("_has"), F.col(_ROWS).alias("_n"))
    tables = _complete_keys(groups.filter(F.col("table") != BY_FILE)).drop(_ROWS, _HAS)
    chosen = lookup_join(tables, files, "source_file", "_n")
    return _result(chosen, _States(["score", "fallback"], measures).finish(F.col("_has")))


def result_table(results: DataFrame, name: str) -> DataFrame:
    """One of the four tables with its own keys, from the rows of :func:`report`."""
    columns = [c for c in results.columns if c != "table" and c not in _KEYS]
    return results.filter(F.col("table") == name).select("source_file", *TABLES[name], *columns)
