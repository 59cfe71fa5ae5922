"""Small dataflow plans: named steps of DataFrame functions with templates, checks and resume.

A plan is a list of steps (id, function, inputs, options).  It is checked before
anything runs; each step's table is written to the run's folder, which a resumed run
reads back instead of computing it again.  Per-item functions of users run as
``apply_stage`` over partitions, their failures being values of the result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from paperloom.functions.text import slug_of

_REFERENCE = re.compile(r"\$\{([^}]+)\}")


@dataclass(frozen=True)
class Step:
    id: str
    uses: str
    inputs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


class PlanError(ValueError):
    """A plan that can't run; the message lists every problem."""


def references(template: str) -> list[str]:
    """Names in ``${...}``, in order."""
    return _REFERENCE.findall(template)


def interpolate(template: str, scope: dict[str, str]) -> str:
    """The template with every reference replaced; an unknown one raises."""

    def value(m: re.Match) -> str:
        if m[1] not in scope:
            raise PlanError(f"unknown reference ${{{m[1]}}}")
        return str(scope[m[1]])

    return _REFERENCE.sub(value, template)


def with_slugs(variables: dict[str, str]) -> dict[str, str]:
    """Variables and, unless given, a file-name form ``<name>_slug`` of each."""
    return {f"{k}_slug": slug_of(str(v)) for k, v in variables.items()} | variables


def _places(document: str) -> list[str]:
    """line:column of each step of a YAML plan."""
    import yaml

    root = yaml.compose(document, Loader=yaml.SafeLoader)
    lists = [v for k, v in getattr(root, "value", []) if isinstance(root, yaml.MappingNode) and k.value == "steps"]
    return [f"{n.start_mark.line + 1}:{n.start_mark.column + 1}" for n in (lists[0].value if lists and isinstance(lists[0], yaml.SequenceNode) else [])]


def load_plan(document: str, functions: dict[str, Callable], variables: Iterable[str] | None = None) -> list[Step]:
    """Steps of a YAML plan ``{version: 1, steps: [...]}``; raises PlanError naming all problems and their line:column.

    ``variables``: the names templates may refer to; each also has its ``_slug`` form.
    """
    import yaml

    known = None if variables is None else set(variables) | {f"{v}_slug" for v in variables}
    try:
        loaded = yaml.safe_load(document)
        places = _places(document)
    except yaml.YAMLError as broken:
        raise PlanError(str(broken)) from None
    if not isinstance(loaded, dict) or loaded.get("version") != 1 or not isinstance(loaded.get("steps"), list):
        raise PlanError("a plan is a mapping with version: 1 and a list of steps")
    problems, steps, seen = [], [], set()
    for n, raw in enumerate(loaded["steps"]):
        raw = raw if isinstance(raw, dict) else {}
        if unknown := set(raw) - {"id", "uses", "inputs", "options"}:
            problems.append(f"{places[n]} step {n}: unknown keys {sorted(unknown)}")
        step = Step(str(raw.get("id", "")), str(raw.get("uses", "")), tuple(raw.get("inputs") or ()), dict(raw.get("options") or {}))
        if not step.id or step.id in seen:
            problems.append(f"{places[n]} step {n}: id missing or used before: {step.id!r}")
        if step.uses not in functions:
            problems.append(f"{places[n]} step {n}: no function {step.uses!r}")
        if known is not None:
            used = {r for v in step.options.values() if isinstance(v, str) for r in references(v)}
            problems += [f"{places[n]} step {step.id}: unknown reference ${{{r}}}" for r in sorted(used - known)]
        problems += [f"{places[n]} step {step.id}: input {i!r} is no earlier step" for i in step.inputs if i not in seen and not i.startswith("table:")]
        seen.add(step.id)
        steps.append(step)
    if problems:
        raise PlanError("; ".join(problems))
    return steps


def run_plan(spark: SparkSession, steps: list[Step], functions: dict[str, Callable], tables: Callable[[str], DataFrame], folder: str, variables: dict[str, str] | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Run ``steps`` in order; a table already complete in ``folder`` is read back (resume).

    Beside each table stands a hash of its step, its options and the tables it came from.
    If one differs, the plan or its inputs changed since: PlanError, unless ``force``
    computes that step and all that depend on it anew.
    """
    from paperloom.sources.readers import read_small, write_small

    scope, done, prints = with_slugs(variables or {}), {}, {}
    for step in steps:
        path = f"{folder.rstrip('/')}/{step.id}"
        inputs = [tables(i.removeprefix("table:")) if i.startswith("table:") else done[i] for i in step.inputs]
        options = {k: interpolate(v, scope) if isinstance(v, str) else v for k, v in step.options.items()}
        came_from = [fingerprint(df) if i.startswith("table:") else prints[i] for i, df in zip(step.inputs, inputs, strict=True)]
        prints[step.id] = hashlib.sha256(json.dumps([step.uses, options, came_from], sort_keys=True, default=str).encode()).hexdigest()
        found = read_small(spark, f"{path}.hash")
        if found is not None and found != prints[step.id] and not force:
            raise PlanError(f"step {step.id}: the plan or its inputs changed since its table was written")
        if found != prints[step.id]:
            functions[step.uses](*inputs, **options).write.mode("overwrite").parquet(path)
            write_small(spark, f"{path}.hash", prints[step.id])
        done[step.id] = spark.read.parquet(path)
    return done


def fingerprint(table: DataFrame) -> str:
    """What a table is read from: its files, or without any its plan, and its schema."""
    source = sorted(table.inputFiles()) or table._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    return json.dumps([source, table.schema.json()])


def apply_stage(items: DataFrame, function: Callable[[dict], dict], id_column: str, attempts: int = 1) -> DataFrame:
    """(id, status, outputs, error) of a user's function for each row: JSON outputs, errors as values."""
    kind = dict(items.dtypes)[id_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item in batch.to_dict("records"):
                status, outputs, error = "failed", None, None
                for _ in range(attempts):
                    try:
                        status, outputs, error = "completed", json.dumps(function(item), default=str), None
                        break
                    except Exception as cause:  # a stage may fail in any way
                        error = f"{type(cause).__name__}: {cause}"
                rows.append((item[id_column], status, outputs, error))
            yield pd.DataFrame(rows, columns=["id", "status", "outputs", "error"])

    return items.mapInPandas(run, f"id {kind}, status string, outputs string, error string")
