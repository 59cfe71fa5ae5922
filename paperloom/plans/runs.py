"""Runs: steps in order with a saved state, fan-outs item by item, gates that may send work back.

The state of a run is one small file, rewritten atomically at every boundary; results of
steps are tables below the run's folder, one folder per attempt, so superseded work is
kept.  A resumed run skips what is done and refuses to go on if its plan has changed.
A fan-out applies a function to the items that are not done yet, on the executors; a
failing item is a row, not an exception.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from paperloom.functions.text import new_run_id
from paperloom.operators.ingest import pending
from paperloom.plans.pipeline import PlanError, apply_stage, interpolate, with_slugs
from paperloom.sources.readers import STATE_VERSION, Decision, checkpoint, decision, read_small, write_small

DONE = ("completed", "skipped")
RESULT = StructType().add("id", StringType()).add("status", StringType()).add("outputs", StringType()).add("error", StringType())


@dataclass(frozen=True)
class RunStep:
    """A step: kind table (a function of tables), foreach (a function of an item) or gate (a decision)."""

    id: str
    kind: str = "table"
    uses: str = ""
    inputs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    outputs: tuple[str, ...] = ()
    max_failures: int | None = None
    on_reject: str | None = None
    optional: bool = False


class DriftError(PlanError):
    """A run whose plan is no longer the one it began with."""


def plan_hash(steps: list[RunStep], variables: dict[str, str]) -> str:
    frozen = json.dumps([[asdict(s) for s in steps], variables], sort_keys=True)
    return "sha256:" + hashlib.sha256(frozen.encode()).hexdigest()[:16]


def checked(steps: list[RunStep], functions: dict[str, Callable]) -> None:
    """Raise PlanError naming everything that keeps ``steps`` from running."""
    problems, seen = [], set()
    for s in steps:
        if not s.id or s.id in seen:
            problems.append(f"step id missing or used before: {s.id!r}")
        if s.kind not in ("table", "foreach", "gate"):
            problems.append(f"step {s.id}: unknown kind {s.kind!r}")
        if s.kind != "gate" and s.uses not in functions:
            problems.append(f"step {s.id}: no function {s.uses!r}")
        problems += [f"step {s.id}: input {i!r} is no earlier step" for i in s.inputs if i not in seen and not i.startswith("table:")]
        if s.kind == "foreach" and len(s.inputs) != 1:
            problems.append(f"step {s.id}: a fan-out has one input")
        if s.on_reject is not None and s.on_reject not in seen:
            problems.append(f"step {s.id}: on_reject {s.on_reject!r} is no earlier step")
        seen.add(s.id)
    if problems:
        raise PlanError("; ".join(problems))


def regenerate_note(previous: str, feedback: str) -> str:
    """What a function is told when its work was sent back: where the last attempt lies and why it wasn't taken."""
    return f"A reviewer sent the last attempt back.\nIt is kept at: {previous}\nWhat they asked for:\n{feedback}"


def stage_outcome(over_budget: Column, timed_out: Column, stalled: Column, aborted: Column, message: Column) -> Column:
    """struct(status, code): the first of budget, time, stall, abort and error that applies."""

    def outcome(status: str, code: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(code).cast("string").alias("code"))

    return (
        F.when(over_budget, outcome("failed", "TURN_BUDGET_EXCEEDED")).when(timed_out | stalled, outcome("failed", "TIMEOUT")).when(aborted, outcome("aborted", "EXTERNAL_ABORT"))
        .when(message.isNotNull(), outcome("failed", "AGENT_ERROR")).otherwise(outcome("completed", None))
    )


def contract(results: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    """``results`` (id, status, outputs, error) whose completed items must show every declared output.

    An item that only ran out of its budget counts as completed if it wrote them all.
    """
    if not outputs:
        return results
    made = F.from_json("outputs", "map<string,string>")
    lacking = F.filter(F.array(*[F.lit(o) for o in outputs]), lambda o: ~F.coalesce(F.array_contains(F.map_keys(made), o), F.lit(False)))
    rows = results.withColumn("_lacking", lacking)
    short = F.size("_lacking") > 0
    forgiven = (F.col("status") == "failed") & F.col("error").startswith("TURN_BUDGET_EXCEEDED") & ~short
    broken = (F.col("status") == "completed") & short
    status = F.when(forgiven, "completed").when(broken, "failed").otherwise(F.col("status"))
    error = F.when(broken, F.concat(F.lit("MISSING_OUTPUT: "), F.array_join("_lacking", ", "))).when(forgiven, None).otherwise(F.col("error"))
    return rows.withColumns({"status": status, "error": error}).drop("_lacking")


class Run:
    """One run of ``steps`` in ``folder``; a folder with a state is resumed.

    ``gate(step, run)`` gives a Decision, or None to leave the run waiting.  ``force``
    goes on with a changed plan, whose finished steps stay finished.
    """

    def __init__(self, spark: SparkSession, folder: str, steps: list[RunStep], functions: dict[str, Callable], tables: Callable[[str], DataFrame], variables: dict[str, str] | None = None, gate: Callable | None = None, force: bool = False):
        checked(steps, functions)
        self.spark, self.folder, self.steps, self.functions, self.tables, self.gate = spark, folder.rstrip("/"), steps, functions, tables, gate
        self.scope = with_slugs(variables or {})
        mine = plan_hash(steps, variables or {})
        if read_small(spark, self._state_path) is None:
            self.state = {"version": STATE_VERSION, "run_id": new_run_id(), "plan": mine, "status": "running", "n_events": 0, "steps": {}}
        else:
            self.state = checkpoint(spark, self._state_path)
            if self.state["plan"] != mine and not force:
                raise DriftError(f"the plan changed since run {self.state['run_id']} began; start a new run or force this one on")
            self.state["plan"] = mine

    @property
    def _state_path(self) -> str:
        return f"{self.folder}/status.json"

    def _save(self) -> None:
        write_small(self.spark, self._state_path, json.dumps(self.state, indent=1))

    def log(self, kind: str, **facts) -> None:
        """Append an event: a file of one line, read back by ``scan.events`` over the folder."""
        at = datetime.datetime.now(datetime.timezone.utc).isoformat()
        self.state["n_events"] += 1
        write_small(self.spark, f"{self.folder}/events/{self.state['n_events']:08d}.json", json.dumps({"at": at, "type": kind} | facts) + "\n")

    def _of(self, step: RunStep) -> dict:
        return self.state["steps"].setdefault(step.id, {"status": "pending", "attempts": 0})

    def _path(self, step: RunStep, attempt: int) -> str:
        return f"{self.folder}/{step.id}/attempt={attempt}"

    def table(self, step_id: str) -> DataFrame:
        """Result of a finished step; of a fan-out, its completed items in item order, then vanished ones by id."""
        step = next(s for s in self.steps if s.id == step_id)
        return self.spark.read.parquet(self._path(step, self.state["steps"][step_id]["attempts"]))

    def _inputs(self, step: RunStep) -> list[DataFrame]:
        return [self.tables(i.removeprefix("table:")) if i.startswith("table:") else self.table(i) for i in step.inputs]

    def run(self) -> str:
        """Go through the steps; the run's status: completed, failed or awaiting."""
        self.state["status"] = "running"
        at = 0
        while at < len(self.steps):
            step = self.steps[at]
            own = self._of(step)
            if own["status"] in DONE:
                at += 1
                continue
            own["started_at"] = datetime.datetime.now(datetime.timezone.utc).isoformat()
            own.pop("error", None)
            self.log("step_started", step=step.id)
            following = {"table": self._table_step, "foreach": self._foreach_step, "gate": self._gate_step}[step.kind](step, own)
            own["ended_at"] = datetime.datetime.now(datetime.timezone.utc).isoformat()
            self.log("step_ended", step=step.id, status=own["status"])
            if own["status"] == "awaiting" and following is None or own["status"] == "failed":
                self.state["status"] = own["status"]
                self._save()
                return self.state["status"]
            self._save()
            at = at + 1 if following is None else following
        self.state["status"] = "completed"
        self._save()
        return "completed"

    def _options(self, step: RunStep, own: dict) -> dict:
        options = {k: interpolate(v, self.scope) if isinstance(v, str) else v for k, v in step.options.items()}
        if own.get("feedback"):
            options["feedback"] = regenerate_note(self._path(step, own["attempts"]), own["feedback"])
        return options

    def _table_step(self, step: RunStep, own: dict) -> None:
        options, inputs = self._options(step, own), self._inputs(step)
        try:
            self.functions[step.uses](*inputs, **options).write.mode("overwrite").parquet(self._path(step, own["attempts"] + 1))
            own.update(status="completed", attempts=own["attempts"] + 1)
            own.pop("feedback", None)
        except Exception as cause:  # a step may fail in any way; the run records it and stops
            own.update(status="failed", error={"code": "BUILTIN_ERROR", "message": f"{type(cause).__name__}: {cause}"[:2000]})

    def _foreach_step(self, step: RunStep, own: dict) -> None:
        items = self._inputs(step)[0]
        function, options = self.functions[step.uses], self._options(step, own)
        attempt = own["attempts"] + 1
        carried = self.spark.createDataFrame([], RESULT)
        if own["attempts"] and not own.get("feedback"):  # work that was sent back is done anew
            carried = self.spark.read.parquet(self._path(step, own["attempts"])).where("status = 'completed'").select(*RESULT.names)
        todo = pending(items, carried, "id")
        raw = apply_stage(todo, lambda item: function(item, **options), "id").select(F.col("id").cast("string").alias("id"), "status", "outputs", "error")
        fresh = contract(raw, step.outputs).withColumn("carried", F.lit(False))
        places = items.select(F.col("id").cast("string").alias("id"), F.col("item_index").cast("bigint") if "item_index" in items.columns else F.lit(None).cast("bigint").alias("item_index"))
        rows = fresh.unionByName(carried.withColumn("carried", F.lit(True))).join(places, "id", "left")
        rows.orderBy(F.asc_nulls_last("item_index"), "id").write.mode("overwrite").parquet(self._path(step, attempt))
        done = self.spark.read.parquet(self._path(step, attempt))
        usage = F.from_json("outputs", "struct<turns: bigint>")["turns"]
        new, failed = (F.col("status") == "completed") & ~F.col("carried"), F.col("status") == "failed"
        tally = done.agg(F.count_if(new).alias("completed"), F.count_if(failed).alias("failed"), F.count_if(F.col("carried")).alias("carried"), F.coalesce(F.sum(usage), F.lit(0)).alias("turns"))
        counts = tally.first().asDict()
        own.update(attempts=attempt, tally=counts)
        spent = step.max_failures is not None and counts["failed"] >= step.max_failures
        if counts["failed"] and (spent or not counts["completed"] + counts["carried"]):
            message = f"{counts['failed']} of {counts['completed'] + counts['carried'] + counts['failed']} items failed" + (" (max_failures reached)" if spent else "")
            own.update(status="failed", error={"code": "AGENT_ERROR", "message": message})
            return
        own["status"] = "completed"
        own.pop("feedback", None)

    def _gate_step(self, step: RunStep, own: dict) -> int | None:
        if step.optional and not any(self.table(i).limit(1).count() for i in step.inputs if not i.startswith("table:")):
            own["status"] = "skipped"
            return None
        own["status"] = "awaiting"
        self._save()
        decision: Decision | None = self.gate(step, self) if self.gate else None
        if decision is None:
            return None
        own.setdefault("decisions", []).append({"action": decision.action, "feedback": decision.feedback, "target": decision.target})
        self.log("gate_decided", step=step.id, decision=decision.action)
        if decision.action in ("approve", "skip"):
            own["status"] = "completed" if decision.action == "approve" else "skipped"
            return None
        target = decision.target or step.on_reject
        ids = [s.id for s in self.steps]
        if decision.action == "abort" or target not in ids or target not in self.state["steps"]:
            message = "reviewer aborted the run" if decision.action == "abort" else f"sent back for revision, but {target!r} is no step that has run"
            own.update(status="failed", error={"code": "EXTERNAL_ABORT" if decision.action == "abort" else "BUILTIN_ERROR", "message": message})
            return None
        self.reopen(target, decision.feedback)
        own["status"] = "awaiting"
        return ids.index(target)

    def reopen(self, target: str, feedback: str | None = None) -> None:
        """Mark a step and everything after it as pending; the target learns the feedback."""
        ids = [s.id for s in self.steps]
        if target not in ids or target not in self.state["steps"]:
            raise PlanError(f"{target!r} is no step that has run")
        self.state["steps"][target]["feedback"] = feedback
        for step_id in ids[ids.index(target) :]:
            if step_id in self.state["steps"]:
                self.state["steps"][step_id]["status"] = "pending"
                self.state["steps"][step_id].pop("error", None)
        self._save()

    def redo(self, target: str, feedback: str | None = None) -> str:
        """Reopen a step of a finished run and run on from there."""
        if self.state["status"] == "running":
            raise PlanError("the run has not ended yet")
        self.reopen(target, feedback)
        return self.run()

    def failures(self) -> DataFrame:
        """(step, item, message) of everything that failed."""
        rows = self.spark.createDataFrame([(k, None, s["error"]["message"]) for k, s in self.state["steps"].items() if s.get("error")], "step string, item string, message string")
        for step in self.steps:
            own = self.state["steps"].get(step.id, {})
            if step.kind == "foreach" and own.get("attempts"):
                rows = rows.unionByName(self.table(step.id).where("status = 'failed'").select(F.lit(step.id).alias("step"), F.col("id").alias("item"), F.col("error").alias("message")))
        return rows


def file_gate(spark: SparkSession, folder: str) -> Callable[[RunStep, Run], Decision | None]:
    """A gate answered through files: a request is written, and a decision file beside it is taken once."""

    def decide(step: RunStep, run: Run) -> Decision | None:
        base = f"{folder.rstrip('/')}/{step.id}"
        made = decision(read_small(spark, f"{base}.decision.json"))
        if made is None:
            write_small(spark, f"{base}.request.json", json.dumps({"run_id": run.state["run_id"], "step": step.id, "show": list(step.inputs), "actions": ["approve", "revise", "skip", "abort"]}) + "\n")
        else:
            write_small(spark, f"{base}.decision.json", "")
        return made

    return decide


def model_choices(steps: DataFrame, agents: DataFrame, fallback: str | None) -> DataFrame:
    """(step, agent, model, max_turns) of ``steps`` (step, agent, model, max_turns): an agent's own choice, else the step's, else the fallback."""
    pins = agents.select(F.col("name").alias("agent"), F.col("model").alias("_model"), F.col("max_turns").alias("_turns"))
    joined = steps.join(pins, "agent", "left")
    return joined.select("step", "agent", F.coalesce("_model", "model", F.lit(fallback)).alias("model"), F.coalesce("_turns", "max_turns").alias("max_turns"))


def preflight(choices: DataFrame, known: DataFrame, credentials: DataFrame) -> DataFrame:
    """(provider, problem) before anything runs: models ``known`` (model) doesn't list, providers without ``credentials`` (provider)."""
    refs = choices.where("model IS NOT NULL").select("model").distinct().withColumn("provider", F.split_part("model", F.lit("/"), F.lit(1)))
    unknown = refs.join(known.select("model"), "model", "left_anti").select("provider", F.concat(F.lit("unknown model "), "model").alias("problem"))
    bare = refs.select("provider").distinct().join(credentials.select("provider"), "provider", "left_anti").select("provider", F.lit("no credentials").alias("problem"))
    return unknown.unionByName(bare)

