"""Pipelines: steps with dependencies run by levels, in threads that share one session; resume and batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession


class PipelineError(ValueError):
    pass


def validate(spec: dict, operations: dict[str, Callable], lenient: bool = False) -> list[str]:
    """Problems of a pipeline; raises on any unless ``lenient``."""
    ids = [s.get("id") for s in spec.get("steps", [])]
    problems = [f"step id {i} is used twice" for i in {i for i in ids if ids.count(i) > 1}]
    for s in spec.get("steps", []):
        problems += [f"{s.get('id')} depends on unknown {d}" for d in s.get("depends_on", []) if d not in ids]
        if s.get("run") not in operations:
            problems.append(f"{s.get('id')} runs unknown {s.get('run')}")
    if not problems:
        try:
            levels(spec)
        except PipelineError as e:
            problems.append(str(e))
    if problems and not lenient:
        raise PipelineError("; ".join(problems))
    return problems


def levels(spec: dict) -> list[list[str]]:
    """Steps by topological level (also what a dry run shows)."""
    needs = {s["id"]: set(s.get("depends_on", [])) for s in spec["steps"]}
    out: list[list[str]] = []
    while needs:
        ready = sorted(k for k, d in needs.items() if not d)
        if not ready:
            raise PipelineError(f"steps depend on each other: {', '.join(sorted(needs))}")
        out.append(ready)
        needs = {k: d - set(ready) for k, d in needs.items() if k not in ready}
    return out


def _filled(value: Any, variables: dict[str, Any], results: dict[str, Any]) -> Any:
    """Replace ${name} and ${step.output}; a value that is one reference keeps its type."""
    if isinstance(value, dict):
        return {k: _filled(v, variables, results) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, variables, results) for v in value]
    if not isinstance(value, str):
        return value

    def of(name: str) -> Any:
        step, _, rest = name.partition(".")
        if step in results:
            found = results[step]
            for part in [p for p in rest.split(".") if p and p != "output"]:
                found = found[part]
            return found
        if name in variables:
            return variables[name]
        raise PipelineError(f"no value for {name}")

    whole = re.fullmatch(r"\$\{([^}]+)\}", value)
    return of(whole[1]) if whole else re.sub(r"\$\{([^}]+)\}", lambda m: str(of(m[1])), value)


def run(spark: SparkSession, spec: dict, operations: dict[str, Callable], variables: dict[str, Any] | None = None, workers: int = 4, done: dict[str, Any] | None = None) -> dict[str, Any]:
    """Results by step. ``done`` has results of an earlier run (resume): those steps are not run again.

    A step may have ``when`` (skipped unless true) and ``repeat`` (run so often, with ``iteration`` as a variable).
    """
    validate(spec, operations)
    named = {s["id"]: s for s in spec["steps"]}
    known = dict(spec.get("vars", {})) | dict(variables or {})
    results: dict[str, Any] = dict(done or {})

    def one(step: dict) -> Any:
        if "when" in step and str(_filled(step["when"], known, results)).lower() in ("false", "0", "", "none"):
            return None
        out = None
        for k in range(int(step.get("repeat", 1))):
            out = operations[step["run"]](spark, **_filled(step.get("params", {}), known | {"iteration": k}, results))
        return out

    with ThreadPoolExecutor(max_workers=max(1, min(16, workers))) as pool:
        for level in levels(spec):
            todo = [i for i in level if i not in results]
            for i, r in zip(todo, pool.map(one, [named[i] for i in todo]), strict=True):
                results[i] = r
    return results


def batch(spark: SparkSession, specs: list[dict], operations: dict[str, Callable], fail_fast: bool = True, **options) -> list[dict]:
    out = []
    for spec in specs:
        try:
            out.append({"name": spec.get("name"), "results": run(spark, spec, operations, **options)})
        except Exception as e:
            if fail_fast:
                raise
            out.append({"name": spec.get("name"), "error": str(e)})
    return out


class Progress:
    """Stages of a job as a small JSON state."""

    def __init__(self, path: str, stages: tuple[str, ...]):
        self.path, self.stages = path, stages

    def state(self) -> dict[str, str]:
        try:
            with open(self.path) as f:
                return json.load(f)
        except FileNotFoundError:
            return dict.fromkeys(self.stages, "pending")

    def mark(self, stage: str, status: str) -> dict[str, str]:
        state = self.state() | {stage: status}
        with open(self.path, "w") as f:
            json.dump(state, f)
        return state

    def next(self) -> str | None:
        return next((s for s, v in self.state().items() if v != "done"), None)
