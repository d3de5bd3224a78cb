"""Indicator plug-ins: a protocol, a registry, descriptors, discovery and help."""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..functions.parse import version


class PluginError(ValueError):
    pass


class Indicator(Protocol):
    def run(self, spark: SparkSession, parameters: dict[str, Any]) -> DataFrame: ...


@dataclass
class Parameter:
    name: str
    kind: str = "string"
    required: bool = False
    default: Any = None
    description: str = ""


@dataclass
class Descriptor:
    name: str
    library: str
    cls: str
    version: str = "1.0.0"
    author: str = ""
    description: str = ""
    min_version: str = "0"
    parameters: list[Parameter] = field(default_factory=list)
    inputs: list[dict] = field(default_factory=list)
    outputs: list[dict] = field(default_factory=list)
    builtin: bool = False


def read_descriptor(path: str) -> Descriptor:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    missing = [k for k in ("name", "library", "class") if not d.get(k)]
    if missing:
        raise PluginError(f"{path}: {', '.join(missing)} missing")
    parameters = [Parameter(p["name"], p.get("type", "string"), bool(p.get("required")), p.get("default"), p.get("description", "")) for p in d.get("parameters", [])]
    return Descriptor(d["name"], d["library"], d["class"], d.get("version", "1.0.0"), d.get("author", ""), d.get("description", ""), d.get("minVersion", "0"), parameters, d.get("inputs", []), d.get("outputs", []))


class Registry:
    def __init__(self) -> None:
        self.known: dict[str, tuple[Descriptor, Callable | None, str]] = {}
        self.warnings: list[str] = []

    def add(self, descriptor: Descriptor, run: Callable | None = None, folder: str = "") -> None:
        if descriptor.name in self.known:
            raise PluginError(f"the name {descriptor.name} is taken")
        if version(descriptor.min_version) > version(__version__):
            self.warnings.append(f"{descriptor.name} wants version {descriptor.min_version}")
        self.known[descriptor.name] = (descriptor, run, folder)

    def discover(self, *folders: str) -> list[str]:
        """Read every ``<folder>/<plugin>/plugin.json``; bad ones become warnings."""
        found = []
        for folder in folders:
            for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
                path = os.path.join(folder, name, "plugin.json")
                if os.path.exists(path):
                    try:
                        d = read_descriptor(path)
                        self.add(d, None, os.path.dirname(path))
                        found.append(d.name)
                    except (PluginError, json.JSONDecodeError) as e:
                        self.warnings.append(str(e))
        return found

    def call(self, spark: SparkSession, name: str, parameters: dict[str, Any] | None = None) -> DataFrame:
        if name not in self.known:
            raise PluginError(f"no plug-in {name}")
        descriptor, run, folder = self.known[name]
        given = dict(parameters or {})
        missing = sorted({p.name for p in descriptor.parameters if p.required} - given.keys())
        if missing:
            raise PluginError(f"{name} needs {', '.join(missing)}")
        given = {p.name: p.default for p in descriptor.parameters if p.default is not None} | given
        if run is None:
            run = _load(descriptor, folder)
        return run(spark, given)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(d.name, d.version, d.author, d.description, d.builtin) for d, _, _ in self.known.values()]
        return spark.createDataFrame(sorted(rows), "name string, version string, author string, description string, builtin boolean")

    def help(self, name: str) -> str:
        d = self.known[name][0]
        lines = [f"{d.name} {d.version}" + f" by {d.author}" * bool(d.author), d.description]
        lines += [f"  --{p.name} <{p.kind}>" + " (required)" * p.required + f" [{p.default}]" * (p.default is not None) + f"  {p.description}" for p in d.parameters]
        return "\n".join(x for x in lines if x)


def _load(d: Descriptor, folder: str) -> Callable:
    path = os.path.join(folder, d.library)
    if folder and os.path.exists(path):
        spec = importlib.util.spec_from_file_location(f"landloom_plugin_{d.name}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(d.library)
    return getattr(module, d.cls)().run
