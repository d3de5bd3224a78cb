"""Parameter syntax of commands."""

from __future__ import annotations

import re

TRUE = frozenset({"true", "1", "yes"})


def integers(text: str) -> list[int]:
    return [int(p) for p in re.split("[,;]", text) if p.strip()]


def numbers(text: str) -> list[float]:
    return [float(p) for p in re.split("[,;]", text) if p.strip()]


def paths(text: str) -> list[str]:
    return [p.strip() for p in re.split("[,;]", text) if p.strip()]


def transitions(text: str) -> dict[int, list[int]]:
    """``2:5:6,4:5`` or ``2>5,2>6,4>5``."""
    out: dict[int, list[int]] = {}
    for part in text.split(","):
        if part.strip():
            source, *targets = (int(p) for p in re.split("[:>]", part))
            out.setdefault(source, []).extend(targets)
    return out


def factors(text: str) -> dict[int, float]:
    """``1:-1,2:-20``."""
    return {int(k): float(v) for k, v in (p.split(":") for p in text.split(",") if p.strip())}


def remap(text: str) -> dict[int, int]:
    return {int(k): int(v) for k, v in (p.split(":") for p in text.split(",") if p.strip())}


def boolean(text: str) -> bool:
    return text.strip().lower() in TRUE


def version(text: str) -> tuple[int, int, int]:
    """Missing parts are 0."""
    parts = [int(p) for p in re.findall(r"\d+", text)[:3]]
    return tuple(parts + [0] * (3 - len(parts)))


def kebab(name: str) -> str:
    return "--" + name.replace("_", "-")


def command_line(command: str, parameters: dict) -> list[str]:
    """Snake-case parameters as flags; True is a bare flag, False and None are left out."""
    out = [command]
    for k, v in parameters.items():
        if v is True:
            out.append(kebab(k))
        elif v is not None and v is not False:
            out += [kebab(k), ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)]
    return out


def output_name(path: str, suffix: str = "resampled") -> str:
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_{suffix}.{ending}" if dot else f"{path}_{suffix}"


def epsg(wkt: str) -> str:
    """The last EPSG authority of a projection text, else its first 20 characters."""
    found = re.findall(r'AUTHORITY\["EPSG","(\d+)"\]', wkt)
    return f"EPSG:{found[-1]}" if found else wkt[:20]


def readable_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"


def template_errors(text: str) -> list[str]:
    """Placeholders and errors left over in a rendered report."""
    return re.findall(r"\{\{.*?\}\}|\{%.*?%\}|\bundefined\b|\bNaN\b|TemplateError[^\n]*", text)
