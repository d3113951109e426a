"""Provenance beside a dataset, guards that compare it, and configuration files."""

from __future__ import annotations

import dataclasses
import json
import warnings
from pathlib import Path
from typing import Any, TypeVar

C = TypeVar("C")
NAME = "preprocessing.json"


def save_meta(folder: str, meta: dict[str, Any]) -> None:
    """Write the sidecar: keys in order, two spaces."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, NAME).write_text(json.dumps(meta, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def load_meta(folder: str) -> dict[str, Any] | None:
    """The sidecar, or None where there is none."""
    path = Path(folder, NAME)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def assert_same(meta: dict[str, Any] | None, key: str, value: str) -> None:
    """Raise if the data were made with another tokenizer or processor; data without a sidecar pass."""
    made = (meta or {}).get(key)
    if made is not None and made != value:
        raise ValueError(f"the data were prepared with {key} {made!r}, not {value!r}")


def warn_if_longer(length: int, capacity: int | None) -> bool:
    """Warn if texts are cut longer than a model takes."""
    if capacity and length > capacity:
        warnings.warn(f"length {length} is above the model's capacity of {capacity}", stacklevel=2)
        return True
    return False


def _typed(value: Any, default: Any) -> Any:
    if isinstance(value, str) and isinstance(default, (int, float)) and not isinstance(default, bool):
        return type(default)(float(value)) if isinstance(default, int) else float(value)
    return value


def load_config(cls: type[C], path: str | None = None, overrides: dict[str, Any] | None = None) -> C:
    """A configuration dataclass from a JSON file and overrides; numbers in strings are read, unknown keys are errors."""
    values = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    values |= {k: v for k, v in (overrides or {}).items() if v is not None}
    fields = {f.name: f for f in dataclasses.fields(cls)}
    unknown = sorted(set(values) - set(fields))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return cls(**{k: _typed(v, fields[k].default) for k, v in values.items()})


def parse_pairs(items: list[str]) -> dict[str, str]:
    """``NAME=VALUE`` arguments, split at the first sign; white space stays."""
    out = {}
    for item in items:
        name, sign, value = item.partition("=")
        if not sign or not name:
            raise ValueError(f"{item!r} is not NAME=VALUE")
        out[name] = value
    return out


def total_steps(rows: int, batch: int, epochs: float, accumulate: int = 1) -> int:
    """Optimizer steps of a training run, at least one."""
    return max(1, int(-(-rows // (batch * accumulate)) * epochs))
