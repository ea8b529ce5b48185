"""Experiment configuration: a declared schema of typed fields, checked in one pass that reports every fault."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Field:
    """A key of the document (dotted where nested), how its value is read, and its value where the key may be absent."""

    key: str
    read: Callable[[object], object]
    default: object = None
    required: bool = True


def text(value: object) -> str:
    if value is None or isinstance(value, (dict, list)) or not str(value).strip():
        raise ValueError("is not a text")
    return str(value)


def metres(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)) or int(float(value)) != float(value) or int(float(value)) <= 0:
        raise ValueError("is not a whole number of metres")
    return int(float(value))


def texts(value: object) -> tuple[str, ...]:
    if not isinstance(value, (list, tuple)) or not value:
        raise ValueError("is not a list of one value or more")
    return tuple(text(v) for v in value)


#: The document's keys: fixed values of its format.
FIELDS = (
    Field("experiment_id", text),
    Field("aoi_id", text),
    Field("eval_set_id", text),
    Field("model_id", text),
    Field("modality", text),
    Field("bands", text),
    Field("chip_params.chip_size_m", metres),
    Field("chip_params.stride_m", metres),
    Field("cycles", texts),
)


class Experiment(dict):
    """The fields by the last part of their keys, also as attributes; other keys of the document as they are."""

    def __getattr__(self, name: str):
        if name in self:
            return self[name]
        raise AttributeError(name)

    @property
    def chip_size(self) -> int:
        return self["chip_size_m"]

    @property
    def stride(self) -> int:
        return self["stride_m"]


def checked(document: object, fields: tuple[Field, ...] = FIELDS) -> Experiment:
    """An Experiment, or one ValueError that names every field that is missing or wrong."""
    if not isinstance(document, dict):
        raise ValueError("the document is not a mapping")
    faults, values = [], {k: v for k, v in document.items() if k not in {f.key.split(".")[0] for f in fields}}
    for field in fields:
        at: object = document
        for part in field.key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None and not field.required:
            at = field.default
        try:
            values[field.key.rsplit(".", 1)[-1]] = field.read(at) if at is not None else faults.append(f"{field.key} is missing")
        except ValueError as e:
            faults.append(f"{field.key} {e}")
    if faults:
        raise ValueError("; ".join(faults))
    return Experiment(values)


def config_path(given: str | None = None, default: str = "experiment.yaml") -> Path:
    """``given``, else the environment's PLACELENS_EXPERIMENT unless it is blank, else ``default``."""
    return Path(next(p for p in (given, os.environ.get("PLACELENS_EXPERIMENT", "").strip(), default) if p))


def read_experiment(given: str | None = None, default: str = "experiment.yaml") -> Experiment:
    """The experiment of a YAML file; a missing file is a FileNotFoundError, a bad one a ValueError with its path."""
    import yaml

    path = config_path(given, default)
    try:
        return checked(yaml.safe_load(path.read_text(encoding="utf-8")))
    except (ValueError, yaml.YAMLError) as e:
        raise ValueError(f"{path}: {e}") from e


def is_stale(target: str, *inputs: str) -> bool:
    """Whether a file is absent or older than an input."""
    t = Path(target)
    return not t.exists() or any(Path(i).stat().st_mtime > t.stat().st_mtime for i in inputs)
