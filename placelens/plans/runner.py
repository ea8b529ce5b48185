"""Stages of a batch run as plain functions, run in order until one fails."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    what: str
    run: Callable[[], object]


def pick(stages: list[Stage], first: str | None = None, last: str | None = None, only: str | None = None) -> list[Stage]:
    """A range of the stages, ends included."""
    names = [s.name for s in stages]
    for n in (first, last, only):
        if n is not None and n not in names:
            raise ValueError(f"unknown stage {n}; known: {', '.join(names)}")
    if only:
        return [stages[names.index(only)]]
    a, b = names.index(first) if first else 0, names.index(last) if last else len(stages) - 1
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return stages[a : b + 1]


def plan_text(stages: list[Stage]) -> str:
    return "\n".join(f"{i:>2}. {s.name:20s} {s.what}" for i, s in enumerate(stages, 1))


def run(stages: list[Stage], dry: bool = False) -> dict[str, object]:
    """Results by stage; an exception stops the run and names its stage."""
    done: dict[str, object] = {}
    for s in [] if dry else stages:
        try:
            done[s.name] = s.run()
        except Exception as e:
            raise RuntimeError(f"stage {s.name} failed after {', '.join(done) or 'none'}") from e
    return done


def swap_model(old: str, new: str, load: Callable[[str], object], evaluate: Callable[[str], bool], purge: Callable[[str], object]) -> bool:
    """Load the new model, evaluate it, and purge the old one only if it passes."""
    if old == new:
        raise ValueError("the models are the same")
    load(new)
    passed = evaluate(new)
    if passed:
        purge(old)
    return passed
