"""Runs named steps in order: dry, from a step on, or leaving out what is done."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple


class Step(NamedTuple):
    name: str
    run: Callable[[], object]
    done: Callable[[], bool] = lambda: False


def run_steps(steps: Sequence[Step], start: str | None = None, skip_done: bool = False, dry: bool = False, log: Callable[[str], None] = print) -> list[str]:
    """Names of the steps that were (or, dry, would be) run. A step that fails ends the run, and is named."""
    names = [s.name for s in steps]
    if len(set(names)) < len(names):
        raise ValueError("steps share a name")
    if start is not None and start not in names:
        raise ValueError(f"no step {start}")
    out = []
    for step in steps[names.index(start) if start else 0 :]:
        if skip_done and step.done():
            log(f"done     {step.name}")
            continue
        log(f"{'would run' if dry else 'run'} {step.name}")
        if not dry:
            try:
                step.run()
            except Exception as e:
                raise RuntimeError(f"{step.name} failed") from e
        out.append(step.name)
    return out
