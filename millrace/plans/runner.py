"""A run of named steps: each may fail the run, a gate decides on publishing at the end."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Report:
    """What a run did: (step, passed, seconds) in order, and whether it published."""

    steps: list[tuple[str, bool, float]] = field(default_factory=list)
    published: bool = False

    @property
    def passed(self) -> bool:
        return all(ok for _, ok, _ in self.steps)


def run(steps: list[tuple[str, Callable[[], object]]], gate: Callable[[], bool] | None = None, publish: Callable[[], object] | None = None) -> Report:
    """Runs steps until one raises or returns False. If all passed and the gate (if any) holds, publishes."""
    report = Report()

    def attempt(name: str, f: Callable) -> bool:
        began = time.monotonic()
        try:
            ok = f() is not False
        except Exception:
            report.steps.append((name, False, time.monotonic() - began))
            raise
        report.steps.append((name, ok, time.monotonic() - began))
        return ok

    for name, f in steps:
        if not attempt(name, f):
            return report
    if gate is not None and not attempt("gate", gate):
        return report
    if publish is not None:
        report.published = attempt("publish", publish)
    return report
