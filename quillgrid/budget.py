"""Budgets and metrics of bounded answers."""

from __future__ import annotations

import json
import math
import time
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass, field

from .errors import BudgetError, EngineError


@dataclass(frozen=True)
class Budget:
    max_cells: int = 2000
    max_rows: int = 100
    max_chars: int = 12000

    def __post_init__(self):
        if min(self.max_cells, self.max_rows, self.max_chars) < 1:
            raise EngineError("budgets must be positive")

    def check(self, rows: int, cells: int) -> None:
        if rows > self.max_rows:
            raise BudgetError(f"the answer has more than {self.max_rows} rows")
        if cells > self.max_cells:
            raise BudgetError(f"the answer has more than {self.max_cells} cells")


@dataclass
class Metrics:
    counts: Counter = field(default_factory=Counter)
    seconds: Counter = field(default_factory=Counter)

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - began

    def report(self) -> dict:
        return {"counts": dict(sorted(self.counts.items())), "seconds": {k: round(v, 6) for k, v in sorted(self.seconds.items())}}


def plain(value):
    """A value as JSON can hold it: text, numbers, truth and null stay; all else becomes its text."""
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def compact(data, budget: Budget, metrics: Metrics | None = None) -> str:
    """Minified JSON within the character budget."""
    try:
        text = json.dumps(data, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except ValueError as e:
        raise EngineError("the answer holds a number that is not finite") from e
    if len(text) > budget.max_chars:
        raise BudgetError(f"the answer has {len(text)} characters; the budget is {budget.max_chars}")
    if metrics is not None:
        metrics.counts["response_chars"] += len(text)
        metrics.counts["response_tokens"] += math.ceil(len(text) / 4)
    return text
