"""Progress of a scan and how it is called off: stages with their share of the whole, and a token that is asked between them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: Where each stage begins and ends in the whole.
BOUNDS = {
    "preparing": (0.00, 0.02),
    "discovering": (0.02, 0.08),
    "analyzing": (0.08, 0.68),
    "grouping": (0.68, 0.73),
    "refining": (0.73, 0.90),
    "ranking": (0.90, 0.93),
    "writing": (0.93, 0.96),
    "exporting": (0.96, 0.99),
    "complete": (1.00, 1.00),
    "reading_manifest": (0.00, 0.50),
    "loading_decisions": (0.50, 0.72),
    "loading_move_history": (0.72, 0.88),
    "preparing_review": (0.88, 1.00),
}


class ScanCancelled(Exception):
    """The scan was called off; nothing was left behind."""


class CancellationToken:
    """Set by whoever waits for a scan, from any thread."""

    def __init__(self):
        self._called_off = threading.Event()

    def cancel(self) -> None:
        self._called_off.set()

    def check(self) -> None:
        if self._called_off.is_set():
            raise ScanCancelled


@dataclass(frozen=True)
class Update:
    stage: str
    current: int
    total: int | None
    detail: str | None = None

    @property
    def stage_fraction(self) -> float | None:
        if self.total is None:
            return None
        return min(max(self.current / self.total, 0.0), 1.0) if self.total else 1.0

    @property
    def overall_fraction(self) -> float:
        low, high = BOUNDS[self.stage]
        return min(max(low + (high - low) * (self.stage_fraction or 0.0), 0.0), 1.0)


@dataclass
class Reporter:
    """Tells ``tell`` of every update, keeps how long each stage took, and stops where the token says so."""

    tell: Callable[[Update], None] = lambda update: None
    token: CancellationToken = field(default_factory=CancellationToken)
    timings: list[dict] = field(default_factory=list)

    def emit(self, stage: str, current: int = 0, total: int | None = None, detail: str | None = None) -> None:
        self.token.check()
        self.tell(Update(stage, current, total, detail))

    def stage(self, name: str, work: Callable, count: Callable | None = None):
        """Do the work of a stage between two updates; ``count`` says of its result how many items that were."""
        self.emit(name, 0, 1)
        began = time.perf_counter()
        result = work()
        elapsed = (time.perf_counter() - began) * 1000
        items = count(result) if count else None
        self.timings.append({"stage": name, "elapsed_ms": elapsed, "items": items, "items_per_second": items * 1000 / elapsed if items is not None and elapsed > 0 else None})
        self.emit(name, 1, 1)
        return result
