"""What a Python worker keeps between batches and tasks: one machine at a time.

Automata and the caches of encoders are worth keeping while a worker does tasks of one stage. Workers go on to other
stages, so whatever is asked for next takes the place of what was held before.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable

_HELD: list = []


def held(key: Hashable, build: Callable):
    """What ``build`` made for this key, if it is still here."""
    if not _HELD or _HELD[0] != key:
        release()
        _HELD[:] = key, build()
    return _HELD[1]


def release() -> None:
    """Let go of what is held, as work that needs nothing of the kind does first."""
    if _HELD:
        _HELD.clear()
        gc.collect()  # automata and their states know each other
