"""What a Python worker keeps from task to task: one thing at a time.

Workers outlive tasks and serve all operators of a session. An encoder's memory of words is worth keeping for the next
task of its stage, and is dropped when the worker turns to something else.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    _HELD.clear()
