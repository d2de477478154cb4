"""The one large object that a Python worker process keeps between its tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_KEPT: dict[Hashable, Any] = {}


def kept(name: Hashable, build: Callable[[], Any]) -> Any:
    """The object of this name, built once; the one of an earlier job is let go first."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = build()
    return _KEPT[name]


def free() -> None:
    """Lets go of an earlier job's object; for jobs that keep none of their own."""
    _KEPT.clear()
