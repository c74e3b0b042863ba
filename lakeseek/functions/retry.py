"""Retries for driver-side plug-ins; tasks are retried by Spark itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_STATUS = {408, 409, 425, 429, 500, 502, 503, 504}
_WORDS = ("timeout", "timed out", "temporarily", "connection", "unavailable", "rate limit", "overloaded")


def is_transient(e: BaseException) -> bool:
    """Time-outs, broken connections and the usual HTTP states are worth another try."""
    if isinstance(e, (TimeoutError, ConnectionError)):
        return True
    states = [getattr(x, "status_code", None) for x in (e, getattr(e, "response", None))]
    known = [s for s in states if type(s) is int]
    if known:
        return known[0] in _STATUS
    return any(w in f"{type(e).__name__} {e}".lower() for w in _WORDS)


def retry(call: Callable[[], T], attempts: int = 3, base: float = 0.5, most: float = 20.0, wait: Callable[[float], None] = time.sleep) -> T:
    """The result of the first call that succeeds; waits grow twofold, each cut to 50-100 % at random."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts or not is_transient(e):
                raise
            wait(min(most, base * 2**k) * random.uniform(0.5, 1.0))
    raise ValueError("attempts must be at least 1")
