"""How long functions take, in the log."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from typing import ParamSpec, TypeVar

P, R = ParamSpec("P"), TypeVar("R")
log = logging.getLogger("plumeline")


def timed(fn: Callable[P, R]) -> Callable[P, R]:
    """Logs a function's seconds, errors too, at the level of debugging."""

    @functools.wraps(fn)
    def run(*args: P.args, **named: P.kwargs) -> R:
        began = time.perf_counter()
        try:
            return fn(*args, **named)
        finally:
            log.debug("%s took %.3f s", fn.__qualname__, time.perf_counter() - began)

    return run


def level(name: str) -> None:
    """Shows what is logged from a level on."""
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    log.setLevel(name.upper())
