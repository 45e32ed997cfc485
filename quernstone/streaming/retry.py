"""Retrying a call with growing waits."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import TypeVar

R = TypeVar("R")


def network_error(error: BaseException) -> bool:
    """Errors of the network: connections, time-outs and name resolution."""
    return isinstance(error, (ConnectionError, TimeoutError)) or type(error).__module__.split(".")[0] in ("socket", "urllib", "http", "ssl")


def of_types(*types: type[BaseException]) -> Callable[[BaseException], bool]:
    return lambda error: isinstance(error, types)


def of_modules(*prefixes: str) -> Callable[[BaseException], bool]:
    return lambda error: type(error).__module__.startswith(prefixes)


@dataclass(frozen=True)
class Backoff:
    """Up to ``attempts`` calls; before the n-th repetition it waits ``base`` ** n seconds. Other errors are raised at once."""

    attempts: int = 5
    base: float = 2.0
    retries: Callable[[BaseException], bool] = network_error
    sleep: Callable[[float], None] = time.sleep

    def call(self, function: Callable[[], R]) -> R:
        for attempt in range(1, self.attempts + 1):
            try:
                return function()
            except Exception as error:
                if attempt == self.attempts or not self.retries(error):
                    raise
                self.sleep(self.base**attempt)
        raise ValueError("a call needs at least one attempt")


def _always(error: BaseException) -> bool:
    return isinstance(error, Exception)


#: Backoffs by name: one that repeats after any error, and one that repeats after errors of the network only.
BACKOFFS: dict[str, Callable[..., Backoff]] = {"exponential": partial(Backoff, retries=_always), "network": Backoff}


def backoff(name: str, **options) -> Backoff:
    try:
        return BACKOFFS[name](**options)
    except KeyError:
        raise ValueError(f"no backoff {name!r}; there are {', '.join(BACKOFFS)}") from None
