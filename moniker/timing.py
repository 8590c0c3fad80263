"""Timing of steps (F16)."""

from __future__ import annotations

import logging
import time
from types import TracebackType

log = logging.getLogger(__name__)


class took:  # noqa: N801
    """with took("build") as t: ...; then t.seconds, which is also logged."""

    def __init__(self, label: str) -> None:
        self.label, self.seconds = label, 0.0

    def __enter__(self) -> took:
        self.began = time.perf_counter()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, where: TracebackType | None) -> None:
        self.seconds = time.perf_counter() - self.began
        log.info("%s took %.3f s", self.label, self.seconds)
