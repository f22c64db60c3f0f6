"""A bounded memo for per-word results inside Python workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class WordCache(dict):
    """Two generations of at most ``size`` entries each; words in use survive a turnover.

    ``cache[word]`` computes a missing value with ``make``; memory stays bounded whatever the input.
    """

    def __init__(self, make: Callable[[Any], Any], size: int = 300_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: Any) -> Any:
        value = self.old.pop(word, None)
        if value is None:
            value = self.make(word)
        self.put(word, value)
        return value

    def put(self, word: Any, value: Any) -> None:
        """Store a value; when the generation is full, it becomes the old one."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
