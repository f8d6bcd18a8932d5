"""A bounded memory of computed values, for use inside a task."""

from __future__ import annotations

from collections.abc import Callable


class Recent(dict):
    """``recent[key]`` is ``make(key)``, remembered while the key is among the recent ones.

    When ``most`` values are kept they become the older half, from which a value that is asked
    for again returns; so at most twice ``most`` are held. Keys over ``longest`` are not kept.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def drop_older(self) -> None:
        """For the end of a task, where the memory outlives it."""
        self.older = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
