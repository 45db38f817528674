"""A bounded store for what is dear to make."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """Keeps the last ``most`` things made, by key. It is empty when sent to a worker, and lasts as
    long as the functions that were sent with it."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def __reduce__(self):
        return Memo, (self.most,)

    def get(self, key, make: Callable):
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[key] = make(key)
        return self.held[key]
