"""Bounded histories: states of an input to go back to, and traces of steps."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

MAX_STATES, MAX_TRACE, MAX_RECENT = 128, 4096, 8


class History:
    """States in order, each different from the one before; the oldest go beyond `most`. A new state drops those that were undone."""

    def __init__(self, key: Callable[[Any], Any] = lambda state: state, most: int = MAX_STATES):
        self.key, self.most, self.states, self.at = key, most, [], -1

    def record(self, state: Any) -> bool:
        if self.states and self.key(self.states[self.at]) == self.key(state):
            return False
        self.states = [*self.states[: self.at + 1], state][-self.most :]
        self.at = len(self.states) - 1
        return True

    def undo(self) -> Any:
        self.at = max(0, self.at - 1)
        return self.states[self.at]

    def redo(self) -> Any:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.states[self.at]


class Trace:
    """Steps up to `most`; beyond, the last one replaces what stood last, and `truncated` says so."""

    def __init__(self, most: int = MAX_TRACE):
        self.most, self.steps, self.truncated = most, [], False

    def add(self, step: Any) -> None:
        if len(self.steps) < self.most:
            self.steps.append(step)
        else:
            self.steps[-1], self.truncated = step, True


def recent(paths: list[str], path: str, most: int = MAX_RECENT) -> list[str]:
    """The paths with this one first, each once."""
    return [path, *(p for p in paths if p != path)][:most]
