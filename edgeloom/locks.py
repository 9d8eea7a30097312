"""Named read/write locks of a process, held by sessions."""

from __future__ import annotations

import threading
import time
from collections import Counter

from . import errors


class Locks:
    """Writers exclude all others; readers exclude writers. A session that holds a lock can't take it again."""

    def __init__(self):
        self.held: dict[str, Counter] = {}
        self.modes: dict[str, str] = {}
        self.changed = threading.Condition()

    def take(self, name: str, owner: int, mode: str = "writing", timeout_ms: int | None = None) -> None:
        """timeout_ms: none waits for ever, 0 tries once."""
        until = None if timeout_ms is None else time.monotonic() + timeout_ms / 1000
        with self.changed:
            if self.held.get(name, Counter())[owner]:
                raise errors.SelfLockError(name)
            while self.held.get(name) and (mode == "writing" or self.modes[name] == "writing"):
                left = None if until is None else until - time.monotonic()
                if left is not None and left <= 0:
                    raise errors.TimeoutError_(name)
                self.changed.wait(left)
            self.held.setdefault(name, Counter())[owner] += 1
            self.modes[name] = mode

    def give(self, name: str, owner: int) -> None:
        with self.changed:
            if not self.held.get(name, Counter())[owner]:
                raise errors.NotHolderError(name)
            del self.held[name][owner]
            self.changed.notify_all()

    def give_all(self, owner: int) -> None:
        with self.changed:
            for holders in self.held.values():
                holders.pop(owner, None)
            self.changed.notify_all()


PROCESS = Locks()
