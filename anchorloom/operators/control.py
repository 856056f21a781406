"""Driver-side control of a sync run: one at a time, cancellable, with a heartbeat."""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager, suppress
from pathlib import Path

CANCEL_SECONDS, LOCK_EXTRA_SECONDS, HEARTBEAT_SECONDS = 600, 300, 10


class RunControl:
    """Files in a folder that all drivers share: lock, cancel flag, heartbeat."""

    def __init__(self, folder: str, budget_minutes: float = 30, clock=time.time):
        self.folder, self.ttl, self.clock = Path(folder), budget_minutes * 60 + LOCK_EXTRA_SECONDS, clock
        self.folder.mkdir(parents=True, exist_ok=True)
        self.deadline = clock() + budget_minutes * 60
        self._beat = 0.0

    def _read(self, name: str) -> dict | None:
        try:
            return json.loads((self.folder / name).read_text())
        except (OSError, ValueError):
            return None

    def locked(self) -> bool:
        held = self._read("lock")
        return bool(held) and held["at"] + self.ttl > self.clock()

    @contextmanager
    def lock(self):
        """Raises if another run holds the lock; a lock older than budget and margin is stale.

        A stale lock is moved aside under a name of its own, which only one run can do; if
        what was moved is not the stale one, a faster run had taken over and gets it back.
        The lock is given back only by the run whose mark it bears.
        """
        path, mark = self.folder / "lock", uuid.uuid4().hex
        held = self._read("lock")
        if held and held["at"] + self.ttl > self.clock():
            raise RuntimeError("another run is active")
        if held:
            aside = self.folder / f"stale-{mark}"
            with suppress(FileNotFoundError):
                os.rename(path, aside)
                if json.loads(aside.read_text()) != held:
                    with suppress(FileExistsError):
                        os.link(aside, path)
                aside.unlink()
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise RuntimeError("another run is active") from None
        with os.fdopen(fd, "w") as f:
            json.dump({"at": self.clock(), "mark": mark}, f)
        try:
            yield self
        finally:
            if (self._read("lock") or {}).get("mark") == mark:
                path.unlink(missing_ok=True)

    def cancel(self) -> None:
        (self.folder / "cancel").write_text(json.dumps({"at": self.clock()}))

    def cancelled(self) -> bool:
        flag = self._read("cancel")
        return bool(flag) and flag["at"] + CANCEL_SECONDS > self.clock()

    def out_of_time(self) -> bool:
        return self.clock() > self.deadline

    def heartbeat(self, progress: int) -> bool:
        """Write progress, at most every HEARTBEAT_SECONDS. True if it was written."""
        if self.clock() - self._beat < HEARTBEAT_SECONDS:
            return False
        self._beat = self.clock()
        (self.folder / "heartbeat").write_text(json.dumps({"at": self._beat, "progress": progress}))
        return True
