"""A lock beside a file, held while it is loaded, changed and saved."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

#: Seconds to wait for another writer, and after which a lock that nobody renews counts as left behind.
WAIT, LEFT_BEHIND = 60.0, 300.0
_held = threading.local()


@contextmanager
def locked(place: str | Path, *, wait: float = WAIT, step: float = 0.05) -> Iterator[None]:
    """Holds the file ``place``.lock; taking it again in the same thread is free. Raises TimeoutError."""
    path = f"{os.path.abspath(place)}.lock"
    own = _held.__dict__.setdefault("paths", set())
    if path in own:
        yield
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    end = time.monotonic() + wait
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            try:
                if time.time() - os.stat(path).st_mtime > LEFT_BEHIND:
                    os.unlink(path)
                    continue
            except FileNotFoundError:
                continue
            if time.monotonic() > end:
                raise TimeoutError(f"{path} is held by another writer") from None
            time.sleep(step)
    own.add(path)
    try:
        yield
    finally:
        own.discard(path)
        Path(path).unlink(missing_ok=True)
