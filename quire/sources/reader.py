"""An extractor in a process of its own, which can be killed.

A Python worker keeps one child for each extractor: it starts with the first page that is asked for, so a task without pages makes none, and it serves all
tasks that the worker runs.  A call that takes too long ends the child and all that it has started; the next call starts another.  A child that dies by itself counts
as a failed page.  An extractor that can't be made isn't tried again by that worker.

Messages are pickles with their length before them, over the child's standard streams; what an extractor prints goes to standard error.  The child ends when its input does.
"""

from __future__ import annotations

import atexit
import os
import pickle
import select
import signal
import socket
import struct
import subprocess
import sys
import time
from collections.abc import Callable
from typing import Any


class ExtractionError(Exception):
    pass


class EmptyResult(ExtractionError):
    """Worth another attempt."""


class PageTimeout(ExtractionError):
    """Worth an attempt without layout detection."""


class NoExtractor(ExtractionError):
    """It couldn't be made."""


ERRORS: dict[str, type[ExtractionError]] = {"empty": EmptyResult, "timeout": PageTimeout, "error": ExtractionError}


def packed(make: Callable[[], Any]) -> bytes:
    """What makes an extractor, as it is sent to tasks."""
    from pyspark import cloudpickle

    return cloudpickle.dumps(make)


class Reader:
    """Asks the extractor of a child process."""

    def __init__(self, made: bytes):
        self.made, self.child, self.failed, self.starts = made, None, "", 0
        self.method, self.load_s = "", 0.0

    def ask(self, what: str, path: str, *args, timeout: float = 0) -> Any:
        """What the extractor's method gives for the file at path; PageTimeout after so many seconds (0: none)."""
        self._start()
        return self._talk((what, path, args), timeout)

    def warm(self) -> None:
        """Starts the child where there is none; why it can't be made, ask() says."""
        try:
            self._start()
        except NoExtractor:
            pass

    def _start(self) -> None:
        if self.failed:
            raise NoExtractor(self.failed)
        if self.child is not None and self.child.poll() is None:
            return
        began = time.perf_counter()
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.child = subprocess.Popen([sys.executable, "-m", "quire.sources.reader"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env, start_new_session=True)
        self.starts += 1
        try:
            about = self._talk(self.made, 0)
        except ExtractionError as e:
            self.close()
            self.failed = f"no extractor: {e}"
            raise NoExtractor(self.failed) from e
        self.method, self.load_s = about["method"], time.perf_counter() - began

    def _talk(self, message: Any, timeout: float) -> Any:
        child = self.child
        try:
            _put(child.stdin, message)
            until = time.monotonic() + timeout
            # a reply comes in one piece, or its process hangs within it: both are waited for here
            found = _get(child.stdout, (lambda: until - time.monotonic()) if timeout else None)
        except TimeoutError:
            self.close()
            raise PageTimeout(f"no result in {timeout:g} seconds") from None
        except (OSError, EOFError):
            code = child.wait()
            self.close()
            raise ExtractionError(f"the extractor's process ended ({code})") from None
        kind, value = found
        if kind == "ok":
            return value
        if kind == "timeout":  # what hung elsewhere may hang still
            self.close()
        raise ERRORS[kind](value)

    def close(self) -> None:
        """Ends the child and what it has started."""
        child, self.child = self.child, None
        if child is not None:
            try:
                os.killpg(child.pid, signal.SIGKILL)
            except OSError:
                pass
            child.wait()
            for pipe in (child.stdin, child.stdout):
                try:
                    pipe.close()
                except OSError:
                    pass


_READERS: dict[bytes, Reader] = {}


def reader(made: bytes) -> Reader:
    """This worker's own reader for what makes an extractor."""
    if made not in _READERS:
        _READERS[made] = Reader(made)
        atexit.register(_READERS[made].close)
    return _READERS[made]


class Slot:
    """One of `count` places for extractors that work at once on an executor; others wait.  0: no bound.

    A place is a name of a socket that one process at a time can bind, and that is free again whatever becomes of it.
    """

    def __init__(self, count: int, of: str | None = None):
        self.count, self.of, self.held = count, of or f"quire-{os.getppid()}", None  # workers of an executor have one parent

    def __enter__(self) -> "Slot":
        while self.count and self.held is None:
            for i in range(self.count):
                s = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
                try:
                    s.bind(f"\0{self.of}-{i}")
                    self.held = s
                    return self
                except OSError:
                    s.close()
            time.sleep(0.02)
        return self

    def __exit__(self, *_) -> None:
        if self.held is not None:
            self.held.close()
            self.held = None


def content(path: str) -> bytes:
    """A file's bytes, read where they are needed."""
    from pyarrow import fs

    if "://" in path:
        store, path = fs.FileSystem.from_uri(path)
        with store.open_input_file(path) as file:
            return file.read()
    with open(path.removeprefix("file:") if path.startswith("file:/") else path, "rb") as file:
        return file.read()


def _put(stream, message: Any) -> None:
    data = pickle.dumps(message)
    stream.write(struct.pack("<q", len(data)) + data)
    stream.flush()


def _get(stream, left: Callable[[], float] | None = None) -> Any:
    return pickle.loads(_read(stream, struct.unpack("<q", _read(stream, 8, left))[0], left))


def _read(stream, size: int, left: Callable[[], float] | None) -> bytes:
    pieces, n = [], 0
    while n < size:
        if left is not None and not select.select([stream], [], [], max(0.0, left()))[0]:
            raise TimeoutError
        out = os.read(stream.fileno(), min(size - n, 1 << 20))
        if not out:
            raise EOFError
        pieces.append(out)
        n += len(out)
    return b"".join(pieces)


def _serve() -> None:
    """The child: makes the extractor, then answers until its input ends."""
    replies = os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)
    requests = os.fdopen(os.dup(0), "rb", buffering=0)
    try:
        extractor = pickle.loads(_get(requests, None))()
        _put(replies, ("ok", {"method": getattr(extractor, "method", "")}))
    except Exception as e:
        _put(replies, ("error", str(e) or type(e).__name__))
        return
    last: tuple[str, bytes | None] = ("", None)
    while True:
        try:
            what, path, args = _get(requests, None)
        except EOFError:
            return
        try:
            if path != last[0]:
                last = (path, None if getattr(extractor, "opens_files", False) else content(path))
            found = ("ok", getattr(extractor, what)(path, last[1], *args))
        except EmptyResult as e:
            found = ("empty", str(e))
        except PageTimeout as e:
            found = ("timeout", str(e))
        except Exception as e:  # a page's failure is its own
            found = ("error", str(e) or type(e).__name__)
        _put(replies, found)


if __name__ == "__main__":
    from quire.sources import reader as _own  # under its own name, so that its errors are those that extractors raise

    _own._serve()
