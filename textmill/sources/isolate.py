"""Readers in child processes that can be killed, one after another until one succeeds."""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Seconds that a reader may take in all, and that it may go without giving a chunk."""

    whole: float = 300.0
    stall: float = 45.0


class LegacyExtractionTimeout(Exception):
    """The name is what issue tables show for it."""


class ParserDied(Exception):
    """The child ended without a result."""


def _child(read: Callable, data: bytes, out) -> None:
    try:
        for chunk in read(data):
            out.send(("chunk", tuple(chunk)))
        out.send(("done", None))
    except BaseException as e:  # noqa: BLE001  told to the parent, which raises it
        out.send(("failed", (type(e).__name__, str(e))))
    finally:
        out.close()


def _isolated(read: Callable, data: bytes, limits: Limits) -> list[tuple]:
    """All chunks of one reader, or an exception; no chunk of a reader that fails later is kept."""
    context = multiprocessing.get_context("fork")  # readers may be closures
    ours, theirs = context.Pipe(duplex=False)
    child = context.Process(target=_child, args=(read, data, theirs), daemon=True)
    child.start()
    theirs.close()
    end, out = time.monotonic() + limits.whole, []
    try:
        while True:
            left = min(limits.stall, end - time.monotonic())
            if left <= 0 or not ours.poll(left):
                raise LegacyExtractionTimeout(f"no result within {limits.whole} s, or no chunk within {limits.stall} s")
            try:
                kind, value = ours.recv()
            except EOFError as e:
                raise ParserDied("the parser ended without a result") from e
            if kind == "chunk":
                out.append(value)
            elif kind == "done":
                return out
            else:
                raise type(value[0], (Exception,), {})(value[1])
    finally:
        if child.is_alive():
            child.kill()
        child.join()
        ours.close()


def cascade(readers: list[Callable], data: bytes, limits: Limits | None = None) -> Iterator[tuple]:
    """Chunks of the first reader that reads the data to its end; if none does, what the last one raised."""
    last: Exception | None = None
    for read in readers:
        try:
            yield from list(read(data)) if limits is None else _isolated(read, data, limits)
            return
        except Exception as e:  # noqa: BLE001  the next reader gets its turn
            last = e
    if last is not None:
        raise last
