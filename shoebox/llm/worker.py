"""One large helper at a time in each Python worker.

Workers are reused from stage to stage.  Encoders and scorers keep caches worth tens of megabytes; if
each stage left its own behind, a long job would outgrow the executor.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_held: list = []


def hold(kind: str, key, make: Callable[[], object]):
    """The helper of this kind and key; making it drops the one that was held before.

    Strings are compared by value, fitted models by identity.
    """
    if _held and _held[0] == kind and (_held[1] is key or (isinstance(key, str) and _held[1] == key)):
        return _held[2]
    let_go()
    _held[:] = [kind, key, make()]
    return _held[2]


def let_go() -> None:
    """Drop the helper of an earlier stage; work that needs none begins with this."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
