"""What Python workers share: objects built once and kept between tasks, and batches cut to a size."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

LIMIT = 4
# Bytes of an Arrow batch that are worked on at a time: batches grow with the rows of a task.
PIECE_BYTES = 8 << 20
_HELD: OrderedDict[str, Any] = OrderedDict()


def fresh_key() -> str:
    """A key no other call has had: object ids are used again after garbage collection."""
    return uuid.uuid4().hex


def resident(key: str, make: Callable[[], Any]) -> Any:
    """``make()`` of the first call with ``key`` in this worker; the ``LIMIT`` latest keys are kept."""
    if key in _HELD:
        _HELD.move_to_end(key)
    else:
        _HELD[key] = make()
        while len(_HELD) > LIMIT:
            _HELD.popitem(last=False)
    return _HELD[key]


def pieces(batch, limit: int = PIECE_BYTES) -> Iterator:
    """The rows of an Arrow batch in order, as slices of at most ``limit`` bytes each (one row at least)."""
    if batch.num_rows <= 1 or batch.nbytes <= limit:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), limit)
        yield from pieces(batch.slice(half), limit)
