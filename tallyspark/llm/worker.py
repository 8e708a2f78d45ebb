"""What a Python worker keeps from task to task: one object at a time, and no memory that a task has freed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """The object of this key, made once for each worker; what was kept before goes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Called by stages that keep nothing."""
    _kept.clear()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives memory back on its way and when it ends: Arrow's own pools hold on to what batches took, the system's does not."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        pool = pa.system_memory_pool()
        pa.set_memory_pool(pool)
        for n, out in enumerate(run(batches)):
            yield out
            if n % 16 == 0:
                pool.release_unused()
        pool.release_unused()

    return task
