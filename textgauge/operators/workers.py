"""What Python workers keep between tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

_held: dict[str, object] = {}


def once_per_worker(make: Callable[[], object]) -> Callable[[], object]:
    """A function that calls ``make`` in a Python worker once and then returns the same result.

    Workers live on between tasks, so a model is loaded per worker, not per task. Only the latest
    is held.
    """
    name = uuid.uuid4().hex

    def load() -> object:
        from textgauge.operators import workers

        if name not in workers._held:
            workers._held.clear()
            workers._held[name] = make()
        return workers._held[name]

    return load
