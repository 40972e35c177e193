"""Named lists of callables: some watch (``emit``), some may replace a value (``reduce``)."""

from __future__ import annotations

from collections.abc import Callable

#: Run within the tasks; the others on the driver.
IN_TASKS = ("response", "links", "extract", "transform", "should_enqueue")


class Hooks:
    def __init__(self) -> None:
        self._by_name: dict[str, list[Callable]] = {}

    def on(self, name: str, fn: Callable) -> Callable[[], None]:
        """Register; the returned function takes it off again."""
        held = self._by_name.setdefault(name, [])
        held.append(fn)
        return lambda: held.remove(fn) if fn in held else None

    def has(self, name: str) -> bool:
        return bool(self._by_name.get(name))

    def of(self, *names: str) -> dict[str, list[Callable]]:
        return {n: list(self._by_name.get(n, [])) for n in names}

    def emit(self, name: str, *args) -> None:
        for fn in list(self._by_name.get(name, [])):
            fn(*args)

    def reduce(self, name: str, value, *args):
        return reduced(self._by_name.get(name, []), value, *args)


def reduced(fns: list[Callable], value, *args):
    """``value`` passed through the functions; one that returns None keeps it."""
    for fn in fns:
        new = fn(value, *args)
        value = value if new is None else new
    return value
