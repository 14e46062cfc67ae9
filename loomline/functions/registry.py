"""Functions under names: an allow-list from which rows choose what to run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    """Column functions by name. Only what is registered runs; a name is registered once."""

    def __init__(self):
        self._functions: dict[str, tuple[Callable[..., Column], str]] = {}

    def register(self, name: str, function: Callable[..., Column], description: str = "") -> None:
        if name in self._functions:
            raise ValueError(f"already registered: {name}")
        self._functions[name] = (function, description)

    def specs(self) -> list[dict]:
        """Names and descriptions, in order of names."""
        return [{"name": k, "description": v[1]} for k, v in sorted(self._functions.items())]

    def execute(self, name: str, *arguments: Column) -> Column:
        if name not in self._functions:
            raise KeyError(name)
        return self._functions[name][0](*arguments)

    def dispatch(self, name: Column, *arguments: Column) -> Column:
        """``struct<ok, value, error>`` of the function that each row names; an unknown name is an error and no exception."""
        value, known = F.lit(None), F.lit(False)
        for k in self._functions:
            value = F.when(name == k, self.execute(k, *arguments)).otherwise(value)
            known |= name == k
        known = F.coalesce(known, F.lit(False))
        return F.struct(known.alias("ok"), value.alias("value"), F.when(~known, F.concat(F.lit("not registered: "), F.coalesce(name, F.lit("")))).alias("error"))
