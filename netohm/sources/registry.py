"""Named libraries of a session, two of which are compared."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from netohm.sources.spef import SpefLibrary, read_spef, unique_name


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.libraries: dict[str, SpefLibrary] = {}
        self.paths: dict[str, str] = {}
        self._reference: str | None = None
        self._fit: str | None = None

    def add(self, path: str, name: str | None = None) -> str:
        """Read a file under a name, by default that of the file, numbered if it is taken. A given name must be new."""
        if name is None:
            name = unique_name(os.path.splitext(os.path.basename(path))[0] or "spef", set(self.libraries))
        elif not name or name in self.libraries:
            raise ValueError(f"the name {name!r} is empty or taken")
        self.libraries[name], self.paths[name] = read_spef(self.spark, path, name), path
        return name

    def add_all(self, paths: list[str]) -> dict[str, Exception]:
        """Read several files; the errors of those that fail, by path."""
        failed: dict[str, Exception] = {}
        for p in paths:
            try:
                self.add(p)
            except Exception as e:  # noqa: BLE001  a file that fails is reported, the others stay
                failed[p] = e
        return failed

    def remove(self, name: str) -> None:
        del self.libraries[name], self.paths[name]

    def choose(self, reference: str | None = None, fit: str | None = None) -> None:
        for n in (reference, fit):
            if n is not None and n not in self.libraries:
                raise KeyError(n)
        self._reference, self._fit = reference or self._reference, fit or self._fit

    @property
    def pair(self) -> tuple[str, str] | None:
        """The chosen reference and fit; the first two libraries where none is chosen, the only one twice."""
        names = list(self.libraries)
        if not names:
            return None
        reference = self._reference if self._reference in names else names[0]
        return reference, self._fit if self._fit in names else names[min(1, len(names) - 1)]
