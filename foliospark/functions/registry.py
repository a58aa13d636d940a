"""Named functions, so that engines and plug-ins can be swapped: built-in names win over plug-ins."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from importlib.metadata import entry_points

GROUPS = ("detectors", "ocr_engines", "ocr_correctors", "translators", "transliterators", "sfx_classifiers", "assistants", "renderers")


class Registry:
    def __init__(self, group: str, builtin: dict[str, Callable] | None = None, prefix: str = "foliospark"):
        if group not in GROUPS:
            raise ValueError(f"unknown group {group}")
        self.group, self.builtin, self.prefix = group, dict(builtin or {}), prefix

    def plugins(self) -> dict[str, Callable]:
        """Functions of installed packages; one that cannot be loaded gives a warning."""
        found = {}
        for e in entry_points(group=f"{self.prefix}.{self.group}"):
            try:
                found[e.name] = e.load()
            except Exception as error:  # noqa: BLE001
                warnings.warn(f"{self.group} plug-in {e.name}: {error}", stacklevel=2)
        return found

    def get(self, name: str) -> Callable:
        known = self.plugins() | self.builtin
        if name not in known:
            raise ValueError(f"unknown {self.group} {name}; known: {', '.join(sorted(known)) or 'none'}")
        return known[name]
