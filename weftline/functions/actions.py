"""Domain actions: named Python functions that operations may call."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import WeftlineError


@dataclass(frozen=True)
class Action:
    """``run(params, context, mapping)`` returns text; context reads the batch's tables."""

    name: str
    run: Callable
    description: str = ""
    params: dict = field(default_factory=dict)


class Actions:
    """A registry of an engine's own, so that engines don't share actions."""

    def __init__(self):
        self._known: dict[str, Action] = {}

    def register(self, name: str, run: Callable, description: str = "", params: dict | None = None) -> None:
        self._known[name] = Action(name, run, description, params or {})

    def clear(self) -> None:
        self._known.clear()

    def get(self, name: str) -> Action | None:
        return self._known.get(name)

    def names(self) -> list[str]:
        return sorted(self._known)

    def definitions(self) -> list[dict]:
        return [{"name": a.name, "description": a.description, "params": a.params} for _, a in sorted(self._known.items())]

    def load(self, folder: str | Path) -> list[str]:
        """Register the modules of a folder that have DEFINITION (name, description, params) and execute."""
        loaded = []
        for path in sorted(Path(folder).glob("*.py")) if Path(folder).is_dir() else ():
            if path.name.startswith("_"):
                continue
            spec = importlib.util.spec_from_file_location(f"weftline_action_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(module)
            except Exception as e:
                raise WeftlineError(f"action file {path}: {e}") from e
            definition, run = getattr(module, "DEFINITION", None), getattr(module, "execute", None)
            if definition and callable(run):
                self.register(definition["name"], run, definition.get("description", ""), definition.get("params", {}))
                loaded.append(definition["name"])
        return loaded
