"""Conversion maps as parsed from JSON. Rules and items stay dictionaries: the compiler reads them once, on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

SCHEMA_VERSION = 1


@dataclass
class ScriptMap:
    system_code: str
    dependencies: list[str] = field(default_factory=list)
    stages: list[dict[str, Any]] = field(default_factory=list)
    aliases: dict[str, dict[str, Any]] = field(default_factory=dict)
    #: Only maps made in memory have functions: (text, options) -> text, or builders of Columns marked by column_function.
    functions: dict[str, Callable] = field(default_factory=dict)
    metadata: dict[str, Any] | None = None
    schema_version: int = SCHEMA_VERSION

    def rules(self, stage: str) -> list[dict[str, Any]] | None:
        """The rules of the first stage of that name."""
        return next((s.get("rules", []) for s in self.stages if s.get("name") == stage), None)


def normalise_map(spec: dict[str, Any]) -> ScriptMap:
    """A map from its JSON form. Functions in JSON have no code and are dropped; nothing is validated until it is compiled."""
    return ScriptMap(
        system_code=spec["systemCode"],
        dependencies=list(spec["dependencies"]),
        stages=list(spec["stages"]),
        aliases=dict(spec["aliases"].items()),
        metadata=spec.get("metadata") or None,
        schema_version=spec.get("schemaVersion", SCHEMA_VERSION),
    )
