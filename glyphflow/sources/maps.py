"""Where maps come from: strategies are tried in order, and what they find is kept."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import TYPE_CHECKING, Any
from urllib.parse import unquote, urlparse

from ..errors import MapNotFoundError
from ..plans.model import ScriptMap, normalise_map

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

Strategy = Callable[[str], ScriptMap | None]


def folder_strategy(folder: str | Path) -> Strategy:
    """Maps from <folder>/<code>.json. A file that is missing, unreadable or no map counts as not found."""

    def find(code: str) -> ScriptMap | None:
        try:
            return normalise_map(json.loads((Path(folder) / f"{code}.json").read_text(encoding="utf-8")))
        except Exception:
            return None

    return find


def shared_folder_strategy(spark: SparkSession, folder: str) -> Strategy:
    """Maps from <folder>/<code>.json in any file system that Spark reads. A file that is missing, unreadable or no map counts as not found."""

    def find(code: str) -> ScriptMap | None:
        try:
            return normalise_map(json.loads(spark.read.text(f"{folder.rstrip('/')}/{code}.json", wholetext=True).first()["value"]))
        except Exception:
            return None

    return find


def relative_folder_strategy(relative_to: str, path: str) -> Strategy:
    """Maps from a folder beside a file (a file:// URL) or under a folder."""
    base = Path(unquote(urlparse(relative_to).path)).parent if relative_to.startswith("file://") else Path(relative_to)
    return folder_strategy(base / path)


def bundled_strategy(specs: Mapping[str, dict[str, Any]]) -> Strategy:
    """Maps from parsed JSON, by the key of the mapping; all are parsed at once, so a malformed one raises here."""
    known = {code: normalise_map(spec) for code, spec in specs.items()}
    return known.get


class MapLoader:
    def __init__(self, strategies: Sequence[Strategy] = (), on_loaded: Callable[[str, ScriptMap], None] | None = None):
        self.strategies, self.on_loaded = list(strategies), on_loaded
        self.cache: dict[str, ScriptMap] = {}
        self.known: dict[str, ScriptMap] = {}

    def load(self, code: str) -> ScriptMap:
        if (found := self.cache.get(code)) is not None:
            return found
        if (found := self.known.get(code)) is not None:
            self.cache[code] = found
            return found
        for find in self.strategies:
            if found := find(code):
                self.cache[code] = self.known[code] = found
                if self.on_loaded:
                    self.on_loaded(code, found)
                return found
        raise MapNotFoundError(code)

    def clear(self) -> None:
        """Forgets the cache; maps found before stay known."""
        self.cache.clear()

    def loaded_maps(self) -> list[str]:
        return list(self.known)

    def register(self, code: str, found: ScriptMap) -> None:
        self.known[code] = self.cache[code] = found
