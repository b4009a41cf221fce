"""What a build has seen, from which its meta document is made."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from signalbase import config


class BuildReport:
    """Gathered while a build is planned and written: files by source, records by kind, warnings."""

    def __init__(self, taxonomy_version: str = config.UNKNOWN, at: dt.datetime | None = None):
        self.taxonomy_version = taxonomy_version
        self.at = (at or dt.datetime.now(dt.timezone.utc)).isoformat()
        self.warnings: list[str] = []
        self._files: dict[str, int] = {}
        self._kinds: dict[str, int] = {}

    def saw_files(self, source: str, n: int) -> None:
        self._files[source] = self._files.get(source, 0) + n

    def counted(self, kinds: Mapping[str, int]) -> None:
        """Takes the records of each kind, as counted from what was written."""
        self._kinds = dict(kinds)

    @property
    def total(self) -> int:
        return sum(self._kinds.values())

    def document(self) -> dict:
        values = (self.total, self._kinds, sum(self._files.values()), self.taxonomy_version, config.EXTRACTOR, self.at, self.warnings)
        return dict(zip(config.META_KEYS, values))
