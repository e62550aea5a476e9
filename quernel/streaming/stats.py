"""Counts of ingested batches, and how far a stream lies behind its source."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class BatchResult:
    """What one batch did. Counts of rows, but ``failures`` and ``retries`` of attempts."""

    batch_id: int
    consumed: int = 0
    malformed: int = 0
    inserted: int = 0
    duplicates: int = 0
    property_rows: int = 0
    catalog_entries: int = 0
    dead_letters: int = 0
    failures: int = 0
    retries: int = 0


@dataclass
class Stats:
    """Totals over the batches of a process; a replayed batch counts again."""

    batches: int = 0
    consumed: int = 0
    malformed: int = 0
    inserted: int = 0
    duplicates: int = 0
    property_rows: int = 0
    dead_letters: int = 0
    failures: int = 0
    retries: int = 0

    def add(self, result: BatchResult) -> None:
        self.batches += 1
        for f in fields(self):
            if f.name != "batches":
                setattr(self, f.name, getattr(self, f.name) + getattr(result, f.name))


def lag(progress) -> dict[str, int]:
    """Messages of each ``topic:partition`` that a stream has still to read, from its last progress (of a source that has offsets)."""
    out: dict[str, int] = {}
    offsets = lambda x: json.loads(x) if isinstance(x, str) else (x or {})
    for source in (progress or {}).get("sources", ()):
        latest, end = offsets(source.get("latestOffset")), offsets(source.get("endOffset"))
        if not isinstance(latest, dict) or not isinstance(end, dict):
            continue
        for topic, parts in latest.items():
            for part, at in parts.items() if isinstance(parts, dict) else ():
                out[f"{topic}:{part}"] = max(0, at - (end.get(topic) or {}).get(part, 0))
    return out
