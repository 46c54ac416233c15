"""One JSON object per event on standard output."""

from __future__ import annotations

import json
from datetime import datetime, timezone


def log_event(event: str, **fields) -> dict:
    row = {"ts": datetime.now(timezone.utc).isoformat(), "event": event, **fields}
    print(json.dumps(row, default=str), flush=True)
    return row
