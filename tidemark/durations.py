"""Durations such as 30s, 5m, 1h, 2d."""

from __future__ import annotations

import re

SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_FORM = re.compile(r"(\d+)([smhd])")


def seconds(text: str, default: int = 300) -> int:
    """Seconds of a duration; what isn't one counts as five minutes."""
    m = _FORM.fullmatch(text or "")
    return int(m[1]) * SECONDS[m[2]] if m else default
