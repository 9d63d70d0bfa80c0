"""Snippets of source text for frontends, which work on strings; the same as the column functions give."""

from __future__ import annotations

import re


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(" ")


def snippet(text: str, limit: int = 180) -> str:
    """Collapsed text; a longer one is cut to the limit, dots included."""
    short = collapse(text)
    return short if len(short) <= limit else short[: limit - 3] + "..."


def context_snippet(text: str, start: int, stop: int, limit: int = 160) -> str:
    """What surrounds [start, stop), collapsed; a longer one is cut about its middle, trimmed and given dots."""
    pad = max(24, limit // 2)
    short = collapse(text[max(0, start - pad) : stop + pad])
    if len(short) <= limit:
        return short
    middle = (len(short) - limit) // 2
    return short[middle : middle + limit - 3].strip(" ") + "..."
