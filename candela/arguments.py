"""Arguments as callers send them: lists as text, names in any case, shorthand for scopes."""

from __future__ import annotations

import json
from collections.abc import Iterable

#: Shorthand for the scopes of a report.
SCOPE_NAMES = {
    "": "full", "all": "full", "comprehensive": "full",
    "short": "short_term", "shortterm": "short_term", "ngan_han": "short_term",
    "mid": "mid_term", "midterm": "mid_term", "medium": "mid_term", "medium_term": "mid_term", "trung_han": "mid_term",
    "long": "long_term", "longterm": "long_term", "dai_han": "long_term",
    "level": "levels", "support_resistance": "levels",
}
_QUOTES = " \t\r\n'\""


def names(value: str | Iterable | None) -> list[str] | None:
    """A list of names, each once: from a list, one name, names between commas, or a list written as text. None if there is none."""
    if value is None:
        return None
    if isinstance(value, str):
        value = value.strip()
        if value[:1] in ("[", "(") and value[-1:] in ("]", ")"):
            value = value[1:-1]
        value = value.split(",")
    elif not isinstance(value, Iterable):
        value = [value]
    found = [str(x).strip(_QUOTES) for x in value]
    return list(dict.fromkeys(x for x in found if x)) or None


def word(value: str, default: str = "") -> str:
    """One name in lower case without quotes."""
    return value.strip(_QUOTES).lower() or default


def scope(value: str) -> str:
    cleaned = word(value).replace("-", "_").replace(" ", "_")
    return SCOPE_NAMES.get(cleaned, cleaned)


def rows(value: str | list[dict]) -> list[dict]:
    """Rows given in the call: dictionaries, or JSON text of them."""
    found = json.loads(value) if isinstance(value, str) else value
    if not isinstance(found, list) or not all(isinstance(r, dict) for r in found):
        raise ValueError("rows must be a list of objects")
    return found
