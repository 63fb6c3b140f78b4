"""JSON state values: kept as the text that was written until an operation has to look inside."""

from __future__ import annotations

import json

from ..errors import Deserialization


class Raw:
    """A value that was set as a whole: its text is given back unchanged."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def parsed(value):
    if not isinstance(value, Raw):
        return value
    try:
        return json.loads(value.text)
    except (TypeError, ValueError) as e:
        raise Deserialization(str(e)) from None


def text_of(value) -> str:
    return value.text if isinstance(value, Raw) else json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
