"""Column selectors: where in a message a column's value stands.

``a.b[0]["k"]`` is a path into the value, ``meta("key")``, ``meta("header").h`` and ``meta("timestamp")`` anchor elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PARSE, EngineError

_STEP = re.compile(r"""\.?([A-Za-z_][A-Za-z0-9_]*)|\[\s*(\d+)\s*\]|\[\s*["']([^"']*)["']\s*\]""")
_META = re.compile(r"""^\s*meta\(\s*["'](\w+)["']\s*\)""")
ANCHORS = ("header", "key", "timestamp")


@dataclass
class Selector:
    anchor: str  # value, key, header or timestamp
    path: list[str | int]

    def json_path(self, skip: int = 0) -> str:
        return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in self.path[skip:])


def parse_selector(text: str, injecting: bool = False) -> Selector:
    """``injecting``: the selector says where a sink puts a column, which needs a path within JSON keys."""
    anchor, rest = "value", text.strip()
    if m := _META.match(rest):
        anchor, rest = m[1].lower(), rest[m.end() :]
        if anchor not in ANCHORS:
            raise EngineError(PARSE, f"meta({m[1]!r}): one of {', '.join(ANCHORS)}")
    path: list[str | int] = []
    at = 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            raise EngineError(PARSE, f"invalid selector {text!r}")
        path.append(int(m[2]) if m[2] is not None else m[1] or m[3])
        at = m.end()
    if anchor == "timestamp" and path:
        raise EngineError(PARSE, 'meta("timestamp") takes no path')
    if (anchor == "header" and not path) or (anchor == "value" and not path):
        raise EngineError(PARSE, f"selector {text!r} names nothing")
    if injecting and any(isinstance(p, int) for p in path):
        raise EngineError(PARSE, f"selector {text!r}: a column can't be put into a list")
    return Selector(anchor, path)


def select(selector: Selector, key: Column, value: Column, headers: dict[str, Column] | Column, timestamp: Column) -> Column:
    """The selected value: text for paths into JSON, else the decoded column itself.

    ``headers``: a map column of decoded texts, or decoded columns by name.
    """
    if selector.anchor == "timestamp":
        return timestamp
    if selector.anchor == "header":
        name = selector.path[0]
        whole = headers[name] if isinstance(headers, dict) else F.try_element_at(headers, F.lit(name))
        return whole if len(selector.path) == 1 else F.get_json_object(whole, selector.json_path(1))
    whole = key if selector.anchor == "key" else value
    return F.get_json_object(whole, selector.json_path()) if selector.path else whole
