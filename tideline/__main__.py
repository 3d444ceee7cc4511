"""Statements from the command line or standard input: ``python -m tideline --folder DIR ["statement; …"]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .functions.dialect import tokens
from .session import Session


def statements(text: str):
    """Cuts at semicolons outside of literals."""
    part, at = "", 0
    for group, t in tokens(text):
        start = text.index(t, at)
        if t == ";" and group == "op":
            yield part + text[at:start]
            part, at = "", start + 1
            continue
        part += text[at : start + len(t)]
        at = start + len(t)
    yield part + text[at:]


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tideline", description=__doc__)
    p.add_argument("--folder", required=True, help="shared storage of the catalog and tables")
    p.add_argument("--schema", default="default")
    p.add_argument("--rows", type=int, default=1000, help="rows shown of a result")
    p.add_argument("text", nargs="?", help="statements; standard input if missing")
    a = p.parse_args(args)
    session, failed = Session(SparkSession.builder.appName("tideline").getOrCreate(), a.folder, a.schema), 0
    for s in statements(a.text if a.text is not None else sys.stdin.read()):
        if s.strip():
            try:
                out = session.execute(s)
                if out.columns != ["result"]:
                    out.show(a.rows, truncate=session.line_width)
            except EngineError as e:
                failed = 1
                print(e, file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main())
