"""Settings from a file of NAME=value lines; what the environment has already stays."""

from __future__ import annotations

import os
import re

LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")


def load(path: str = ".env", env: dict | None = None) -> list[str]:
    """Names that were set from the file; none without one.  Quotes around a value go; # begins a comment line."""
    into, found = os.environ if env is None else env, []
    try:
        with open(path, encoding="utf-8") as file:
            lines = file.read().splitlines()
    except OSError:
        return found
    for m in map(LINE.match, lines):
        if m and m[1] not in into:
            into[m[1]] = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "\"'" else m[2]
            found.append(m[1])
    return found
