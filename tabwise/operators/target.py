"""Target choice — user's column, else a keyword match with the statement, else the last column."""

from __future__ import annotations

import re


def _tokens(text: str) -> set[str]:
    return {t for t in re.split(r"[^a-z0-9]+", text.lower()) if t}


def choose_target(columns: list[str], statement: str = "", target: str | None = None,
                  exclude: tuple[str, ...] = ()) -> str | None:
    """Works on the schema only (no job). Column names are split on ``_``/non-alphanumerics; the column sharing
    the most tokens with the statement wins, ties go to the later column; no match → last column."""
    cols = [c for c in columns if c not in exclude]
    if target:
        if target not in columns:
            raise ValueError(f"target column {target!r} not in table")
        return target
    if not cols:
        return None
    words = _tokens(statement or "")
    best, best_hits = None, 0
    for c in cols:
        hits = len(_tokens(c.replace("_", " ")) & words)
        if hits and hits >= best_hits:
            best, best_hits = c, hits
    return best if best is not None else cols[-1]
