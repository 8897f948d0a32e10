"""Counts of a join's rows without the rows: sides are counted by their keys first, and the counts multiplied.

Keys that many rows share make a join's rows grow with the square of its input;
what is left to join here is a row for each key of a side.
"""

from __future__ import annotations

import re

_NAME = r"`(?:[^`]|``)+`"
_COLUMN = rf"({_NAME})\.({_NAME})"
_SIDE = re.compile(rf"(?!LATERAL)(?:.*\s+AS\s+)?(?:{_NAME}\.)?({_NAME})", re.S)
_EQUAL = re.compile(rf"\({_COLUMN} (=|<=>) {_COLUMN}\)")
_ITEM = re.compile(rf"(count\(1\)|{_NAME}\.{_NAME})(?: AS {_NAME})?")


def _equalities(on: str) -> list[tuple] | None:
    """The pairs of columns that a condition sets equal, or None if it says anything else."""
    found = _EQUAL.findall(on)
    rest = _EQUAL.sub("", on)
    return found if found and re.fullmatch(r"(?:[\s()]|\bAND\b)*", rest) else None


def counted(items: list[str], left: str, right: str, on: str, groups: list[str]) -> tuple[list[str], str] | None:
    """(items, source) that give the same groups and counts as ``left JOIN right ON on``; None if it isn't such a query.

    Every item is a grouped column or COUNT(*), and every column says whose it is.
    """
    sides = [_SIDE.fullmatch(s) for s in (left, right)]
    pairs = _equalities(on)
    names = [m[1].lower() for m in sides if m]
    if pairs is None or len(names) < 2 or names[0] == names[1]:
        return None
    found = [_ITEM.fullmatch(x) for x in items]
    if not all(found) or not any(m[1] == "count(1)" for m in found):
        return None
    groups = [found[int(g) - 1][1] if g.isdigit() and 0 < int(g) <= len(found) else g for g in groups]
    columns = [re.fullmatch(_COLUMN, g) for g in groups]
    if not groups or not all(columns) or not {m[1].lower() for m in found} - {"count(1)"} <= {g.lower() for g in groups}:
        return None
    kept: list[dict[str, str]] = [{}, {}]
    for owner, column in [(m[1], m[2]) for m in columns] + [x for a, b, _, c, d in pairs for x in ((a, b), (c, d))]:
        if owner.lower() not in names:
            return None
        kept[names.index(owner.lower())].setdefault(column.lower(), f"{owner}.{column}")
    if any(a.lower() == c.lower() for a, _, _, c, _ in pairs):
        return None
    made = []
    for text, m, cols in zip((left, right), sides, kept, strict=True):
        made.append(f"(SELECT {', '.join(cols.values())}, count(1) AS `__rows` FROM {text} GROUP BY {', '.join(cols.values())}) AS {m[1]}")
    total = f"sum({sides[0][1]}.`__rows` * {sides[1][1]}.`__rows`)"
    return [re.sub(r"^count\(1\)", lambda _: total, x) for x in items], f"{made[0]} JOIN {made[1]} ON {on}"
