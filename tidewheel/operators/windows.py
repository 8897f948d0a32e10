"""Window frames and functions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Bounds: None is unbounded, 0 the current row, -n n preceding, n n following.
UNBOUNDED = None


def frames(n: int = 1) -> dict[str, tuple[str, int | None, int | None]]:
    """The 32 frames by name: (kind, start, end)."""
    starts = (("UnboundedPreceding", UNBOUNDED), ("NPreceding", -n), ("CurrentRow", 0), ("NFollowing", n))
    ends = (("NPreceding", -n), ("CurrentRow", 0), ("NFollowing", n), ("UnboundedFollowing", UNBOUNDED))
    return {f"{kind}{s}To{e}": (kind.lower(), a, b) for kind in ("Rows", "Range") for s, a in starts for e, b in ends}


def inverted(start: int | None, end: int | None) -> bool:
    """A frame whose end lies before its start holds no row."""
    return start is not None and end is not None and start > end


def spec(w: WindowSpec, kind: str, start: int | None, end: int | None) -> WindowSpec:
    a = Window.unboundedPreceding if start is None else start
    b = Window.unboundedFollowing if end is None else end
    return w.rowsBetween(a, b) if kind == "rows" else w.rangeBetween(a, b)


def over(agg: Column, w: WindowSpec, kind: str, start: int | None, end: int | None, empty=None) -> Column:
    """An aggregate over a frame; ``empty`` (NULL, or 0 for counts) where the frame is inverted."""
    return F.lit(empty) if inverted(start, end) else agg.over(spec(w, kind, start, end))


def count_distinct_over(x: Column, w: WindowSpec) -> Column:
    """COUNT(DISTINCT x) OVER: Spark has none."""
    return F.size(F.collect_set(x).over(w))


def percent_rank(w: WindowSpec) -> Column:
    return F.percent_rank().over(w)
