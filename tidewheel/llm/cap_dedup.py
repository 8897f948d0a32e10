"""Embedding near-duplicates by spherical-cap filters.

Filter directions are the words of a structured random product code: a seeded
rotation, then blocks of coordinates with their own random unit vectors; a
direction is one vector from each block.  A vector is list-decoded to all
directions whose inner product with it exceeds a threshold (a spherical cap):
blocks are combined one by one, and partial sums that can't reach it any more
are dropped.  Vectors join on shared directions; there sketches of random
planes' sides rule most pairs out before vectors travel, and the rest are
verified by their cosine in double precision.

The threshold is set so that a random vector is in ``lists`` caps on average; a
vector far from all directions lowers its own until it is in that many.  A pair
of cosine 0.9 meets in about half of the caps that either is in.
The number of directions grows with the table, so caps keep their size, and the
caps a vector is in grow slowly with it, so recall does.  The code has the same
number of blocks at every size: with more, smaller blocks a vector's caps differ
in one block only and aren't independent filters.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import connected_components, cut, parts, tidy, tidy_group

BLOCK = 256
#: Directions of small tables, and inner products with words held at once.
LEAST, CELLS = 1 << 18, 1 << 22


class Code:
    """Product code over ``dim`` coordinates; the same everywhere for the same arguments."""

    def __init__(self, dim: int, words: int, blocks: int, lists: float, seed: int):
        rng = np.random.default_rng([seed, dim, words, blocks])
        self.dim, self.words = dim, words
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
        self.spans = [*zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.codes = []
        for a, b in self.spans:
            c = rng.standard_normal((words, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        x = rng.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sums = np.concatenate([self.best_sums(self.scores(x[at]), int(lists * 4)) for at in self.chunks(len(x))])
        self.least, self.threshold = int(lists), float(np.sort(sums.ravel())[-int(min(400 * lists, sums.size))])

    @staticmethod
    def best_sums(scores: list[np.ndarray], k: int) -> np.ndarray:
        """The ``k`` largest inner products with directions (fewer if there are fewer), for each row."""
        sums = np.zeros((len(scores[0]), 1))
        for s in scores:
            s = -np.partition(-s, min(k, s.shape[1]) - 1, 1)[:, :k]
            sums = (sums[:, :, None] + s[:, None, :]).reshape(len(s), -1)
            if sums.shape[1] > k:
                sums = -np.partition(-sums, k - 1, 1)[:, :k]
        return sums

    def chunks(self, n: int) -> list[slice]:
        """Stretches of ``n`` rows whose scores are at most ``CELLS`` a block."""
        step = max(1, CELLS // self.words)
        return [slice(i, i + step) for i in range(0, n, step)]

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        y = unit @ self.turn
        return [y[:, a:b] @ c.T for (a, b), c in zip(self.spans, self.codes, strict=True)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted ids of the directions above the threshold, for each row; a row with few lowers its own to get ``least``."""
        return [ids for at in self.chunks(len(unit)) for ids in self._decode(unit[at])]

    def _decode(self, unit: np.ndarray) -> list[np.ndarray]:
        scores = self.scores(unit)
        threshold = np.minimum(self.threshold, self.best_sums(scores, self.least).min(1))
        best = np.stack([s.max(1) for s in scores])
        rest = np.concatenate([np.cumsum(best[::-1], 0)[::-1][1:], np.zeros((1, len(unit)))])
        out = []
        for i in range(len(unit)):
            sums, ids, before = np.zeros(1), np.zeros(1, np.int64), 0.0
            for b, s in enumerate(scores):
                need = threshold[i] - rest[b, i] - 1e-12
                near = np.flatnonzero(s[i] >= need - sums.max(initial=-np.inf)) if len(sums) else np.empty(0, int)
                total = np.add.outer(sums, s[i][near])
                x, y = np.nonzero(total >= need)
                sums, ids = total[x, y], ids[x] * self.words + near[y]
            out.append(np.sort(ids))
        return out


_CODES: dict[tuple, Code] = {}


def _code(*key) -> Code:
    if key not in _CODES:
        if len(_CODES) >= 8:
            _CODES.clear()
        _CODES[key] = Code(*key)
    return _CODES[key]


def plan(directions: int, lists: float, blocks: int) -> tuple[int, float]:
    """Words a block, and caps a vector.

    A cap of a pair at cosine 0.9 is shared with probability directions ** -0.053
    if directions are independent; the exponent is larger here, as measured.
    """
    return int(np.ceil(directions ** (1 / blocks))), lists * max(1.0, directions / LEAST) ** (1 / 12)


#: Bits of a vector's sketch.
BITS = 256


@functools.cache
def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, BITS]).standard_normal((dim, BITS))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """Sides of ``BITS`` random planes, as four 64-bit words a vector."""
    return np.packbits(unit @ _planes(unit.shape[1], seed) > 0, axis=1).view(np.int64)


def most_bits(cosine: float) -> int:
    """Bits in which sketches of a pair at this cosine differ, and five standard deviations: one pair in 3 million is lost."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return int(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))


def _near(tile: np.ndarray, side: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Which members of many tiles have a partner in their tile whose sketch is near; ``tile`` is sorted.

    Members of a tile of one block are all partners; of two, those of the other
    side.  Pairs are made a stretch at a time.
    """
    n = len(tile)
    hit = np.zeros(n, bool)
    first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    size = np.diff(np.append(first, n))
    end = np.repeat(first + size, size)
    later = end - np.arange(n) - 1  # partners that come after
    two = np.repeat(np.logical_or.reduceat(side == 1, first), size) if n else np.empty(0, bool)
    lo = 0
    before = np.concatenate([[0], np.cumsum(later)])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + CELLS // 4, "right")) - 1)
        a = np.repeat(np.arange(lo, hi), later[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(before[lo:hi] - before[lo], later[lo:hi])
        keep = ~two[a] | (side[a] != side[b])
        a, b = a[keep], b[keep]
        apart = np.zeros(len(a), np.int64)
        for w in range(words.shape[1]):
            apart += np.bitwise_count((words[a, w] ^ words[b, w]).view(np.uint64))
        near = apart <= most
        hit[a[near]] = hit[b[near]] = True
        lo = hi
    return hit


def _tile(x: np.ndarray, lists: list[np.ndarray], cap: int, left: np.ndarray, right: np.ndarray, within: bool, least: float) -> np.ndarray:
    """Symmetric link matrix of a tile; a pair that already meets in a smaller cap is left to that one."""
    n = len(x)
    links = np.zeros((n, n), bool)
    hit = x[left] @ x[right].T >= least
    if within:
        hit &= np.tri(len(left), k=-1, dtype=bool)
    if not hit.any():
        return links
    prior = [f[f < cap] for f in lists]
    names, inv = np.unique(np.concatenate(prior), return_inverse=True)
    if len(names):
        member = np.zeros((n, len(names)), np.float32)
        member[np.repeat(np.arange(n), [len(p) for p in prior]), inv] = 1
        hit &= member[left] @ member[right].T < 0.5
    a, b = np.nonzero(hit)
    links[left[a], right[b]] = links[right[b], left[a]] = True
    return links


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a link matrix, breadth first."""
    out, new = [], links.any(1)
    while new.any():
        todo = [int(np.argmax(new))]
        new[todo[0]] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(links[i] & new)
            new[found] = False
            out += [(i, int(j)) for j in found]
            todo += found.tolist()
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, lists: float = 24.0, blocks: int = 2, seed: int = 29) -> DataFrame:
    """One row a vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``vectors``: vec_id, embedding.  Vectors that are null, empty or zero, or hold
    null or non-finite components, link with nothing and are kept; vectors of
    different lengths don't link; rows that repeat a vec_id are vectors of their
    own (their component is the smallest vec_id reached).  A null vec_id takes
    part, and a component of such rows only has the id null and keeps them.
    Other columns are not read; an empty table gives no row.

    Links are pairs found with the cosine in double precision at ``cosine`` or
    more; none below it.  Filters may miss pairs: measured recall is in the README.

    Shuffles: (row, cap) pairs to count caps; 256-bit sketches to their caps, in
    blocks of at most 256 rows, so a cap that holds a third of all vectors becomes
    many tiles; vectors only to tiles in which a sketch is near theirs.  A pair is
    counted in its smallest common cap only, and tiles return counts and spanning
    forests, never all pairs.
    """
    import pyarrow as pa

    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = v.count()
    words, caps_each = plan(max(LEAST, 4 * n), lists, blocks)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            unit, caps, words_of = [None] * size, [None] * size, np.zeros((size, BITS // 64), np.int64)
            by_dim: dict[int, list[int]] = {}
            rows = batch.column(1)
            lens = rows.value_lengths().to_pylist()
            for i, d in enumerate(lens):
                if d:
                    by_dim.setdefault(d, []).append(i)
            for d, at in by_dim.items():
                flat = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)  # nulls become nan
                x = flat.reshape(len(at), d)
                scale = np.abs(x).max(1, keepdims=True)
                ok = np.isfinite(x).all(1) & (scale[:, 0] > 0)
                x, at = x[ok] / scale[ok], np.array(at)[ok]
                if not len(at):
                    continue
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                words_of[at] = sketches(x, seed)
                for i, u, f in zip(at.tolist(), x, _code(d, words, blocks, caps_each, seed).decode(x), strict=True):
                    unit[i], caps[i] = u.tobytes(), f + (d << 44)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, pa.binary()), pa.array(caps, pa.list_(pa.int64())), *[pa.array(w) for w in words_of.T]], ["vec_id", "unit", "caps", *sketch])

    sketch = [f"s{i}" for i in range(BITS // 64)]
    v = cut(v.mapInArrow(tidy(decode), "vec_id long, unit binary, caps array<long>, " + ", ".join(f"{c} long" for c in sketch))).withColumn("row", F.monotonically_increasing_id())
    pairs = v.select("row", *sketch, F.explode("caps").alias("cap"))
    full = pairs.groupBy("cap").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("cap", "f_cap")
    pairs = pairs.join(full, F.col("cap") == F.col("f_cap")).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    pairs = pairs.withColumn("b", F.pmod(F.xxhash64("row"), F.col("nb")).cast("int"))
    pairs = pairs.select("row", *sketch, "cap", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    # many tiles are one task's group: a tile by itself is a few rows
    many = parts(vectors.sparkSession, 4)
    pairs = pairs.select(F.pmod(F.xxhash64("cap", F.least("b", "o"), F.greatest("b", "o")), F.lit(many)).cast("int").alias("group"), "cap", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("o") < F.col("b")).cast("int").alias("side"), "row", *sketch)
    most = most_bits(cosine)

    def screen(table):
        cap, i, j, side = (np.asarray(table.column(c)) for c in ("cap", "i", "j", "side"))
        order = np.lexsort((j, i, cap))
        cap, i, j, side = cap[order], i[order], j[order], side[order]
        new = np.ones(len(order), bool)
        new[1:] = (cap[1:] != cap[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        words_ = np.stack([np.asarray(table.column(c))[order] for c in sketch], 1)
        hit = _near(np.cumsum(new), side, words_, most)
        return pa.table([pa.array(x[hit]) for x in (cap, i, j, side, np.asarray(table.column("row"))[order])], ["cap", "i", "j", "side", "p_row"])

    kept = pairs.groupBy("group").applyInArrow(tidy_group(screen), "cap long, i int, j int, side int, p_row long")
    tiles = kept.join(v.select("row", "unit", "caps"), F.col("p_row") == F.col("row")).select("cap", "i", "j", "side", "row", "unit", "caps")

    def compare(key, table):
        row, side = (np.array(table.column(c)) for c in ("row", "side"))
        x = np.stack([np.frombuffer(u.as_py(), np.float64) for u in table.column("unit")])
        caps = [np.array(c, np.int64) for c in table.column("caps").to_pylist()]
        within = key[1].as_py() == key[2].as_py()
        at = np.arange(len(row))
        links = _tile(x, caps, key[0].as_py(), at if within else at[side == 0], at if within else at[side == 1], within, cosine)
        counts = links.sum(1)
        got, edges = np.flatnonzero(counts), _forest(links)
        a, b = [int(row[i]) for i, _ in edges], [int(row[j]) for _, j in edges]
        return pa.table([pa.array([*row[got].tolist(), *a], pa.int64()), pa.array([*counts[got].tolist(), *[0] * len(a)], pa.int64()), pa.array([*[None] * len(got), *b], pa.int64())], ["row", "links", "partner"])

    found = cut(tiles.groupBy("cap", "i", "j").applyInArrow(tidy_group(compare), "row long, links long, partner long"))
    links = found.groupBy("row").agg(F.sum("links").alias("links")).withColumnRenamed("row", "l_row")
    comps = connected_components(found.where("partner is not null").select(F.col("row").alias("a"), F.col("partner").alias("b")))
    ids = comps.join(v.select("row", "vec_id"), F.col("node") == F.col("row"))
    names = ids.groupBy("component").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("component", "n_component")
    named = comps.join(names, F.col("component") == F.col("n_component")).select(F.col("node").alias("c_row"), "component_id")
    out = v.select("row", "vec_id").join(links, F.col("row") == F.col("l_row"), "left").join(named, F.col("row") == F.col("c_row"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
