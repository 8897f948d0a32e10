"""Exact n-gram Jaccard self-join.

1. One pass over the texts makes each document's set of distinct word n-grams as
   sorted 64-bit hashes, and a 128-bit digest of the set; equal sets are one
   class from then on.
2. Tiles.  Sizes fall into bands.  Sets as similar as asked differ in at most
   ``k`` elements, ``k`` known from the band, so with ``k + 1`` or more parts of
   the hash space at least one part is equal.  A class's tile keys are
   (band, part, digest of that part), for its own band and, near the lower
   edge, for the band below.  A part that is empty on both sides is no help; a
   set that fills at most ``k`` parts emits its empty ones too, and then a pair
   with no equal filled part meets there.  This loses no pair.
3. A pair that may link has ``n - k`` of the ``n`` parts in common, so a class
   that shares fewer filled parts than that with all others together is out;
   one common passage or line doesn't carry a class over this bound.  Of the
   rest, classes that share keys form candidate groups (connected components).
   A group is cut into blocks by size, so that members with the same smallest
   key lie together; a tile is a pair of blocks whose size ranges can match and
   that have a key in common.  A tile first compares hashed bitmaps, whose bit
   counts bound the overlap from above; only for members that may link in it do
   the sorted arrays travel, which are intersected exactly.  It returns each
   member's number of links and a spanning forest, never all pairs.
4. Connected components over the forests give the result.

Hashes are 64 bits wide: two different n-grams fall together with probability
2**-64, which is the only inexactness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import connected_components, cut, parts, small_batches, tidy, tidy_group

#: Bounds of a tile's block.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 21
#: Keys held before they are written out, and sizes' ratio between bands.
FLUSH_KEYS, BAND = 1 << 19, 1.5


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; fewer words than n make one n-gram; none make none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = _mix(out ^ h[i : len(h) - size + 1 + i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
    return np.unique(_mix(out + np.uint64(size)))


def set_digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def with_digests(docs: DataFrame, n: int = 5) -> DataFrame:
    """``docs`` with ``set_digest``, the digest of each text's set, null if that is empty.  Narrow."""
    import pyarrow as pa
    from pyspark.sql import types as T

    at, names = docs.columns.index("text"), [*docs.columns, "set_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [set_digest(shingles(x.as_py(), n, memo)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names)

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema, T.StructField("set_digest", T.BinaryType())]))


def most_apart(a: int, b: int, num: int, den: int) -> int:
    """Largest symmetric difference of sets of ``a`` and ``b`` elements with Jaccard similarity ``num / den`` or more."""
    return (den - num) * (a + b) // (den + num)


def bands(num: int, den: int) -> list[tuple[int, int, int]]:
    """(first size, number of parts, most parts that can differ) of each band of sizes up to 2**40."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo + 1, int(lo * BAND))
        k = most_apart(hi - 1, (hi - 1) * den // num, num, den)
        out.append((lo, k + 1 + k // 4, k))
        lo = hi
    return out


def keys_by_band(s: np.ndarray, table: list, starts: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, int]]:
    """For the set's own band and those of smaller partners: keys, and how many of them a linked partner has at least."""
    if not len(s):
        return []
    own = int(np.searchsorted(starts, len(s), "right")) - 1
    out = []
    # as the larger of a pair it also meets a smaller partner's band
    for b in range(own, -1, -1):
        lo, n, k = table[b]
        if b < own and (table[b + 1][0] - 1) * den < num * len(s):
            break
        part = (s >> np.uint64(11)) % np.uint64(n)
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(_mix(s[order] ^ np.uint64(0x5851F42D4C957F2D)), first)
        largest = len(s) * den // num if b == own else table[b + 1][0] - 1
        least = max(1, len(filled) - min(k, most_apart(len(s), largest, num, den)))
        if len(filled) <= k:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), filled)
            filled, sums = np.concatenate([filled, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        out.append((_mix(sums + _mix(filled + np.uint64(b << 40))), least))
    return out


def tile_keys(s: np.ndarray, table: list, starts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of one set: any two sets as similar as asked share one."""
    return np.concatenate([np.empty(0, np.uint64), *[k for k, _ in keys_by_band(s, table, starts, num, den)]])


def bitmap(s: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Hashed bitmap of a set as bytes, of at least two bits an element up to 8,192 elements."""
    bits = bits or (1024 if len(s) <= 512 else 4096 if len(s) <= 2048 else 16384)
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(20)) % np.uint64(bits)] = 1
    return np.packbits(out)


def fold(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words: wider ones are folded, which keeps the bound."""
    width = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), 0) for m in maps]).view(np.uint64)


def _candidates(i, others, sizes, maps, num, den):
    """Those of ``others`` whose sizes and bitmaps allow a link with ``i``."""
    lo, hi = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
    others = others[lo * den >= hi * num]
    if not len(others):
        return others
    missing = np.bitwise_count(maps[i] & ~maps[others]).sum(1, dtype=np.int64)
    surplus = np.bitwise_count(~maps[i] & maps[others]).sum(1, dtype=np.int64)
    bound = np.minimum(sizes[i] - missing, sizes[others] - surplus)
    return others[bound * (den + num) >= num * (sizes[i] + sizes[others])]


#: Low bits of a packed key: the slot (how many bands below the set's own, 3 at most), and whether its stretch has it twice.
SLOT, TWICE = 3, 4


def _sets(docs: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """doc_id, n_shingles, digest, and for the first holder of each set within a stretch of rows its packed keys.

    A packed key is (bucket of the hash space, 32 bits of hash, low bits); two
    that fall together only make a needless candidate.  A key that several sets
    of the stretch have is known to be shared: each has it in ``shared`` and the
    first alone passes it on, so a very common key leaves a row a stretch.
    ``least``: by slot, how many keys a linked partner has in common.
    """
    import pyarrow as pa

    table = bands(num, den)
    starts = np.array([x[0] for x in table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        rows, keys, owners, slots, held = [], [], [], [], 0
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            nonlocal held
            packed, shared = [None] * len(rows), [None] * len(rows)
            if keys:
                k, o, low = np.concatenate(keys), np.concatenate(owners), np.concatenate(slots)
                _, first, inv, times = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
                twice = times[inv] > 1
                main = np.zeros(len(k), bool)
                main[first] = True
                kid = (_mix(k) % np.uint64(buckets)) << np.uint64(32) | k & np.uint64(0xFFFFFFFF)
                full = kid << np.uint64(3) | np.where(twice, np.uint64(TWICE), np.uint64(0)) | low
                pos = np.searchsorted(o, np.arange(len(rows) + 1))
                for i in np.unique(o).tolist():
                    at = slice(pos[i], pos[i + 1])
                    packed[i] = full[at][main[at]].tobytes()
                    if twice[at].any():
                        shared[i] = full[at][twice[at]].tobytes()
            cols = [*zip(*rows, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
            out = pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], pa.array(packed, pa.binary()), pa.array(shared, pa.binary())],
                ["doc_id", "n_shingles", "digest", "mark", "least", "bitmap", "keys", "shared"],
            )
            rows.clear(), keys.clear(), owners.clear(), slots.clear(), seen.clear()
            held = 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py(), n, memo)
                digest = set_digest(s)
                if digest is None or doc is None or digest in seen:
                    rows.append((doc, len(s), digest, None, None, None))
                else:
                    seen.add(digest)
                    by_band = keys_by_band(s, table, starts, num, den)
                    least = [0] * (SLOT + 1)
                    for b, (k, m) in enumerate(by_band):
                        least[min(b, SLOT)] = min(least[SLOT] or m, m) if b > SLOT else m
                        keys.append(k)
                        owners.append(np.full(len(k), len(rows), np.int64))
                        slots.append(np.full(len(k), min(b, SLOT), np.uint64))
                        held += len(k)
                    rows.append((doc, len(s), digest, int.from_bytes(digest[:8], "little", signed=True), least, bitmap(s).tobytes()))
                if held > FLUSH_KEYS or len(rows) >= 1 << 16:
                    yield flush()
        if rows:
            yield flush()

    schema = "doc_id long, n_shingles long, digest binary, mark long, least array<int>, bitmap binary, keys binary, shared binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def shared_keys(sets: DataFrame) -> DataFrame:
    """(mark, key): the packed keys of each set that another set has, too.  ``mark`` is 64 bits of a set's digest.

    Keys travel packed, a row a task and bucket of the hash space.
    """
    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, keys = 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal held
            k = np.concatenate(keys)
            m = np.repeat(np.array(marks, np.int64), [len(x) for x in keys])
            where = k >> np.uint64(35)
            order = np.argsort(where, kind="stable")
            w, first = np.unique(where[order], return_index=True)
            ends = [*first[1:].tolist(), len(k)]
            low, k, m = (k[order] & np.uint64(7)).astype(np.uint8), (k[order] >> np.uint64(3)).astype(np.uint32), m[order]
            at = [*zip(first.tolist(), ends, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), *[pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (k, low, m)]], ["bucket", "keys", "low", "marks"])
            marks.clear(), keys.clear()
            held = 0
            return out

        for batch in batches:
            for mark, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = np.frombuffer(packed.as_py(), np.uint64)
                if len(k):
                    marks.append(mark)
                    keys.append(k)
                    held += len(k)
                if held > FLUSH_KEYS:
                    yield flush()
        if held:
            yield flush()

    def match(key, table):
        k, low, m = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("keys", np.uint32), ("low", np.uint8), ("marks", np.int64)))
        order = np.lexsort((low, m, k))
        k, low, m = k[order], low[order], m[order]
        key_first = np.concatenate([[True], k[1:] != k[:-1]])
        pair_first = key_first | np.concatenate([[True], m[1:] != m[:-1]])
        group = np.cumsum(key_first) - 1
        several = np.bincount(group, pair_first)[group] > 1
        keep = pair_first & several & (low < TWICE)
        x = (np.uint64(key[0].as_py()) << np.uint64(32) | k[keep].astype(np.uint64)) << np.uint64(2) | low[keep].astype(np.uint64)
        return pa.table([pa.array(m[keep]), pa.array(x.astype(np.int64))], ["mark", "key"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            if found:
                x = np.concatenate(found)
                x = x >> np.uint64(3) << np.uint64(2) | x & np.uint64(3)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(f) for f in found])), pa.array(x.astype(np.int64))], ["mark", "key"])

    packed = sets.where("keys is not null").select("mark", "keys").mapInArrow(tidy(pack), "bucket long, keys binary, low binary, marks binary")
    across = packed.groupBy("bucket").applyInArrow(tidy_group(match), "mark long, key long")
    return sets.where("shared is not null").select("mark", "shared").mapInArrow(own, "mark long, key long").union(across)


def candidate_keys(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(mark, keys) without slots, for those sets that share so many keys of a band that they may link there."""
    per = shared.withColumn("slot", F.col("key").bitwiseAND(SLOT).cast("int")).repartition("mark").groupBy("mark", "slot").agg(F.collect_set("key").alias("keys"))
    least = classes.select(F.col("mark").alias("c_mark"), F.posexplode("least").alias("c_slot", "c_least"))
    per = per.join(least, (F.col("mark") == F.col("c_mark")) & (F.col("slot") == F.col("c_slot"))).where(F.size("keys") >= F.col("c_least"))
    per = per.groupBy("mark").agg(F.flatten(F.collect_set("keys")).alias("keys"))
    return per.select("mark", F.array_distinct(F.transform("keys", lambda x: F.shiftright(x, 2))).alias("keys"))


def key_edges(keys: DataFrame, spread: int) -> DataFrame:
    """Edges (a, b) that connect the sets of each key: to the smallest of a salted share of them, and from there to the smallest of all."""
    salt = F.pmod(F.xxhash64("mark"), F.lit(spread))
    near = keys.select("mark", F.explode("keys").alias("key")).withColumn("salt", salt)
    near = near.withColumn("head", F.min("mark").over(Window.partitionBy("key", "salt")))
    heads = near.groupBy("key", "salt").agg(F.min("mark").alias("head"))
    heads = heads.withColumn("top", F.min("head").over(Window.partitionBy("key")))
    edges = near.select(F.col("mark").alias("a"), F.col("head").alias("b")).union(heads.select(F.col("head").alias("a"), F.col("top").alias("b")))
    return edges.where("a <> b").distinct()


def block_tiles(placed: DataFrame) -> DataFrame:
    """(grp, band, i, above, j): pairs of blocks of a group that have a key in common, in one band or in adjacent ones.

    ``placed``: grp, band, blocks, block, keys.  A block's keys are put together
    once and dealt by key, as many shares as the band has blocks, so rows are
    blocks times shares, whatever the number of members.
    """
    import pyarrow as pa

    def gather(key, table):
        grp, band, block = (k.as_py() for k in key)
        k = np.unique(np.concatenate([np.array(x.values, np.int64) for x in table.column("keys")]))
        share = _mix(k.view(np.uint64)) % np.uint64(max(1, table.column("shares")[0].as_py()))
        order = np.argsort(share, kind="stable")
        w, first = np.unique(share[order], return_index=True)
        k, ends = k[order], [*first[1:].tolist(), len(k)]
        n = len(w)
        return pa.table([pa.array([grp] * n, pa.int64()), pa.array(w.astype(np.int64)), pa.array([band] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array([k[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], ["grp", "share", "band", "block", "keys"])

    def meet(key, table):
        band, block = (np.array(table.column(c)) for c in ("band", "block"))
        keys = [np.frombuffer(x.as_py(), np.int64) for x in table.column("keys")]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        common = np.zeros((len(keys), len(keys)), bool)
        step = max(1, (1 << 22) // len(keys))
        for lo in range(0, int(at[-1]) + 1, step):
            a, b = np.searchsorted(at, [lo, lo + step])
            has = np.zeros((step, len(keys)), np.float32)
            has[at[a:b] - lo, who[a:b]] = 1
            common |= (has.T @ has) > 0
        x, y = np.nonzero(common & ((band[:, None] == band) & (block[:, None] <= block) | (band[:, None] + 1 == band)))
        return pa.table([pa.array([key[0].as_py()] * len(x), pa.int64()), pa.array(band[x]), pa.array(block[x]), pa.array((band[y] - band[x]).astype(np.int32)), pa.array(block[y])], ["grp", "band", "i", "above", "j"])

    shares = placed.groupBy("grp").agg(F.max("blocks").alias("shares")).withColumnRenamed("grp", "s_grp")
    dealt = placed.join(shares, F.col("grp") == F.col("s_grp")).select("grp", "band", "block", "keys", "shares")
    dealt = dealt.groupBy("grp", "band", "block").applyInArrow(tidy_group(gather), "grp long, share long, band long, block int, keys binary")
    return dealt.groupBy("grp", "share").applyInArrow(tidy_group(meet), "grp long, band long, i int, above int, j int").distinct()


def _links_in_tile(sizes, maps, arrays, weight, left, right, same, num, den, count=True):
    """Links between two blocks (or within one): counts by member and a spanning forest of local edges.

    Without ``count`` pairs that the forest connects already aren't intersected.
    """
    counts = np.zeros(len(sizes), np.int64)
    root = np.arange(len(sizes))
    forest = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, i in enumerate(left):
        others = right[p + 1 :] if same else right
        if not count:
            mine = find(i)
            others = others[[find(j) != mine for j in others.tolist()]] if len(others) else others
        if len(others):
            others = _candidates(i, others, sizes, maps, num, den)
        if not len(others):
            continue
        a = arrays[i]
        joined = np.concatenate([arrays[j] for j in others])
        at = np.searchsorted(a, joined)
        at[at == len(a)] = 0
        hit = a[at] == joined
        ends = np.cumsum(sizes[others])
        inter = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], ends[:-1]]))
        linked = others[inter * (den + num) >= num * (sizes[i] + sizes[others])]
        counts[i] += weight[linked].sum()
        counts[linked] += weight[i]
        for j in linked.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((i, j))
    return counts, forest


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, by_text: bool = False, count: bool = True) -> DataFrame:
    """Link documents whose sets of word n-grams have Jaccard similarity ``percent / 100`` or more.

    ``docs``: doc_id, text; other columns are not read.  Returns ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest doc_id reachable by links, itself
    included) and ``n_links`` (documents linked directly).

    Words are runs of anything but ASCII white space, A-Z in lower case.  Null
    and empty texts, and texts of white space, have no n-grams and link with
    nothing; fewer words than ``n`` make one n-gram.  Rows with a null doc_id
    come back with a null component and no links.  Rows that repeat a doc_id with
    the same text count as copies; with different texts each is compared, and
    their components are that id's.  An empty table gives no row.

    ``by_text``: texts that share only an id don't join components; ``digest`` of
    the set and a number ``component`` are added (null for rows without), as
    several components may then have the same smallest id.

    ``count``: without it ``n_links`` is left out, and pairs that are connected
    already aren't intersected.

    Shuffles: tile keys (packed), classes by digest (partially aggregated), bitmaps
    once for each tile, texts, and arrays for each tile in which they may link.  A group of documents has at most 16 blocks in a band of sizes until a
    block is full, so a large group spreads over hundreds of tasks.
    """
    import pyarrow as pa

    num, den = percent, 100
    small_batches(docs.sparkSession)
    sets = cut(_sets(docs, n, num, den, parts(docs.sparkSession, 4)))
    classes = sets.where("digest is not null and doc_id is not null").groupBy("digest")
    classes = cut(classes.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"), *[F.first(c, True).alias(c) for c in ("mark", "least", "bitmap")]))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())
    common = cut(candidate_keys(shared_keys(sets), classes))
    groups = connected_components(key_edges(common, parts(docs.sparkSession)))

    members = classes.join(groups, F.col("mark") == F.col("node")).select("cls", "mark", "digest", "rep", "copies", "size", "bitmap", F.col("component").alias("grp"))
    scale = np.log(den / num)
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(scale)) + 1e-9).cast("long")
    members = cut(members.withColumn("band", band))
    counts = members.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    totals = members.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("size") * 8).alias("total_bytes")).withColumnRenamed("grp", "t_grp")
    counts = counts.join(totals, F.col("grp") == F.col("t_grp")).where("total > 1")
    small = (F.col("total") <= BLOCK_ROWS) & (F.col("total_bytes") <= BLOCK_BYTES)
    blocks = F.greatest(F.ceil(F.col("bytes") / (32 * BLOCK_BYTES)), F.ceil(F.col("n") / (16 * BLOCK_ROWS)), F.least(F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK_ROWS)), F.lit(16)))
    plan = counts.select(F.col("grp").alias("p_grp"), F.col("band").alias("p_band"), small.alias("small"), blocks.cast("int").alias("blocks"), F.col("n").alias("in_band"))
    m = members.join(plan, (F.col("grp") == F.col("p_grp")) & (F.col("band") == F.col("p_band"))).drop("p_grp", "p_band")
    own = ["cls", "digest", "rep", "copies"]
    keys = ["grp", "band", "i", "above", "j"]
    alone = m.where("small").select(*own, "size", "bitmap", "grp", F.lit(0).cast("long").alias("band"), *[F.lit(0).alias(c) for c in ("i", "above", "j", "side")])

    # large groups: members with the same smallest key lie together unless they are more than a block
    large = m.where("not small")
    held = large.join(common.select(F.col("mark").alias("h_mark"), "keys"), F.col("mark") == F.col("h_mark")).select("cls", "grp", "band", "blocks", "in_band", "keys", F.array_min("keys").alias("label"))
    crowd = held.groupBy("grp", "band", "label").agg(F.count(F.lit(1)).alias("crowd")).select(F.col("grp").alias("w_grp"), F.col("band").alias("w_band"), F.col("label").alias("w_label"), "crowd")
    placed = held.join(crowd, (F.col("grp") == F.col("w_grp")) & (F.col("band") == F.col("w_band")) & (F.col("label") == F.col("w_label")))
    place = F.when(F.col("crowd") * F.col("blocks") > F.col("in_band"), F.xxhash64("cls")).otherwise(F.xxhash64("label"))
    placed = cut(placed.select("cls", "grp", "band", "blocks", "keys", F.pmod(place, F.col("blocks")).cast("int").alias("block")))
    tiles = cut(block_tiles(placed))
    placed = placed.select(F.col("cls").alias("b_cls"), "block")
    first = tiles.select(F.col("grp").alias("s_grp"), F.col("band").alias("s_band"), F.col("i").alias("s_block"), *keys[1:], F.lit(0).alias("side"))
    second = tiles.where("above = 1 or i <> j").select(F.col("grp").alias("s_grp"), (F.col("band") + F.col("above")).alias("s_band"), F.col("j").alias("s_block"), *keys[1:], F.lit(1).alias("side"))
    sides = first.union(second).groupBy("s_grp", "s_band", "s_block").agg(F.collect_list(F.struct("band", "i", "above", "j", "side")).alias("tiles"))
    large = large.withColumnRenamed("band", "m_band").join(placed, F.col("cls") == F.col("b_cls"))
    large = large.join(sides, (F.col("grp") == F.col("s_grp")) & (F.col("m_band") == F.col("s_band")) & (F.col("block") == F.col("s_block")))
    m = alone.union(large.select(*own, "size", "bitmap", "grp", F.explode("tiles").alias("t")).select(*own, "size", "bitmap", "grp", "t.*"))

    def screen(key, table):
        """Members of a tile that bitmaps allow a link in it; the others' arrays needn't travel."""
        sizes, side = (np.array(table.column(c)) for c in ("size", "side"))
        maps = fold([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bitmap")])
        within, at = key[3].as_py() == 0 and key[2].as_py() == key[4].as_py(), np.arange(len(sizes))
        left, right = (at, at) if within else (at[side == 0], at[side == 1])
        hit = np.zeros(len(sizes), bool)
        for p, i in enumerate(left):
            others = right[p + 1 :] if within else right
            if len(others):
                others = _candidates(i, others, sizes, maps, num, den)
                hit[others] = True
                hit[i] |= len(others) > 0
        n_hit = int(hit.sum())
        cols = [*[table.column(c).filter(pa.array(hit)) for c in own], *[pa.array([k.as_py()] * n_hit, pa.int64() if x < 2 else pa.int32()) for x, k in enumerate(key)], pa.array(side[hit], pa.int32())]
        return pa.table(cols, [*own, *keys, "side"])

    m = m.groupBy(*keys).applyInArrow(tidy_group(screen), "cls long, digest binary, rep long, copies long, grp long, band long, i int, above int, j int, side int")
    m = m.groupBy(*own, "grp").agg(F.collect_list(F.struct("band", "i", "above", "j", "side")).alias("tiles"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    m = texts.join(m.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("cls", "text", "copies", "grp", "tiles", "digest")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            cls, arrays, copies, grp, tiles_ = [], [], [], [], []
            for c, text, k, g, t, digest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                x = shingles(text.as_py(), n, memo)
                if set_digest(x) == digest:  # another text of the same id is of another class
                    cls.append(c), arrays.append(x.tobytes()), copies.append(k), grp.append(g), tiles_.append(t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(arrays, pa.binary()), pa.array(copies, pa.int64()), pa.array(grp, pa.int64()), pa.array(tiles_, batch.column(4).type)], ["cls", "array", "copies", "grp", "tiles"])

    kind = "array<struct<band:bigint,i:int,above:int,j:int,side:int>>"
    m = m.mapInArrow(tidy(prepare), f"cls long, array binary, copies long, grp long, tiles {kind}")
    m = m.select("cls", "array", "copies", "grp", F.explode("tiles").alias("t"))
    m = m.select("cls", "array", "copies", "grp", F.col("t.band").alias("band"), F.col("t.i").alias("i"), F.col("t.above").alias("above"), F.col("t.j").alias("j"), F.col("t.side").alias("side"))

    def compare(key, table):
        ids, weight, side = (table.column(c).to_pylist() for c in ("cls", "copies", "side"))
        arrays = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("array")]
        u, keep = np.unique(np.array(ids), return_index=True)  # rows of one id and set are one member
        ids, arrays, weight, side = u, [arrays[x] for x in keep], np.array(weight)[keep], np.array(side)[keep]
        sizes = np.array([len(x) for x in arrays])
        maps = fold([bitmap(x) for x in arrays])
        at = np.arange(len(ids))
        within = key[3].as_py() == 0 and key[2].as_py() == key[4].as_py()
        left, right = (at, at) if within else (at[side == 0], at[side == 1])
        counts, forest = _links_in_tile(sizes, maps, arrays, weight, left, right, within, num, den, count)
        got = np.flatnonzero(counts) if count else np.empty(0, np.int64)
        a, b = [ids[x] for x, _ in forest], [ids[y] for _, y in forest]
        return pa.table(
            [pa.array([*ids[got].tolist(), *map(int, a)], pa.int64()), pa.array([*counts[got].tolist(), *[0] * len(a)], pa.int64()), pa.array([*[None] * len(got), *map(int, b)], pa.int64())], ["cls", "links", "partner"]
        )

    found = cut(m.groupBy("grp", "band", "i", "above", "j").applyInArrow(tidy_group(compare), "cls long, links long, partner long"))
    linked = found.groupBy("cls").agg(F.sum("links").alias("links")).withColumnRenamed("cls", "l_cls")
    edges = found.where("partner is not null").select(F.col("cls").alias("a"), F.col("partner").alias("b"))
    of_row = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    if not by_text:
        mark = F.xxhash64("digest")
        several = cut(of_row.where("digest is not null").groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("s_doc_id")))
        if not several.isEmpty():  # classes that share an id
            held = of_row.where("digest is not null").join(several, F.col("doc_id") == F.col("s_doc_id")).join(classes.select(F.col("digest").alias("c_digest"), "cls"), F.col("digest") == F.col("c_digest"))
            held = cut(held.select("doc_id", "cls").distinct())
            least = held.groupBy("doc_id").agg(F.min("cls").alias("b")).withColumnRenamed("doc_id", "m_doc_id")
            edges = edges.union(held.join(least, F.col("doc_id") == F.col("m_doc_id")).select(F.col("cls").alias("a"), "b"))
    comps = connected_components(edges)
    named = comps.join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).groupBy("component").agg(F.min("rep").alias("smallest")).withColumnRenamed("component", "n_component")
    comps = comps.join(named, F.col("component") == F.col("n_component")).select("node", "component", "smallest")
    of_class = classes.join(linked, F.col("cls") == F.col("l_cls"), "left").join(comps, F.col("cls") == F.col("node"), "left")
    of_class = of_class.select(
        F.col("digest").alias("c_digest"), F.coalesce("smallest", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")
    )
    out = of_row.join(of_class, F.col("digest") == F.col("c_digest"), "left")
    more = [F.coalesce("n_links", F.lit(0)).alias("n_links")] * count + [F.col(c) for c in ("digest", "component") if by_text]
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)
