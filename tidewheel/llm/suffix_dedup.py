"""Removal of long repeated byte strings by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else
as well, in the same document or another.  Only suffixes that can have such a
partner are sorted:

1. Anchors.  In every window of ``LENGTH`` bytes the ``GRAM``-byte string with
   the smallest hash is its anchor, so equal windows have equal anchors at equal
   places.  Neighbouring windows mostly share theirs: there is one anchor to
   about 70 bytes.  A window whose anchor occurs once is unique.
2. The windows of a repeated anchor are one context, a string of up to
   2 ``LENGTH`` bytes.  Equal contexts are collapsed.
3. The suffixes that start the windows of an anchor's distinct contexts are
   sorted to ``LENGTH`` bytes, deep and shallow: multikey quicksort, eight bytes
   a key, to a depth of ``SHALLOW`` bytes, then a blind trie for each group that
   is still tied.  Suffixes that meet in a leaf are repeated.
4. An anchor with very many occurrences (the edge of a passage that a third of
   all documents quote has a different context in each) is split first: its
   windows are dealt by their own 128-bit digest instead, so no task gets them
   together; two different ones fall together with probability 2**-128.

Texts are dealt to buckets by a hash of the row, so that every step is a join
of bounded buckets; what travels besides texts is packed into a row for each
pair of buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, parts, small_batches, tidy, tidy_group

LENGTH, GRAM, SHALLOW = 200, 64, 24
#: Occurrences from which an anchor is split by window; bytes of text hashed at a time; anchors held before packing;
#: bytes of a document hashed at once.
HOT, CHUNK, FLUSH, MOST = 255, 1 << 17, 1 << 20, 1 << 24
#: Bytes of contexts sorted together; of contexts whose windows are digested at a time.
SORTED, DIGESTED = 1 << 20, 1 << 18
#: Where counts stop, to be a byte: all that is asked of them is whether they reach 2 or ``HOT``.
MANY = 255

#: Two hash functions: values of bytes, and odd multipliers.
_TABLES = [(np.frombuffer(hashlib.shake_128(b"byte values" + x).digest(2048), np.uint64), np.frombuffer(hashlib.shake_128(b"multipliers" + x).digest(128), np.uint64) | np.uint64(1)) for x in (b"", b" again")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _string_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all ``length``-byte strings of ``data``, by doubling; ``which`` of two functions."""
    of_byte, odd = _TABLES[which]
    out, done, h, size, level = None, 0, of_byte[data], 1, 0
    while True:
        if length & size:
            if out is None:
                out = h
            else:
                out = out[: len(data) - length + 1] * odd[8 + level] + h[done : done + len(data) - length + 1]
                out ^= out >> np.uint64(32)
            done += size
        if done == length:
            return _mix(out[: len(data) - length + 1])
        m = len(h) - size
        h = h[:m] * odd[level] + h[size:]
        h ^= h >> np.uint64(32)
        size, level = 2 * size, level + 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents that lie in ``data`` between ``offsets``: each anchor's hash, first window and number of windows.

    Windows that cross documents are left out.
    """
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none
    if len(data) > MOST:  # one very long document, in stretches that share no window
        found = [(h, at + a, n) for a in range(0, len(data) - LENGTH + 1, MOST - LENGTH + 1) for h, at, n in [anchors(data[a : a + MOST], np.array([0, min(MOST, len(data) - a)]))]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    h = _string_hashes(data, GRAM)
    w = LENGTH - GRAM + 1
    n = len(data) - LENGTH + 1
    # smallest (hash, place) of every w neighbours: prefix and suffix minima of blocks
    low = (h & np.uint64(0xFFFFFFFFFE000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(low) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[: len(low)] = low
    padded = padded.reshape(blocks, w)
    fore = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    owner = np.minimum(back[:n], fore[w - 1 : w - 1 + n]) & np.uint64(0x1FFFFFF)
    inside = np.zeros(n + 1, np.int64)
    first, last = offsets[:-1], offsets[1:] - LENGTH  # windows of a document
    ok = last >= first
    inside[first[ok]] += 1
    np.subtract.at(inside, last[ok] + 1, 1)
    at = np.flatnonzero(np.cumsum(inside[:n]))
    if not len(at):
        return none
    own = owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    return h[own[start].astype(np.int64)], at[start], np.diff(np.append(start, len(at)))


def _chunks(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts joined to stretches of about ``CHUNK`` bytes: index of the first, bytes, offsets."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size + len(rows[end]) <= CHUNK):
            size += len(rows[end])
            end += 1
        yield at, np.frombuffer(b"".join(rows[at:end]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows[at:end]])])
        at = end


class BlindTrie:
    """Patricia trie of equally long strings that looks at branching bytes only and checks once, at the leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root, self.same = strings, None, {}

    def insert(self, i: int) -> int | None:
        """Add string ``i``; an equal string that is there already, or None."""
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return None
        node, path = self.root, []
        while type(node) is tuple:
            path.append(node)
            node = node[1].get(s[node[0]])
            if node is None:
                node = next(iter(path[-1][1].values()))
        other = self.strings[node]
        differ = int.from_bytes(s) ^ int.from_bytes(other)
        if not differ:
            return node
        lcp = len(s) - (differ.bit_length() + 7) // 8
        above = None
        for x in path:
            if x[0] >= lcp:
                break
            above = x
        if above is None:
            below, self.root = self.root, (lcp, {})
            new = self.root
        else:
            below = above[1].get(s[above[0]])
            if below is None:
                above[1][s[above[0]]] = i
                return None
            new = above[1][s[above[0]]] = (lcp, {})
        if type(below) is tuple and below[0] == lcp:
            below[1][s[lcp]] = i
            if above is None:
                self.root = below
            else:
                above[1][s[above[0]]] = below
            return None
        new[1][other[lcp]] = below
        new[1][s[lcp]] = i
        return None


def repeated_suffixes(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``LENGTH`` bytes with another one of them."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    b = np.frombuffer(data + bytes(8), np.uint8)
    word = b[: len(data)].astype(np.uint64)
    for step in (1, 2, 4):
        word = (word << np.uint64(8 * step)) | np.append(word[step:], np.zeros(step, np.uint64))
    # shallow: multikey quicksort on words; groups that are alone drop out
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, 8):
        key = word[starts[order] + depth]
        by = np.lexsort((key, group))
        order, group, key = order[by], group[by], key[by]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        order, group = order[~alone], group[~alone]
        if not len(order):
            return out
    # deep: a blind trie a group
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    sizes = np.diff(np.append(0, ends))
    # a trie of two is one comparison, made for all such groups at once
    first = ends[sizes == 2] - 2
    x, y = starts[order[first]], starts[order[first + 1]]
    for depth in range(SHALLOW, LENGTH, 8):
        same = word[x + depth] == word[y + depth]
        first, x, y = first[same], x[same], y[same]
    out[order[first]] = out[order[first + 1]] = True
    for a, e in zip((ends - sizes)[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        members = order[a:e].tolist()
        strings = [data[s + SHALLOW : s + LENGTH] for s in starts[order[a:e]].tolist()]
        trie = BlindTrie(strings)
        for i, m in enumerate(members):
            equal = trie.insert(i)
            if equal is not None:
                out[m] = out[members[equal]] = True
    return out


#: A window's digest: two hashes of independent tables.
DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _window_digests(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of all windows of many contexts, and how many each has."""
    n = np.array([len(x) - LENGTH + 1 for x in contexts])
    ends = np.cumsum(n + LENGTH - 1)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.repeat(ends - np.cumsum(n) - (LENGTH - 1), n) + np.arange(n.sum())
    out = np.empty(len(at), DIGEST)
    out["a"], out["b"] = _string_hashes(data, LENGTH)[at], _string_hashes(data, LENGTH, 1)[at]
    return out, n


def _distinct(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct digests and how often each occurs."""
    order = np.lexsort((x["b"], x["a"]))
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    times = np.bincount(np.cumsum(new) - 1, None if weight is None else weight[order], int(new.sum())) if len(x) else np.empty(0, np.int64)
    return x[new], times.astype(np.int64)


def _digested(found: Iterable[tuple]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Tuples that end with a context in lists of about ``DIGESTED`` bytes of them, each with the digests of its windows and their numbers."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[-1])
        if size >= DIGESTED:
            yield held, *_window_digests([x[-1] for x in held])
            held, size = [], 0
    if held:
        yield held, *_window_digests([x[-1] for x in held])


def _distinct_windows(found: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct digests of the windows of such tuples' contexts, and how often each occurs; merged as they come."""
    done, held, size = (np.empty(0, DIGEST), np.empty(0, np.int64)), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _distinct(*(np.concatenate(x) for x in zip(done, *held, strict=True)))

    for _, w, _ in _digested(found):
        held.append(_distinct(w))
        size += len(held[-1][0])
        if size >= max(len(done[0]), DIGESTED):
            done = merged()
            held, size = [], 0
    return merged()


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which digests are in ``known``, sorted and distinct."""
    out = np.zeros(len(x), bool)
    if not len(known):
        return out
    lo, hi = np.searchsorted(known["a"], x["a"], "left"), np.searchsorted(known["a"], x["a"], "right")
    for step in range(int((hi - lo).max(initial=0))):  # one, but for equal first halves
        at = np.minimum(lo + step, len(known) - 1)
        out |= (lo + step < hi) & (known[at] == x)
    return out


def _digest(context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16).digest()


def _pack(bucket: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Rows sorted into buckets: the buckets, and each column's bytes for each."""
    if not len(bucket):
        return [], [[] for _ in columns]
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    spans = [*zip(first.tolist(), ends, strict=True)]
    return names.tolist(), [[c[order[a:e]].tobytes() for a, e in spans] for c in columns]


def _numbers(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column] or [np.empty(0, kind)])


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Cut every byte out that a repeated string of 200 bytes covers.

    ``docs``: doc_id, text; with ``keep_text`` other columns stay.  Returns
    ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs removed),
    ``kept_sha256`` and, with ``keep_text``, ``kept`` (the rest; a character
    that is cut in two becomes a replacement character).

    Strings are judged on the input; overlaps count, within a document too.
    Null texts are empty; texts of under 200 bytes stay whole; repeated rows
    repeat each other; doc_id may be null; an empty table gives no row.

    Shuffles: anchors' hashes (9 bytes an anchor), texts twice, contexts of
    repeated anchors, verdicts.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    n_rows, n_keys = parts(spark, 2), parts(spark)
    base = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("whole")] if keep_text else []), F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("data"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "data"), F.lit(n_rows)).cast("int"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, rows = 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal held
            h, r = np.concatenate(hashes), np.concatenate(rows)
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            n = np.minimum(np.diff(np.append(at, len(h))), MANY).astype(np.uint8)
            names, (a, b, c) = _pack((_mix(h[at]) % np.uint64(n_keys)).astype(np.int64), h[at], r[at].astype(np.int32), n)
            hashes.clear(), rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["key", "hashes", "rows", "counts"])

        for batch in batches:
            buckets, texts = np.array(batch.column(0)), batch.column(1).to_pylist()
            for first, data, offsets in _chunks(texts):
                h, at, _ = anchors(data, offsets)
                hashes.append(h)
                rows.append(buckets[first + np.searchsorted(offsets, at, "right") - 1])
                held += len(h)
                if held > FLUSH:
                    yield flush()
        if held:
            yield flush()

    def match(table):
        h, r, n = _numbers(table.column("hashes"), np.uint64), _numbers(table.column("rows"), np.int32), _numbers(table.column("counts"), np.uint8)
        u, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, n, len(u))
        again = total[inv] >= 2
        pairs = np.unique(np.stack([r[again].astype(np.uint64), h[again]]), axis=1) if again.any() else np.empty((2, 0), np.uint64)
        hot = (total >= HOT)[np.searchsorted(u, pairs[1])].astype(np.uint8)
        names, (a, b) = _pack(pairs[0].astype(np.int64), pairs[1], hot)
        return pa.table([pa.array(names, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["bucket", "hashes", "hot"])

    repeated = base.select("bucket", "data").mapInArrow(tidy(find), "key int, hashes binary, rows binary, counts binary").groupBy("key").applyInArrow(tidy_group(match), "bucket int, hashes binary, hot binary")
    repeated = cut(repeated)

    def contexts(texts: list[bytes], wanted: np.ndarray, hot: np.ndarray):
        """(row, first window, windows, anchor's hash, hot, context) of the wanted anchors (sorted hashes)."""
        for first, data, offsets in _chunks(texts):
            h, at, n = anchors(data, offsets)
            where = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
            got = np.flatnonzero(wanted[where] == h) if len(wanted) else []
            raw = data.tobytes()
            docs_ = first + np.searchsorted(offsets, at, "right") - 1
            for i in got:
                a, e = int(at[i]), int(at[i]) + int(n[i]) - 1 + LENGTH
                yield int(docs_[i]), a - int(offsets[docs_[i] - first]), int(n[i]), int(h[i]), bool(hot[where[i]]), raw[a:e]

    ctx_schema = "key int, split int, bucket int, hashes binary, sizes binary, counts binary, data binary"

    def collect(left, right):
        wanted, hot = _numbers(left.column("hashes"), np.uint64), _numbers(left.column("hot"), np.uint8)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        out = {}
        me = int((left if left.num_rows else right).column("bucket")[0].as_py())

        def split() -> Iterator[tuple[bytes]]:
            for _, _, _, h, is_hot, context in contexts(right.column("data").to_pylist() if right.num_rows else [], wanted, hot):
                if is_hot:
                    yield (context,)
                else:
                    out[h, context] = out.get((h, context), 0) + 1

        w, times = _distinct_windows(split())
        rows = []
        by: dict[int, list] = {}
        for (h, context), n in out.items():
            by.setdefault(h % n_keys, []).append((h, context, n))
        for k, xs in by.items():
            rows.append((k, 0, me, np.array([x[0] for x in xs], np.uint64).tobytes(), np.array([len(x[1]) for x in xs], np.int32).tobytes(), np.minimum([x[2] for x in xs], 255).astype(np.uint8).tobytes(), b"".join(x[1] for x in xs)))
        if len(w):
            names, (a, b) = _pack((_mix(w["a"]) % np.uint64(n_keys)).astype(np.int64), w, np.minimum(times, 2).astype(np.uint8))
            rows += [(k, 1, me, x, None, y, None) for k, x, y in zip(names, a, b, strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        cols = [*zip(*rows, strict=True)] or [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "split", "bucket", "hashes", "sizes", "counts", "data"])

    found = repeated.groupBy("bucket").cogroup(base.select("bucket", "data").groupBy("bucket")).applyInArrow(tidy_group(collect), ctx_schema)

    verdict_schema = "bucket int, split int, hashes binary, digests binary, masks binary"

    def judge(table):
        rows = []
        split = np.array(table.column("split"))
        buckets = table.column("bucket").to_pylist()
        cols = {c: table.column(c).to_pylist() for c in ("hashes", "sizes", "counts", "data")}
        parts_ = np.flatnonzero(split == 1).tolist()
        if parts_:
            w = [np.frombuffer(cols["hashes"][i], DIGEST) for i in parts_]
            u, total = _distinct(np.concatenate(w), np.concatenate([np.frombuffer(cols["counts"][i], np.uint8) for i in parts_]))
            again = u[total >= 2]
            for i, x in zip(parts_, w, strict=True):
                got = x[_among(x, again)]
                if len(got):
                    rows.append((buckets[i], 1, got.tobytes(), None, None))
        seen: dict[tuple[int, bytes], list] = {}
        for i in np.flatnonzero(split == 0).tolist():
            at = 0
            data = cols["data"][i]
            for h, size, n in zip(np.frombuffer(cols["hashes"][i], np.uint64).tolist(), np.frombuffer(cols["sizes"][i], np.int32).tolist(), cols["counts"][i], strict=True):
                x = seen.setdefault((h, data[at : at + size]), [0, []])
                x[0] += n
                x[1].append(buckets[i])
                at += size
        # anchors with one distinct context, or whose contexts all repeat whole, need no sorting; the others' suffixes are sorted together
        several: dict[int, int] = {}
        single: set[int] = set()
        for (h, _), (n, _) in seen.items():
            several[h] = several.get(h, 0) + 1
            if n < 2:
                single.add(h)
        todo = [x for x in seen if several[x[0]] > 1 and x[0] in single]
        masks = {x: np.full(len(x[1]) - LENGTH + 1, v[0] >= 2) for x, v in seen.items()}
        lo = 0
        todo.sort(key=lambda x: x[0])
        while lo < len(todo):
            hi, size = lo, 0
            while hi < len(todo) and (size < SORTED or todo[hi][0] == todo[hi - 1][0]):
                size += len(todo[hi][1])
                hi += 1
            text = b"".join(x[1] for x in todo[lo:hi])
            ends = np.cumsum([len(x[1]) for x in todo[lo:hi]])
            starts = np.concatenate([np.arange(e - len(x[1]), e - LENGTH + 1) for e, x in zip(ends.tolist(), todo[lo:hi], strict=True)])
            again, at = repeated_suffixes(text, starts), 0
            for x in todo[lo:hi]:
                masks[x] |= again[at : at + len(masks[x])]
                at += len(masks[x])
            lo = hi
        by: dict[int, list] = {}
        for x, (_, where) in seen.items():
            if masks[x].any():
                bits = np.packbits(masks[x]).tobytes()
                for b in set(where):
                    by.setdefault(b, []).append((x[0], _digest(x[1]), bits + bytes(32 - len(bits))))
        for b, xs in by.items():
            rows.append((b, 0, np.array([x[0] for x in xs], np.uint64).tobytes(), b"".join(x[1] for x in xs), b"".join(x[2] for x in xs)))
        cols_ = [*zip(*rows, strict=True)] or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols_, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["bucket", "split", "hashes", "digests", "masks"])

    verdicts = found.groupBy("key").applyInArrow(tidy_group(judge), verdict_schema)
    # what is hot in a bucket is needed again to find its windows
    flags = repeated.select("bucket", F.lit(2).alias("split"), "hashes", F.col("hot").alias("digests"), F.lit(None).cast("binary").alias("masks"))
    verdicts = verdicts.union(flags)

    from pyspark.sql import types as T

    fields = [*[T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], *[T.StructField(c, T.StringType()) for c in ["kept_sha256"] + ["kept"] * keep_text], *([base.schema["whole"]] if keep_text else [])]
    out_schema = T.StructType(fields)

    def cover(left, right):
        names = [f.name for f in fields]
        if not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int64()] * 4 + [pa.string()] * (2 if keep_text else 1), strict=False)}) if not keep_text else pa.table({n: pa.array([], t) for n, t in zip(names, [*[pa.int64()] * 4, pa.string(), pa.string(), right.column("whole").type], strict=True)})
        mask_of, windows, wanted, hot = {}, [np.empty(0, DIGEST)], np.empty(0, np.uint64), np.empty(0, np.uint8)
        judged = [np.empty(0, np.uint64)]
        for split, h, d, m in zip(*(left.column(c).to_pylist() for c in ("split", "hashes", "digests", "masks")), strict=True):
            if split == 1:
                windows.append(np.frombuffer(h, DIGEST))
            elif split == 0:
                judged.append(np.frombuffer(h, np.uint64))
                for i in range(len(d) // 16):
                    mask_of[d[16 * i : 16 * i + 16]] = m[32 * i : 32 * i + 32]
            else:
                wanted, hot = np.append(wanted, np.frombuffer(h, np.uint64)), np.append(hot, np.frombuffer(d, np.uint8))
        use = (hot == 1) & (sum(map(len, windows)) > 0) | np.isin(wanted, np.concatenate(judged))
        wanted, hot = wanted[use], hot[use]
        order = np.argsort(wanted)
        wanted, hot, windows = wanted[order], hot[order], _distinct(np.concatenate(windows))[0]
        texts = right.column("data").to_pylist()
        marks: dict[int, list[np.ndarray]] = {}

        def split() -> Iterator[tuple[int, int, bytes]]:
            for doc, at, n, _, is_hot, context in contexts(texts, wanted, hot):
                if is_hot:
                    yield doc, at, context
                elif (bits := mask_of.get(_digest(context))) is not None:
                    m = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                    marks.setdefault(doc, []).append(at + np.flatnonzero(m))

        for those, w, n in _digested(split()):
            m = _among(w, windows)
            for (doc, at, _), e, size in zip(those, np.cumsum(n).tolist(), n.tolist(), strict=True):
                if m[e - size : e].any():
                    marks.setdefault(doc, []).append(at + np.flatnonzero(m[e - size : e]))
        n_bytes, removed, spans, sha, kept = [], [], [], [], []
        for i, text in enumerate(texts):
            n_bytes.append(len(text))
            rest, gone, runs = text, 0, 0
            if i in marks:
                d = np.zeros(len(text) + 1, np.int64)
                p = np.concatenate(marks[i])
                np.add.at(d, p, 1)
                np.add.at(d, p + LENGTH, -1)
                cut_ = np.cumsum(d[:-1]) > 0
                gone = int(cut_.sum())
                runs = int(cut_[0]) + int((cut_[1:] & ~cut_[:-1]).sum())
                rest = np.frombuffer(text, np.uint8)[~cut_].tobytes()
            removed.append(gone), spans.append(runs), sha.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest.decode("utf-8", "replace"))
        out = [right.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
        return pa.table(out + ([pa.array(kept, pa.string()), right.column("whole")] if keep_text else []), names)

    return verdicts.groupBy("bucket").cogroup(base.groupBy("bucket")).applyInArrow(tidy_group(cover), out_schema)
