"""Byte-level BPE encoding and decoding.

The merge list is compiled into a finite-state transducer over bytes.  A prefix
has one encoding, and a sequence of tokens is an encoding exactly when every
two neighbours are (no merge crosses their boundary).  So the last token of each
prefix follows from those of shorter ones: the machine for the token set (a trie
with failure links) lists the tokens that end here, and the one that may follow
the token before it is right.  A state is the last emitted token and the bytes
not yet settled; those are settled on which the encodings up to every position
that a longer token may still start from agree, so the lookahead is at most a
token's length.  States and arcs are made when first met (lazy
determinisation), and the arc table is emptied at a bound: memory is constant.

Decoding looks token bytes up and feeds them to an incremental UTF-8 machine.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import kept_tables, small_batches, tidy

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bounds of the lazily filled tables; beyond them a table starts anew.
MAX_ARCS, MAX_WORDS, MAX_PAIRS = 1 << 18, 1 << 18, 1 << 18


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


class MergeTransducer:
    """Lazily determinised byte-to-token transducer of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for c in token:
                nxt = self.kids[node].get(c)
                if nxt is None:
                    nxt = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(None)
                node = nxt
            self.ends[node] = rank
        self.fail, self.depth, self.shorter = [0] * len(self.kids), [0] * len(self.kids), [0] * len(self.kids)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for c, x in self.kids[at].items():
                up = self.fail[at]
                while at and c not in self.kids[up] and up:
                    up = self.fail[up]
                self.fail[x] = up = self.kids[up].get(c, 0) if at else 0
                self.shorter[x] = up if self.ends[up] is not None else self.shorter[up]
                self.depth[x] = self.depth[at] + 1
                todo.append(x)
        self.pairs: dict[int, bool] = {}
        self.moves: dict[int, int] = {}
        self.ending: dict[int, tuple[tuple[int, int], ...]] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self._reset()

    def _reset(self) -> None:
        self.ids = {(-1, b""): 0}
        self.states = [(-1, b"", 0, (), ())]
        self.wanted: set[int] = set()
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _split(self, t: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge, the last one, makes token ``t``; None for a byte or an unreachable token."""
        cells = [t[i : i + 1] for i in range(len(t))]
        while len(cells) > 2:
            best = min(((self.ranks.get(cells[i] + cells[i + 1], 1 << 60), i) for i in range(len(cells) - 1)))
            if best[0] == 1 << 60:
                return None
            i = best[1]
            cells[i : i + 2] = [cells[i] + cells[i + 1]]
        return (cells[0], cells[1]) if len(cells) == 2 else None

    def _edge(self, t: int, side: int) -> list[tuple[bytes, int, int]]:
        """Pieces that lie at one end of token ``t`` while it is built: bytes, rank when made, rank when used up."""
        if (out := self.edges[side].get(t)) is None:
            out, piece, used = [], self.bytes_of[t], 1 << 60
            while True:
                born = self.ranks[piece] if len(piece) > 1 else -1
                out.append((piece, born, used))
                if len(piece) == 1:
                    break
                pair = self._split(piece)
                if pair is None:
                    out = []
                    break
                piece, used = pair[side], born
            self.edges[side][t] = out
        return out

    def _follows(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the boundary of ``a`` (-1: none) and ``b``, and ``b`` can be made at all."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        right, get = self._edge(b, 0), self.ranks.get
        ok = bool(right)
        for x, born_x, used_x in self._edge(a, 1) if ok and a >= 0 else ():
            for y, born_y, used_y in right:
                if born_x < used_y and born_y < used_x and (r := get(x + y)) is not None and r < used_x and r <= used_y:
                    ok = False
                    break
            if not ok:
                break
        self.pairs[(a + 1) << 32 | b] = ok
        return ok

    def _goto(self, at: int, c: int) -> int:
        """The longest trie path that ends with byte ``c`` after the one at node ``at``."""
        node, x = None, at
        while (node := self.kids[x].get(c)) is None and x:
            x = self.fail[x]
        if len(self.moves) >= MAX_ARCS:
            self.moves.clear()
        self.moves[at << 8 | c] = node or 0
        return node or 0

    def _ends_here(self, at: int) -> tuple[tuple[int, int], ...]:
        """Tokens (with lengths, longest first) that end where node ``at`` stands."""
        if (out := self.ending.get(at)) is None:
            x, found = at if self.ends[at] is not None else self.shorter[at], []
            while x:
                found.append((self.ends[x], self.depth[x]))
                x = self.shorter[x]
            out = self.ending[at] = tuple(found)
        return out

    def _simulate(self, last: int, at: int, starts: list[int], tokens: list[int], data: bytes) -> int:
        """Run ``data`` through the undetermined machine: append each position's last token and its start."""
        moves, ending, pairs = self.moves, self.ending, self.pairs
        n = len(tokens)
        for c in data:
            if (x := moves.get(at << 8 | c)) is None:
                x = self._goto(at, c)
            at = x
            n += 1
            for t, size in ending.get(at) or self._ends_here(at):
                a = tokens[n - size - 1] if n > size else last
                if (ok := pairs.get((a + 1) << 32 | t)) is None:
                    ok = self._follows(a, t)
                if ok:
                    starts.append(n - size)
                    tokens.append(t)
                    break
            else:
                raise ValueError(f"no token covers byte {c}")
        return at

    def _step(self, state: int, c: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one arc."""
        last, text, at, starts, tokens = self.states[state]
        starts, tokens = [*starts], [*tokens]
        at = self._simulate(last, at, starts, tokens, bytes((c,)))
        # where the encodings up to all positions that a longer token may start from agree
        n = len(tokens)
        open_at = {*range(n - self.depth[at], n + 1)}
        while len(open_at) > 1:
            p = max(open_at)
            open_at.remove(p)
            open_at.add(starts[p - 1])
        done = open_at.pop()
        out = self._path(starts, tokens, done)
        key = (out[-1] if out else last, text[done:] + bytes((c,)))
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.states)
            self.states.append((*key, at, tuple([s - done for s in starts[done:]]), tuple(tokens[done:])))
        arc = self.arcs[state << 8 | c] = to, out
        return arc

    @staticmethod
    def _path(starts: list[int], tokens: list[int], end: int) -> tuple[int, ...]:
        out = []
        while end:
            out.append(tokens[end - 1])
            end = starts[end - 1]
        return tuple(out[::-1])

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in chunks, each as soon as it is settled."""
        state = 0
        for chunk in chunks:
            for c in chunk:
                if (arc := self.arcs.get(state << 8 | c)) is None:
                    if len(self.arcs) >= MAX_ARCS:
                        keep = self.states[state]
                        self._reset()
                        self.states.append(keep)
                        state = self.ids.setdefault(keep[:2], 1)
                    arc = self._step(state, c)
                state, out = arc
                yield from out
        _, text, _, starts, tokens = self.states[state]
        yield from self._path(starts, tokens, len(text))

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern; a match that is a token is that token.

        An arc is determinised when it is wanted a second time; a short piece's
        rest after an arc that was never wanted is run undetermined.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 64:
            return list(self.stream((piece,)))
        if len(self.arcs) >= MAX_ARCS:
            self._reset()
        state, arcs, found = 0, self.arcs, []
        for i, c in enumerate(piece):
            key = state << 8 | c
            if (arc := arcs.get(key)) is None:
                if key not in self.wanted:
                    if len(self.wanted) >= MAX_ARCS:
                        self.wanted.clear()
                    self.wanted.add(key)
                    last, _, at, starts, tokens = self.states[state]
                    starts, tokens = [*starts], [*tokens]
                    self._simulate(last, at, starts, tokens, piece[i:])
                    found.extend(self._path(starts, tokens, len(tokens)))
                    return found
                arc = self._step(state, c)
            state, out = arc
            if out:
                found.extend(out)
        _, text, _, starts, tokens = self.states[state]
        found.extend(self._path(starts, tokens, len(text)))
        return found


class _Words(dict):
    """Packed ids of a match, computed by the transducer when first met; two generations of bounded size."""

    def __init__(self, fst: MergeTransducer):
        self.fst, self.older = fst, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = self.fst.piece(word.encode("utf-8", "replace"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


#: Texts of these characters alone are split by the standard library's faster engine, with the classes spelt out.
_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_CLASSES = ((r"\p{L}", _LETTER), (r"\p{N}", "0-9"), (r"\s", r"\t-\r\x20"))


def _plain_pattern(pattern: str) -> str | None:
    """The splitting pattern for plain texts, or None if it uses more than these classes."""
    if re.search(r"\\(?!p\{[LN]\}|[sS])|\[[^\]]*\\S", pattern):
        return None
    out, inside, i = "", False, 0
    while i < len(pattern):
        for name, chars in _CLASSES:
            if pattern.startswith(name, i):
                out += chars if inside else f"[{chars}]"
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i):
                out += r"[^\t-\r\x20]"
                i += 2
                continue
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out += pattern[i]
            i += 1
    return out


class Utf8Machine:
    """Incremental UTF-8 decoder: whole characters go out, an unfinished one waits for its bytes."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of a last character that has begun but isn't complete (0 to 3)."""
        for back in range(1, min(3, len(data)) + 1):
            c = data[-back]
            if c < 0x80:
                return 0
            if c >= 0xC0:
                need = 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self._unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Splitting pattern and transducer together; encode to packed ids, decode from them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.fst = MergeTransducer(ranks)
        self.find_any = regex.compile(pattern).findall
        plain = _plain_pattern(pattern)
        self.find_plain = re.compile(plain).findall if plain else None
        self.words = _Words(self.fst)
        self.table = self.fst.bytes_of

    def find(self, text: str) -> list[str]:
        """The matches of the splitting pattern."""
        return self.find_plain(text) if self.find_plain and not _PLAIN(text) else self.find_any(text)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, one after another."""
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def decode_chunks(self, ids: bytes, step: int = 1 << 16) -> Iterator[bytes]:
        import numpy as np

        for at in range(0, len(ids), 4 * step):
            yield b"".join(map(self.table.__getitem__, np.frombuffer(ids[at : at + 4 * step], "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        machine = Utf8Machine()
        return "".join(map(machine.feed, self.decode_chunks(ids))) + machine.finish()


_CODECS: dict[tuple[int, str], Codec] = kept_tables(__name__)


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(raw), pattern)
    return _CODECS[key]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` (of the decoded
    bytes) and, with ``keep_ids``, ``ids`` (packed the same way) and ``decoded``.

    Null and empty texts have no tokens; a null id stays null; repeated rows are
    encoded each; other columns are not read.  The rank file is read on the
    driver and broadcast: its size is the vocabulary's, whatever the input.
    One narrow pass, no shuffle; a batch of texts is in memory at a time.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        gc.disable()  # the tables hold no cycles, and collections would walk them over and over; ``tidy`` enables them again
        for batch in batches:
            n, sha, back, kept, texts = [], [], [], [], []
            for cell in batch.column(1):
                ids = codec.encode(cell.as_py() or "")
                machine, digest, out = Utf8Machine(), hashlib.sha256(), []
                for chunk in codec.decode_chunks(ids):
                    digest.update(chunk)
                    text = machine.feed(chunk)
                    if keep_ids:
                        out.append(text)
                tail = machine.finish()
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(digest.hexdigest())
                if keep_ids:
                    kept.append(ids)
                    texts.append("".join(out) + tail)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary()), pa.array(texts, pa.string())] if keep_ids else []), names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidy(run), schema)
