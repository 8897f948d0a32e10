"""Training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import _util, bpe, cap_dedup, chat, licenses, mixing, ngram_join, suffix_dedup, topk, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, bucket int, digest string"


def documents(spark, rows):
    """(doc_id, text[, source]) with columns whose names operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.0, "c", 1, "d") for r in rows], DOC)


# --- 1 -------------------------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant x"), (1, 1, "assistant", "a <\\| b <|im_start|> ü𝄞"), (1, 1, "assistant", "tie"), (1, 2, "us\ner\\n", None), (2, 0, None, ""), (2, None, "assistant", "first"),
        (None, 0, "assistant", "nobody"), (3, 0, "user", "x" * 100_000),
    ]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.render(log)).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in out:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=key)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
    d = {r.conv_id: r for r in chat.digests(chat.render(log)).collect()}
    loss = "a <\\| b <|im_start|> ü𝄞tie"
    assert (d[1].n_turns, d[1].loss_chars, d[1].loss_sha256) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert d[2].loss_sha256 == hashlib.sha256(b"first").hexdigest()
    assert chat.digests(chat.render(log.limit(0))).count() == 0


def test_chat_events_fold(spark):
    ev = [
        (1, 1, 0, "message", "user", "q"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", "assistant", "y"), (1, 4, 2, "message", "user", "more"), (1, 5, 0, "edit", "user", "Q"), (1, 6, 1, "regenerate", "assistant", None),
        (1, 7, 1, "delta", "assistant", "ok"), (2, 1, 0, "message", "user", "gone"), (2, 2, 0, "delete", None, None), (2, 3, 1, "odd", "user", "x"),
    ]
    got = chat.reconstruct(spark.createDataFrame(ev, "conv_id long, seq long, message long, kind string, role string, text string"))
    assert sorted((r.conv_id, r.turn, r.text) for r in got.collect()) == [(1, 0, "Q"), (1, 1, "ok")]


def brute_fold(events):
    said = {}
    for conv, _, m, kind, role, text in sorted(events, key=lambda e: (e[1], e[3], e[4] or "", e[5] or "")):
        here, role, text = said.setdefault(conv, {}), role or "", text or ""
        if kind in ("message", "edit", "regenerate"):
            here[m] = (role, "" if kind == "regenerate" else text)
        elif kind == "delta":
            old = here.get(m, (role, ""))
            here[m] = (old[0], old[1] + text)
        elif kind == "delete":
            here.pop(m, None)
        if kind == "regenerate":
            for k in [k for k in here if k > m]:
                del here[k]
    return sorted((c, m, *x) for c, here in said.items() for m, x in here.items())


def test_chat_events_fold_as_one_by_one(spark):
    """A regeneration counts though its message is edited or deleted later."""
    ev = [(0, 1, 0, "message", "user", "q"), (0, 2, 1, "message", "assistant", "a"), (0, 3, 2, "message", "user", "gone"), (0, 4, 1, "regenerate", "assistant", None), (0, 5, 1, "edit", "assistant", "b")]
    ev += [(-1, 1, 0, "message", "user", "q"), (-1, 2, 1, "message", "assistant", "gone"), (-1, 3, 0, "regenerate", "user", None), (-1, 4, 0, "delete", None, None), (-1, 5, 1, "delta", "assistant", "new")]
    rng = random.Random(12)
    for c in range(1, 120):
        for seq in range(rng.randint(1, 14)):
            ev.append((c, seq, rng.randint(0, 3), rng.choice(["message", "edit", "delta", "delta", "regenerate", "delete", "odd"]), rng.choice(["user", "assistant", None]), rng.choice([None, "x", "y", "zz"])))
    got = chat.reconstruct(spark.createDataFrame(ev, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute_fold(ev)


def test_chat_query_folds_events(spark, tmp_path, monkeypatch):
    """The query's rows come from the fold; ties, null turns and repeated rows stay apart."""
    from tidewheel.llm import queries

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, "n"), (1, None, "", None), (None, 0, "user", "x")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log.write.parquet(str(tmp_path / "conversations.parquet"))
    logs, fold = [], chat.reconstruct
    monkeypatch.setattr(chat, "reconstruct", lambda events: logs.append(events) or fold(events))
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert len(logs) == 1 and logs[0].where("kind = 'message'").count() == len(rows) + 2
    want = {r.conv_id: r for r in chat.digests(chat.render(log)).collect()}
    assert {k: got[k] for k in want} == want and got[-1].n_turns == 2


# --- 2 -------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((400, 6)) * 8)
    x[50:80] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (None, [1.0] * 6), (903, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0 or vec_id = 903"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    full = np.vstack([x, np.zeros((1, 6))])
    ids = [*range(400), 903]
    for q in [*range(0, 400, 20), 903]:
        s = full @ full[ids.index(q)]
        want = sorted(((-int(v), i) for v, i in zip(s, ids, strict=True) if i != q))[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, -v) for v, i in want]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (1, 2)")
    assert topk.top_k(few, few).count() == 2


# --- 3 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as P

    return bpe.Codec(bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)


def test_bpe_matches_library(codec):
    import public_tokenizers as P
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.fst.ranks, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "the", "ing", " ", "\n", "é", "漢", "🙂", "0", "'s", "!!", "　", "½", "ß", "\t", "abab", "<|endoftext|>"]
    texts = ["", " ", "a" * 3000, " " * 999] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == np.array(want.encode_ordinary(t), "<u4").tobytes()
        assert codec.decode(ids) == t


def test_bpe_streams_and_bounds(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_ARCS", 200)
    data = "reconstruction of internationalisation ".encode() * 20
    assert list(codec.fst.stream([data])) == list(codec.fst.stream([data[i : i + 3] for i in range(0, len(data), 3)]))


def test_utf8_machine():
    raw = "aé漢🙂z".encode() + b"\xf0\x9f"
    m = bpe.Utf8Machine()
    assert "".join(m.feed(raw[i : i + 1]) for i in range(len(raw))) + m.finish() == raw.decode("utf-8", "replace")


def test_bpe_documents(spark):
    import public_tokenizers as P

    d = documents(spark, [(1, "hello world"), (1, "hello world"), (None, None), (2, "")])
    got = bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.decoded) for r in got) == [(-1, 0, ""), (1, 2, "hello world"), (1, 2, "hello world"), (2, 0, "")]
    assert bpe.encode_documents(d.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- 4 -------------------------------------------------------------------------------------------


def brute_join(rows, n, percent):
    sets_ = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets_[i] = frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids, links = sorted(sets_), dict.fromkeys(sets_, 0)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        x, y = sets_[a], sets_[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets_[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, monkeypatch, n, percent):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rng = random.Random(percent)
    word = lambda: "w%d" % rng.randint(0, 400)
    rows = [(i, t) for i, t in enumerate([None, "", " \t ", "One", "one", "one two", "ONE  two", "a b c"])]
    for size in (5, 12, 40, 150):
        base = [word() for _ in range(size)]
        for _ in range(14):
            w = [word() if rng.random() < 0.03 else x for x in base]
            if rng.random() < 0.3:
                w = w[: -max(1, size // 20)]
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_join(documents(spark, rows).repartition(3), n, percent).collect()}
    assert got == brute_join(rows, n, percent)


def test_jaccard_join_edges(spark):
    d = documents(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f")])
    got = sorted((r.doc_id or -1, r.component_id, r.n_links) for r in ngram_join.jaccard_join(d).collect())
    assert got == [(-1, None, 0), (7, 7, 2), (7, 7, 2), (8, 7, 2)]
    assert ngram_join.jaccard_join(d.limit(0)).count() == 0


def test_jaccard_join_compares_each_text_of_an_id(spark):
    """Both texts under one id link, whatever order they arrive in."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a + " x"), (7, a), (7, b), (9, b + " x"), (11, c), (7, b), (3, "alone")]
    want = [(3, 3, 0), (5, 5, 1), (7, 5, 1), (7, 5, 2), (7, 5, 2), (9, 5, 2), (11, 11, 0)]
    for order in (rows, rows[::-1]):
        got = ngram_join.jaccard_join(documents(spark, order).coalesce(1)).collect()
        assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == want
    apart = ngram_join.jaccard_join(documents(spark, rows), by_text=True).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in apart) == [(3, 3, 0), (5, 5, 1), (7, 5, 1), (7, 7, 2), (7, 7, 2), (9, 7, 2), (11, 11, 0)]


def test_tile_keys_lose_no_pair():
    """Any two sets at the threshold share a key."""
    rng = np.random.default_rng(5)
    table = ngram_join.bands(90, 100)
    starts = np.array([x[0] for x in table])
    for _ in range(300):
        size = int(rng.integers(9, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        d = ngram_join.most_apart(len(a), len(a), 90, 100)
        cut = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, d - cut).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 190 * inter >= 90 * (len(a) + len(b)):
            assert len(np.intersect1d(ngram_join.tile_keys(a, table, starts, 90, 100), ngram_join.tile_keys(b, table, starts, 90, 100)))


# --- 5 -------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["idiot", "scum", "trash"])
        rows.append((i, " ".join(w), int(toxic)))
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "x " * 50_000)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)  # some toxic rows have lost two of three words to chance
    assert got[1000].score == got[1001].score and got[1002].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train([], np.array([])).score(np.empty(0, np.uint32)) == 0.5


def test_factors_learn_a_pair():
    """Neither term alone is toxic, both together are."""
    rng = np.random.default_rng(0)
    rows = [np.unique(np.array([1] * int(a) + [2] * int(b) + [10 + int(z)], np.uint32)) for a, b, z in zip(rng.random(4000) < 0.5, rng.random(4000) < 0.5, rng.integers(0, 50, 4000), strict=True)]
    y = np.array([int(1 in r and 2 in r) for r in rows])
    m = toxicity.train(rows, y)
    assert m.score(np.array([1, 2], np.uint32)) > 0.7 > m.score(np.array([1], np.uint32))


# --- 6 -------------------------------------------------------------------------------------------


def brute_removal(rows, length=200):
    seen = {}
    for t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [3, 256])
def test_suffix_removal_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, exact, short = text(310), text(200), text(180)
    rows = [None, "", "x" * 199, "x" * 200, "y" * 201, "ab" * 300, text(900)]
    rows += [text(rng.randint(0, 90)) + p + text(rng.randint(0, 90)) for p in (passage, exact, short) for _ in range(6)]
    rows += [rows[-1], text(30) + passage + passage[:250], text(120_000)]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(documents(spark, list(enumerate(rows))).repartition(3)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_removal(rows)


def test_suffix_removal_keeps_columns(spark):
    d = documents(spark, [(None, "z" * 50 + "q" * 300), (2, "keep")])
    got = {r.n_bytes: r for r in suffix_dedup.remove_repeats(d, keep_text=True).collect()}
    assert got[350].kept == "z" * 50 and got[4].kept == "keep" and got[4].whole.lang == "en"
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(230)) for _ in range(6)]
    data = b"".join(parts[i % 6][: 200 + i] for i in range(20))
    starts = np.arange(len(data) - 199)
    seen = {}
    for s in starts:
        seen.setdefault(data[s : s + 200], []).append(s)
    want = np.zeros(len(starts), bool)
    for v in seen.values():
        if len(v) > 1:
            want[v] = True
    assert (suffix_dedup.repeated_suffixes(data, starts) == want).all()


def test_blind_trie():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(200)]
    trie, seen = suffix_dedup.BlindTrie(strings), {}
    for i, s in enumerate(strings):
        same = trie.insert(i)
        assert (same is not None) == (s in seen)
        seen.setdefault(s, i)


# --- 7 -------------------------------------------------------------------------------------------


def test_cap_links(spark, monkeypatch):
    monkeypatch.setattr(cap_dedup, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base, base[0] + 0.12 * rng.standard_normal((60, 24)), base[1] + 0.3 * rng.standard_normal((30, 24)), base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 24), (502, [1.0, None]), (503, [float("inf")] * 24), (504, []), (505, [2.0]), (506, [3.0])]
    got = {r.vec_id: r for r in cap_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.array([np.array(r[1], np.float32) for r in rows[: len(x)]], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    deg = links.sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= deg).all() and found.sum() >= 0.98 * deg.sum()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(500, 505))
    assert got[505].n_links == got[506].n_links == 1 and got[506].component_id == 505
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("directions", [1 << 18, 65**4, 1 << 27])
def test_cap_recall_holds_with_the_number_of_directions(directions):
    """Pairs at cosine 0.9 share a cap at any size of the table."""
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.9**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    words, lists = cap_dedup.plan(directions, 24.0, 2)
    code = cap_dedup.Code(64, words, 2, lists, 29)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y), strict=True)]
    assert np.mean(met) >= 0.94


# --- 8 -------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()), (2, mit.replace("MERCHANTABILITY", "merchantibility") + "\n"), (3, mit + " and more"), (4, None), (5, ""), (6, "LICENCED under the Apache Licence, version 2.0")]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[i].license for i in range(1, 7)] == ["MIT", "MIT", None, None, None, "Apache-2.0-notice"]
    for i, t in rows:
        assert got[i].digest == hashlib.sha256(licenses.canonical_text(t or "").encode()).hexdigest()
    assert licenses.scan(documents(spark, rows).limit(0)).count() == 0


def test_license_forms(spark):
    """Whole licences, titles, wrapped lines that start with "copyright", and notices before a licence on one line."""
    known = licenses.KNOWN
    mit, isc, bsd = known["MIT"], known["ISC"], known["BSD-3-Clause"]
    wrapped = mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    assert wrapped != mit
    rows = [
        ("MIT License\n\nCopyright (c) 2020 A. B. Smith, Inc.\n\n" + mit, "MIT"), ("ISC License\r\n\r\nCopyright 2020 X\r\n" + isc, "ISC"), (wrapped, "MIT"), ("Copyright (c) 2020 X. " + mit, "MIT"),
        ("Copyright (c) 2020, X\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), ("(c) 2001-2020 X. All rights reserved. " + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
        (mit.replace("\n\n", "\n\nCopyright Joyent, Inc. and other contributors\n\n", 1), "MIT"), ("\xa9 X\n" + known["BSD-2-Clause"], "BSD-2-Clause"), ("copyright holders be liable", None), ("Copyright (c) 2020 X", None),
        ("(c) You must retain", None), (known["GPL-3.0"].split("END OF TERMS")[0], "GPL-3.0"), (known["Apache-2.0"].split("APPENDIX")[0], "Apache-2.0"), ("Copyright (c) " + "x " * 20_000, None), ("copyright permission\u2028is \x85 this\r\n", None),
    ]
    rows += [(known[n], n) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, [(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    assert [got[i].license for i in range(len(rows))] == [n for _, n in rows]
    for i, (t, _) in enumerate(rows):
        assert got[i].digest == hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest()
    assert licenses.canonical_text("x\ncopyright holders be\n(c) You must") == "x copyright owners be c you must"
    assert licenses.canonical_text("copyright 2020 Permissions Ltd. All rights reserved. Permission is") == "permission is"


# --- 9 -------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(5, "u5", "same"), (3, None, "same"), (9, "u\r\nX: y", "same"), (4, "u4", None), (6, "u6", ""), (7, "u7", "é" * 70_000), (8, "u8", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    path = warc.archive_dir(spark)
    warc.write_pages(pages.repartition(3), path)
    got = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    one = spark.read.format("warc").load(path).where("target_uri = 'u7' and record_type in ('response', 'x')").collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == "é" * 70_000
    warc.remove(path)


def test_warc_foreign_files(tmp_path):
    import gzip

    def record(kind, payload):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"

    plain = record("warcinfo", b"i") + record("response", b"x" * 5000) + record("response", b"")
    for data in (plain, gzip.compress(record("warcinfo", b"i")) + gzip.compress(record("response", b"x" * 5000)) + gzip.compress(record("response", b""))):
        p = tmp_path / "a.warc.gz"
        p.write_bytes(data)
        where, path = warc.open_fs(str(p))
        with where.open_input_file(path) as f:
            got = [(h["WARC-Type"], b) for h, b in warc.read_records(f, lambda h: h["WARC-Type"] == "response", True)]
        assert got == [("response", b"x" * 5000), ("response", b"")]


# --- 10 ------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full, total = set(names), set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        t = {s: rest * w[s] / sum(w[x] for x in left) for s in left} | {s: cap * sizes[s] for s in full}
        over = {s for s in left if t[s] > cap * sizes[s]}
        if not over:
            return t
        left, full = left - over, full | over


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 400])), rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"])) for i in range(300)] + [(300, None, "empty"), (7, "dup dup", "a")]
    d = documents(spark, rows)
    blocks, sources = mixing.mix(d, shards=8)
    out = mixing.per_document(blocks, sources).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    got = {r.source: r for r in sources.collect()}
    assert {s: got[s].target for s in want} == pytest.approx(want)
    by = {}
    src = {i: s for i, _, s in rows[:301]}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by[src[r.doc_id]] = by.get(src[r.doc_id], 0) + r.taken
    assert all(abs(by[s] - want[s]) <= 33 for s in want)
    again = mixing.per_document(*mixing.mix(d.repartition(5), shards=8)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    n = [r[0] for r in mixing.draws(blocks).groupBy("shard").count().select("count").collect()]
    assert len(n) == 8 and max(n) - min(n) <= 3
    assert mixing.per_document(*mixing.mix(d.limit(0), shards=8)).count() == 0


def test_splitting_tree_is_hypergeometric(spark):
    """Totals are exact at every shard; one source's share varies as the distribution says."""
    q = spark.createDataFrame([(0, 400), (1, 100), (2, 12)], "sid int, q long")
    draws = []
    for seed in range(12):
        leaves = mixing.split_quotas(q, 4, seed).collect()
        shard = {}
        for r in leaves:
            shard[r.shard] = shard.get(r.shard, 0) + r.n
            if r.sid == 1:
                draws.append(r.n)
            assert r.n >= 0
        assert set(shard.values()) == {128}
        assert sum(r.n for r in leaves if r.sid == 0) == 400
    mean, sd = np.mean(draws), np.std(draws)
    assert mean == 25 and 0.6 * math.sqrt(25 * 0.8 * 0.75) < sd < 1.5 * math.sqrt(25 * 0.8 * 0.75)


def test_mixed_documents(spark):
    d = documents(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(40)])
    got = mixing.mixed_documents(d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.source: r.n for r in got} == {"a": 40, "b": 20}


def test_mixed_documents_stand_in_shuffled_shards(spark):
    """The draw's shards are together, and each is in the order of its places."""
    d = documents(spark, [(i, "w " * 10, "ab"[i % 2]) for i in range(200)])
    blocks, _ = mixing.mix(d, 4, None)
    want = {}
    for x in sorted(mixing.draws(blocks).collect(), key=lambda x: (x.shard, x.place)):
        want.setdefault(x.shard, []).append(x.doc_id)
    got = [r.doc_id for r in mixing.mixed_documents(d, 4).collect()]
    where = {k: next(i for i in range(len(got)) if got[i : i + len(v)] == v) for k, v in want.items()}
    assert len(want) == 4 and sorted(where.values()) == sorted(set(where.values())) and sum(map(len, want.values())) == len(got) == 300
    assert all(v != sorted(v) for v in want.values())


def test_pipeline_order():
    import corpus_pipeline

    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram", "suffix-array", "mixing", "byte-level"]


def test_pipeline_keeps_differing_texts_of_an_id(spark):
    """One row of each group of near copies stays; other texts under the same id are left alone."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (7, a + " x"), (7, b), (7, b), (7, c), (8, c + " x"), (9, ""), (9, ""), (None, a)]
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.keep_one_of_each_group(spark, documents(spark, order), "")
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, a), (5, a), (7, b), (7, c), (9, ""), (9, "")]


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: " ".join("w%d" % rng.randint(0, 10**6) for _ in range(60))
    near = text()
    rows = [(i, text(), "ab"[i % 2]) for i in range(60)] + [(100, near, "a"), (101, near + " x", "b"), (102, near, "b"), (103, None, None), (104, "", "a")]
    d = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert 100 in ids and not ids & {101, 102}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_by_rounds_and_in_one_task(spark, few):
    """A path, a star whose hub is hot, a cycle, loops, nulls and repeats; both ways give the smallest node."""
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1001 + i) for i in range(400)]
    rest = [(5, 7), (7, 9), (9, 5), (3, 3), (None, 4), (5, 7)]
    got = dict(map(tuple, _util.connected_components(spark.createDataFrame(path + star + rest, "a long, b long"), few=few).collect()))
    want = {i: 100 for i in range(100, 161)} | {1000 + i: 1000 for i in range(401)} | {5: 5, 7: 5, 9: 5}
    assert got == want
    assert _util.connected_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_top_k_ranks_repeated_candidates_each(spark):
    """Rows of one id are candidates each; ties go to the smaller id."""
    rows = [(0, [1.0, 0.0])] + [(7, [9.0, 0.0])] * 6 + [(i, [9.0, 0.0]) for i in range(8, 13)] + [(20, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id = 0"), 5).collect()))
    assert got == [(0, i, 7, 9) for i in range(1, 6)]
    got = sorted(map(tuple, topk.top_k(v.dropDuplicates(["vec_id"]), v.where("vec_id = 0"), 5).collect()))
    assert got == [(0, i + 1, 7 + i, 9) for i in range(5)]


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns that clash with inner names, or need quoting, come back as they were."""
    rows = [(i, f"word{i} " * 30, "s" if i % 2 else None, "x", i, i + 1, None) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, `my col` string, n int, _times int, `_rank` string")
    assert mixing.mixed_documents(d).columns == d.columns
    assert set(map(tuple, mixing.mixed_documents(d).collect())) <= set(rows)
    kept = suffix_dedup.remove_repeats(d, keep_text=True)
    assert sorted(r.whole["my col"] for r in kept.collect()) == ["x"] * 8
    assert mixing.mixed_documents(d.limit(0)).count() == 0


def test_hot_windows_by_digest_equal_brute_force(spark, monkeypatch):
    """The split path gives the same bytes as the sorted one."""
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(260))
    rows = [(i, f"{i} begins here " * 3 + passage + f" and {i * 17} ends " * 3) for i in range(12)] + [(99, "alone " * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, suffix_dedup.remove_repeats(d).collect()))
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(d).collect())) == plain


def test_machine_equals_explicit_pairs_and_finite_differences():
    """The score is bias, weights and every pair's product; the gradient is that of the loss."""
    rng = np.random.default_rng(3)
    m = toxicity.Model(np.sort(rng.choice(1 << 30, 9, False)).astype(np.uint32), rng.normal(size=9), rng.normal(size=(9, 4)), 0.3)
    for _ in range(5):
        own = np.sort(rng.choice(9, rng.integers(0, 9), False))
        want = m.bias + m.weights[own].sum() + sum(float(m.factors[i] @ m.factors[j]) for i in own for j in own if i < j)
        assert m.raw(np.append(m.terms[own], np.uint32(7))) == pytest.approx(want)
    rows = [np.sort(rng.choice(9, rng.integers(1, 6), False)) for _ in range(12)]
    t, where = np.concatenate(rows), np.repeat(np.arange(12), [len(r) for r in rows])
    y, weight, w, v, b = rng.integers(0, 2, 12).astype(float), rng.uniform(1, 3, 12), rng.normal(size=9), rng.normal(size=(9, 4)), 0.2
    loss = lambda w, v, b: toxicity.gradient(t, where, y, weight, w, v, b)[0]
    _, used, dw, dv, db = toxicity.gradient(t, where, y, weight, w, v, b)
    e = 1e-6
    assert db == pytest.approx((loss(w, v, b + e) - loss(w, v, b - e)) / (2 * e), abs=1e-6)
    for k, i in enumerate(used):
        up = np.zeros(9)
        up[i] = e
        assert dw[k] == pytest.approx((loss(w + up, v, b) - loss(w - up, v, b)) / (2 * e), abs=1e-6)
        for r in range(4):
            upv = np.zeros((9, 4))
            upv[i, r] = e
            assert dv[k, r] == pytest.approx((loss(w, v + upv, b) - loss(w, v - upv, b)) / (2 * e), abs=1e-6)


def test_terms_that_tell_only_together_are_learned():
    """The label is one of two words without the other: neither says anything alone."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.unique(np.array([10] * a + [20] * b + rng.choice(np.arange(100, 200), 5, False).tolist(), np.uint32)))
        labels.append(a ^ b)
    m = toxicity.train(rows, np.array(labels))
    assert {10, 20} <= set(m.terms.tolist())
    right = np.mean([(m.score(r) >= 0.5) == y for r, y in zip(rows, labels, strict=True)])
    assert right > 0.95


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages on toxic rows, near copies and repeated passages, against plain loops; every returned row counts."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    rng = random.Random(21)
    text = lambda n: " ".join("w%d" % rng.randint(0, 10**6) for _ in range(n))
    passage, near = text(45), text(80)
    rows = [(i, text(rng.randint(5, 40)) + (" scum vermin filth" if i % 5 == 0 else " kind words here"), "abc"[i % 3]) for i in range(90)]
    rows += [(200, near, "a"), (201, near + " x", "b"), (202, near, None), (210, text(30) + " " + passage, "a"), (211, passage + " " + text(30), "b"), (220, None, None), (221, "", "a"), (222, " ", "c")]
    d = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("my col"), F.lit(1).alias("n"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    # toxicity: the machine's explicit sum over pairs
    model = toxicity.fit(d, labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    at = {int(t): i for i, t in enumerate(model.terms)}

    def score(t):
        own = [at[int(h)] for h in toxicity.term_hashes(t, toxicity._Terms()) if int(h) in at]
        raw = model.bias + sum(model.weights[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(own, 2))
        return 1 / (1 + math.exp(-raw))

    kept = [r for r in rows if score(r[1]) < 0.7]
    assert any(r not in kept for r in rows[:90:5]) and all(r in kept for r in rows[90:])
    # near copies: one of each component by all pairs
    parts = brute_join([(i, t) for i, t, _ in kept], 5, 80)
    kept = [r for r in kept if parts[r[0]][1] == r[0]]
    assert {200} == {r[0] for r in kept} & {200, 201, 202}
    # repeated bytes
    seen = {}
    for _, t, _ in kept:
        b = (t or "").encode()
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    cut = []
    for i, t, s in kept:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        cut.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "replace"), s))
    assert any(len(t) < len(next(x for j, x, _ in kept if j == i) or "") for i, t, _ in cut)
    # the mix: whole documents in the hashed order of their source, round again up to the target
    size = {i: len(mixing_words(t)) for i, t, _ in cut}
    order = {r.doc_id: r.h for r in spark.createDataFrame([(i, size[i]) for i, *_ in cut], "doc_id long, size long").select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.lit(0).cast("long"), "size").alias("h")).collect()}
    total = {s: sum(size[i] for i, _, x in cut if x == s) for s in {x for *_, x in cut}}
    goal = brute_targets(total)
    mixed = []
    for s in total:
        before = 0
        for i, t, _ in sorted((x for x in cut if x[2] == s), key=lambda x: order[x[0]] % 2**64):
            middle = before + size[i] / 2
            mixed += [(i, t)] * ((size[i] > 0 and middle <= goal[s]) + (size[i] > 0 and middle + total[s] <= goal[s]))
            before += size[i]
    # tokens by the library
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines() if x.strip())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in mixed:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def mixing_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_screen_of_many_tiles_equals_brute_force():
    """Members that have a near partner, for tiles of one block and of two."""
    rng = np.random.default_rng(6)
    tile = np.sort(rng.integers(0, 12, 90))
    two = rng.integers(0, 2, 12).astype(bool)
    side = np.where(two[tile], rng.integers(0, 2, 90), 0)
    words = rng.integers(-(2**63), 2**63, (90, 4))
    words[1:30] = words[0]
    bits = lambda a, b: sum(int(x).bit_count() for x in (words[a] ^ words[b]).view(np.uint64))
    want = [any(tile[a] == tile[b] and a != b and (not (side[tile == tile[a]] == 1).any() or side[a] != side[b]) and bits(a, b) <= 120 for b in range(90)) for a in range(90)]
    assert cap_dedup._near(tile, side, words, 120).tolist() == want


def test_embeddings_of_an_empty_table(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>, caps int, `row` string")
    assert cap_dedup.near_duplicates(v).count() == 0


def test_bpe_pieces_agree_however_they_are_run(codec):
    """A piece's ids are the same the first time, again when its arcs are determinised, and streamed; short or long."""
    rng = random.Random(12)
    fresh = bpe.MergeTransducer(codec.fst.ranks)
    for _ in range(150):
        piece = bytes(rng.choice(b"abcdeflnorst \xc3\xa9") for _ in range(rng.choice([1, 5, 30, 63, 64, 65, 200])))
        once = fresh.piece(piece)
        assert once == fresh.piece(piece) == fresh.piece(piece)
        assert fresh.ranks.get(piece) is not None or once == list(fresh.stream([piece]))


def test_warc_cut_short_is_an_error(tmp_path, monkeypatch):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\n" + b"x" * 50 + b"\r\n\r\n"
    monkeypatch.setattr(warc, "MOST_HEAD", 1 << 12)
    for data, payload in ((record[:-30], True), (record[:-30], False), (b"WARC/1.0\r\nA: " + b"y" * 9000, True)):
        p = tmp_path / "a.warc"
        p.write_bytes(data)
        where, path = warc.open_fs(str(p))
        with where.open_input_file(path) as f, pytest.raises(ValueError, match="byte 0"):
            list(warc.read_records(f, lambda h: True, payload))


def test_warc_edges(spark):
    """Null ids, repeats of the smallest id, an empty table, clashing columns."""
    pages = spark.createDataFrame([(None, "u", "a", 1), (2, "v", "a", 1), (2, "w", "a", 1), (None, None, "b", 1)], "page_id long, url string, html string, sha int")
    path = warc.archive_dir(spark)
    warc.write_pages(pages, path)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read_pages(spark, path).collect())
    assert got == [(-1, "response", None), (-1, "revisit", 2), (2, "response", None), (2, "response", None)]
    warc.remove(path)
    path = warc.archive_dir(spark)
    warc.write_pages(pages.limit(0), path)
    assert warc.read_pages(spark, path).count() == 0


def test_pipeline_stages_on_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, n int, `my col` string, _rank int, gone_id long"
    more = (0.5, "d", 1, "m", 2, 3)
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(20_000))
    rows = [(None,) * 11, (1, None, None, None, None, *more), (2, "", "en", "a", 0, *more), (3, long, "en", "a", 1, *more), (4, "just some words of a short text", "en", None, 2, *more), (4, "just some words of a short text", "en", None, 2, *more), (None, "words without an id stay here", "en", "b", 3, *more)]
    spark.createDataFrame([(3, 1, 0), (4, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r["my col"] in ("m", None) for r in got)
        if name in ("toxicity", "suffix-array dedup"):
            assert len(got) == len(rows)
        elif name == "n-gram Jaccard join":
            assert len(got) == len(rows) - 1  # the repeated row
        else:
            assert {r.doc_id for r in got} <= {3, 4, None}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(rows) and last.where("n_tokens = 0").count() == 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_workers_drop_tables_of_other_operators():
    """A worker's next operator doesn't carry the last one's tables along; tasks of the same one share them."""

    def run(table):
        return table

    run.__module__ = bpe.__name__
    bpe._CODECS["some"] = "tables"
    assert _util.tidy_group(run)(1) == 1 and bpe._CODECS == {"some": "tables"}
    run.__module__ = suffix_dedup.__name__
    assert _util.tidy_group(run)(1) == 1 and bpe._CODECS == {}
    bpe._CODECS["some"] = "tables"
    assert list(_util.tidy(run)([2])) == [2] and bpe._CODECS == {}


@pytest.mark.parametrize("name", ["collect", "cover"])
def test_hot_windows_are_digested_in_stretches(monkeypatch, name):
    """Memory for the windows of hot anchors doesn't follow the bucket's size."""
    real, most = suffix_dedup._window_digests, 40_000

    def bounded(found):
        if sum(map(len, found)) > most:
            raise MemoryError(f"windows of {sum(map(len, found))} bytes at once")
        return real(found)

    monkeypatch.setattr(suffix_dedup, "DIGESTED", most - 2 * suffix_dedup.LENGTH, raising=False)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(2_000)
    found = [(i, 0, (text(40) + passage)[at : at + 300].encode()) for i in range(60) for at in range(0, 1_700, 60)]
    monkeypatch.setattr(suffix_dedup, "_window_digests", bounded)
    whole, n = real([x[-1] for x in found])
    if name == "collect":
        want = suffix_dedup._distinct(whole)
        got = suffix_dedup._distinct_windows(iter(found))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    else:
        parts = list(suffix_dedup._digested(iter(found)))
        assert [y for x, _, _ in parts for y in x] == found and len(parts) > 1
        assert (np.concatenate([w for _, w, _ in parts]) == whole).all() and (np.concatenate([k for _, _, k in parts]) == n).all()
