"""Toxicity scores from a factorization machine over hashed terms.

A text's terms are its words in lower case and, of longer words, the first five
letters; each is hashed to 32 bits and counts once.  The score is the logistic
function of a bias, one weight a term, and for every pair of terms the inner
product of their factors, so that pairs such as an insult with a mention of a
group weigh more (or less) than the two do alone.

Fitting takes at most ``SAMPLE`` labelled rows (those of smallest id hash), and
only terms of those rows have weights, so the model's size is bounded and it is
broadcast.  Scoring is one narrow pass over all whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import small_batches, tidy

#: Bound of the labelled rows that the model is fitted on.
SAMPLE = 20_000
#: Terms whose pairs are looked at.
MOST_PAIRED = 2048
_WORDS = re.compile(r"[^\W_]+").findall


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace"))


class _Terms(dict):
    """Hashes of a word's terms, packed; remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = _hash(word)
        x = self[word] = h << 32 | (_hash("^" + word[:5]) if len(word) > 5 else h)
        return x


def term_hashes(text: str | None, memo: _Terms) -> np.ndarray:
    """Sorted distinct hashes of a text's terms."""
    words = set(_WORDS((text or "").lower()))
    x = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return np.unique(np.concatenate([x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)]).astype(np.uint32))


@dataclass
class Model:
    """Sorted term hashes with weights and factors."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def raw(self, hashes: np.ndarray) -> float:
        if not len(self.terms) or not len(hashes):
            return self.bias
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == hashes]
        v = self.factors[at]
        s = v.sum(0)
        return self.bias + float(self.weights[at].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())

    def score(self, hashes: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(hashes), -30, 30))))


def pair_terms(row: np.ndarray, at: np.ndarray, df: np.ndarray, y: np.ndarray, most: int = MOST_PAIRED, z: float = 5.7) -> np.ndarray:
    """Which terms tell something together that they don't tell alone: an insult only beside a mention, or one word without another.

    Of the ``most`` terms in the most rows, all pairs' toxic counts are compared
    with what the two members' own shares give if their log odds add up.  ``z``
    standard errors leave a fiftieth of a pair by chance.  ``row``, ``at``: cells.
    """
    out = np.zeros(len(df), bool)
    top = np.argsort(-df, kind="stable")[:most]
    top = top[df[top] >= 8]
    if len(top) < 2:
        return out
    place = np.full(len(df), -1)
    place[top] = np.arange(len(top))
    inside = place[at] >= 0
    row, at = row[inside], place[at[inside]]
    both, bad = np.zeros((len(top), len(top)), np.float32), np.zeros((len(top), len(top)), np.float32)
    for lo in range(0, len(y), 1024):
        here = (row >= lo) & (row < lo + 1024)
        x = np.zeros((min(1024, len(y) - lo), len(top)), np.float32)
        x[row[here] - lo, at[here]] = 1
        both += x.T @ x
        x = x[y[lo : lo + 1024] > 0]
        bad += x.T @ x
    share = y.mean()
    odds = lambda p: np.log(p / (1 - p))
    own = odds((np.diag(bad) + share) / (np.diag(both) + 1)) - odds(share)
    for lo in range(0, len(top), 256):
        hi = min(lo + 256, len(top))
        expected = 1 / (1 + np.exp(-(odds(share) + own[lo:hi, None] + own)))
        error = np.sqrt(both[lo:hi] * expected * (1 - expected) + 1)
        tells = (np.abs(bad[lo:hi] - both[lo:hi] * expected) > z * error) & (both[lo:hi] >= 8)
        tells[np.arange(hi - lo), np.arange(lo, hi)] = False
        out[top[lo:hi][tells.any(1)]] = True
    return out


def gradient(t: np.ndarray, where: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, v: np.ndarray, b: float):
    """Mean weighted logistic loss of a batch and its gradient: (loss, used terms, by weight, by factors, by bias).

    ``t``, ``where``: terms and rows of the batch's cells.
    """
    n, rank = len(y), v.shape[1]
    vt = v[t]
    s = np.stack([np.bincount(where, vt[:, k], n) for k in range(rank)], 1)
    raw = b + np.bincount(where, w[t], n) + 0.5 * ((s * s).sum(1) - np.bincount(where, (vt * vt).sum(1), n))
    g = weight * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / n
    used, inv = np.unique(t, return_inverse=True)
    gt = g[where]
    loss = (weight * (np.logaddexp(0, raw) - y * raw)).sum() / n
    return loss, used, np.bincount(inv, gt, len(used)), np.stack([np.bincount(inv, gt * (s[where, k] - vt[:, k]), len(used)) for k in range(rank)], 1), g.sum()


def train(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 30, rate: float = 0.5, l2: float = 1e-2, seed: int = 5) -> Model:
    """Fit by Adagrad on minibatches of the logistic loss.

    Terms in one row are left out.  Of the others those enter whose share among
    toxic rows is more than 3.5 standard errors from all rows', and those that
    tell something in a pair (:func:`pair_terms`), whatever their own share: the
    rest would be noise that adds up in long texts.  Toxic rows weigh as much in
    all as the others.  Without both labels, or without terms, every text gets
    the (smoothed) share of toxic rows.
    """
    y = np.asarray(labels, np.float64)
    none = Model(np.empty(0, np.uint32), np.empty(0), np.empty((0, rank)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y) or y.min() == y.max():
        return none
    lens = np.array([len(r) for r in rows])
    terms, at, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    toxic = np.bincount(at, np.repeat(y, lens), len(terms))
    share = y.mean()
    z = np.abs(toxic - df * share) / np.sqrt(df * share * (1 - share))
    keep = (df >= 2) & (z > 3.5)
    keep |= pair_terms(np.repeat(np.arange(len(y)), lens), at, df, y)
    if not keep.any():
        return none
    new = np.cumsum(keep) - 1
    row = np.repeat(np.arange(len(y)), lens)[keep[at]]
    at = new[at[keep[at]]]
    n = int(keep.sum())
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(n), rng.normal(0, 0.01, (n, rank)), none.bias
    gw, gv, gb = np.full(n, 1e-2), np.full((n, rank), 1e-2), 1e-2
    weight = np.where(y > 0, max(1.0, (1 - share) / share), 1.0)
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    for _ in range(max(epochs, 600 * 256 // len(y))):  # small samples get as many steps
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 256):
            batch = order[lo : lo + 256]
            size = starts[batch + 1] - starts[batch]
            where = np.repeat(np.arange(len(batch)), size)
            cell = np.repeat(starts[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            _, used, dw, dv, db = gradient(at[cell], where, y[batch], weight[batch], w, v, b)
            dw, dv = dw + l2 / len(batch) * w[used], dv + l2 / len(batch) * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += db**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.1 * rate * dv / np.sqrt(gv[used])
            b -= rate * db / np.sqrt(gb)
    return Model(terms[keep], w, v, float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` rows of smallest id hash of ``docs`` joined to ``labels`` (doc_id, toxic).

    Rows without text or with a null label are left out; of rows that repeat a
    doc_id, in either table, one is taken.  Texts become term hashes before they
    reach the driver, at most ``sample`` rows.
    """
    import pyarrow as pa

    small_batches(docs.sparkSession)
    lab = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("l_doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.groupBy("l_doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.select("l_doc_id", "toxic", F.xxhash64("l_doc_id").alias("h")).orderBy("h", "l_doc_id").limit(sample)
    rows = docs.where("text is not null").select("doc_id", "text").join(lab, F.col("doc_id") == F.col("l_doc_id"))
    rows = rows.groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Terms()
        for batch in batches:
            terms = [term_hashes(x.as_py(), memo).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(terms, pa.binary())], ["h", "doc_id", "toxic", "terms"])

    got = rows.mapInArrow(tidy(run), "h long, doc_id long, toxic int, terms binary").toLocalIterator(True)
    found = sorted(((r.h, r.doc_id, r.toxic, bytes(r.terms)) for r in got))[:sample]
    return train([np.frombuffer(t, np.uint32) for *_, t in found], np.array([int(y != 0) for _, _, y, _ in found]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) added.

    Null and empty texts get the score of a text without terms.  All columns
    stay, ones named score or predicted are replaced; an empty table gives no
    row; repeated rows are scored each.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    at = next(i for i, c in enumerate(kept) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = _Terms(), shared.value
        for batch in batches:
            s = [m.score(term_hashes(x.as_py(), memo)) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [*kept, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(tidy(run), schema)
