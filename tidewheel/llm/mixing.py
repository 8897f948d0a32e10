"""Mixing sources to target weights, in DataFrame and SQL functions only.

1. Targets: every source's share of the mix by weight, capped at a multiple of
   its size, the excess shared again by weight (water filling over the table of
   sources).
2. Blocks: each document is cut into runs of words (or kept whole); a source's
   blocks stand in a random order that a hash fixes.  Positions are found in
   two levels (hash range, then place within it), so a source that holds a third
   of all rows is spread over many tasks.  The blocks up to the target, going
   round again where the target exceeds the source, give the exact block quota.
3. Splitting tree: the quotas of all sources are parted between the left and the
   right half of the output shards by a multivariate hypergeometric draw with
   exact totals, recursively, down to single shards.
4. A shard's count of a source is a run of that source's permuted draws, so
   shards are disjoint; each shard is then shuffled by hash on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Hash ranges a source's blocks are split into (a power of two).
RANGE_BITS = 10


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: ``sid`` (0, 1, ... by code point, null last), ``source``, ``source_size``, ``target``.

    The table of sources is the only thing sorted in one task.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "sid")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size")).over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "w"
    ).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(whole))
    return s.select("sid", "source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _hypergeometric(n: str, total: str, q: str, u: str) -> str:
    """SQL for a hypergeometric draw: of ``total`` draws ``q`` are this source's; how many of ``n`` taken ones are.

    Inverse distribution function from the mode outwards, by the ratio of
    neighbouring probabilities; beyond 10 standard deviations nothing is left
    that a double can hold.
    """
    mode = f"least(least({q}, {n}), greatest(greatest(0L, {n} + {q} - {total}), cast(floor(({n} + 1D) * ({q} + 1D) / ({total} + 2D)) as bigint)))"
    wide = f"cast(10 * sqrt({n} * ({q} / greatest({total}, 1D)) * (1 - {q} / greatest({total}, 1D))) + 10 as bigint)"
    up = f"((({q}) - k) * (({n}) - k)) / ((k + 1D) * (({total}) - ({q}) - ({n}) + k + 1D))"
    down = f"(k * (({total}) - ({q}) - ({n}) + k)) / ((({q}) - k + 1D) * (({n}) - k + 1D))"
    ups = f"if(p.m < p.hi, sequence(p.m, p.hi - 1), array())"
    downs = f"if(p.m > p.lo, sequence(p.m, p.lo + 1, -1), array())"
    mass = lambda seq, ratio: f"aggregate(cast({seq} as array<bigint>), named_struct('w', 1D, 's', 0D), (z, k) -> named_struct('w', z.w * {ratio}, 's', z.s + z.w * {ratio}), z -> z.s)"
    walk = lambda seq, ratio, step, left: (
        f"aggregate(cast({seq} as array<bigint>), named_struct('w', 1D, 'left', {left}, 'at', p.m), (z, k) -> if(z.left <= 0, z, "
        f"named_struct('w', z.w * {ratio}, 'left', z.left - z.w * {ratio}, 'at', z.at + {step})), z -> z.at)"
    )
    pick = (
        f"transform(array(named_struct('d', {mass(downs, down)}, 'u', {mass(ups, up)})), t -> "
        f"if({u} * (t.d + t.u + 1D) < 1D, p.m, if({u} * (t.d + t.u + 1D) < 1D + t.u, "
        f"{walk(ups, up, '1L', f'{u} * (t.d + t.u + 1D) - 1D')}, {walk(downs, down, '-1L', f'{u} * (t.d + t.u + 1D) - 1D - t.u')})))[0]"
    )
    lo = f"greatest(greatest(0L, {n} + {q} - {total}), {mode} - {wide})"
    hi = f"least(least({q}, {n}), {mode} + {wide})"
    return f"transform(array(named_struct('m', {mode}, 'lo', {lo}, 'hi', {hi})), p -> {pick})[0]"


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``quotas`` (sid, q) -> ``shard``, ``sid``, ``n``: the leaves of the splitting tree.

    ``shards`` is a power of two.  Each node gives its left half exactly half of
    its draws (rounded down), source by source hypergeometrically given what the
    sources before have taken.  The tree is one row a node with an array over the
    sources; totals are kept exactly at every level.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", F.col("q").cast("long").alias("q")))), lambda x: x["q"]).alias("qs"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), "qs")
    total = "aggregate(qs, 0L, (a, x) -> a + x)"
    for level in range(shards.bit_length() - 1):
        u = f"((xxhash64({seed}L, {level}, node, size(s.out)) & 9007199254740991L) / 9007199254740992D)"
        draw = _hypergeometric("s.n", "s.total", "x", u)
        step = f"transform(array({draw}), d -> named_struct('n', s.n - d, 'total', s.total - x, 'out', array_append(s.out, d)))[0]"
        left = f"aggregate(qs, named_struct('n', {total} div 2, 'total', {total}, 'out', cast(array() as array<bigint>)), (s, x) -> {step}, s -> s.out)"
        nodes = nodes.select("node", "qs", F.expr(left).alias("lefts"))
        nodes = nodes.select(
            F.explode(F.expr("array(named_struct('node', node * 2, 'qs', lefts), named_struct('node', node * 2 + 1, 'qs', zip_with(qs, lefts, (q, l) -> q - l)))")).alias("x")
        ).select("x.node", "x.qs")
    return nodes.select(F.col("node").alias("shard"), F.posexplode("qs").alias("sid", "n"))


def _size_documents(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(F.col("text").cast("string")).alias("size"))).withColumn("row", F.monotonically_increasing_id())


def mix(docs: DataFrame, shards: int = 16, block_words: int | None = 64, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Mix the sources of ``docs`` (doc_id, source, text) to the target weights.

    Returns ``(blocks, sources)``.  ``blocks`` has a row a block: ``row`` (one of
    ``docs``), doc_id, source's ``sid``, size of the document, ``block`` (its
    number in the document), ``words``, and ``shards``, the output shards it is
    drawn into (none, one, or two when the source goes round again).
    ``sources`` is the result of :func:`targets`.  :func:`draws` explodes it.

    Null or empty texts have size 0 and one block of no words, never drawn; null
    sources are a source of their own, sorted last; repeated documents are
    separate rows; a null doc_id is kept.  An empty table gives no row.  A
    source's taken words differ from its target by half a block at most.  The
    result depends on ids, sources, sizes and ``seed`` alone, so reruns agree.

    Shuffles: by source (partially aggregated), by (source, hash range) for
    blocks, by row at the end.  The sources' table is small but is not
    broadcast by force: the optimiser does so below its size threshold, else
    it splits the hot source's join partition.
    """
    sized = _size_documents(docs)
    sources = cut(targets(sized, weights, share, cap))
    s = sources.select(F.col("source").alias("its_source"), "sid", "source_size", "target")
    d = sized.join(s, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source", "source")
    if block_words is None:
        b = d.withColumn("block", F.lit(0).cast("long")).withColumn("words", F.col("size"))
    else:
        last = F.greatest(F.ceil(F.col("size") / block_words) - 1, F.lit(0)).cast("long")
        b = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        b = b.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
    b = b.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "block", "size"))
    b = b.withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    here = Window.partitionBy("sid", "range").orderBy("h", "doc_id", "block", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = b.withColumn("words_before", F.coalesce(F.sum("words").over(here), F.lit(0))).withColumn("rank", F.count(F.when(F.col("words") > 0, 1)).over(here))
    sums = b.groupBy("sid", "range").agg(F.sum("words").alias("w"), F.count(F.when(F.col("words") > 0, 1)).alias("n"))
    up_to = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("sid").alias("o_sid"), F.col("range").alias("o_range"), F.coalesce(F.sum("w").over(up_to), F.lit(0)).alias("w0"),
        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n0"), F.sum("n").over(Window.partitionBy("sid")).alias("blocks"),
    )
    placed = placed.join(sums, (F.col("sid") == F.col("o_sid")) & (F.col("range") == F.col("o_range")))
    middle = F.col("w0") + F.col("words_before") + F.col("words") / 2
    first = (F.col("words") > 0) & (middle <= F.col("target"))
    again = (F.col("words") > 0) & (middle + F.col("source_size") <= F.col("target"))
    placed = cut(
        placed.select("row", "doc_id", "sid", "size", "block", "words", (F.col("n0") + F.col("rank")).alias("rank"), "blocks", (first.cast("int") + again.cast("int")).alias("copies"))
    )
    quotas = placed.groupBy("sid").agg(F.sum("copies").alias("q"))
    leaves = cut(split_quotas(quotas, shards, seed))
    ends = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaves = leaves.withColumn("end", F.sum("n").over(ends)).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    blocks = placed.join(leaves.withColumnRenamed("sid", "l_sid"), F.col("sid") == F.col("l_sid"))
    shard_of = lambda at: F.size(F.filter("ends", lambda e: e <= at))
    rank, n = F.col("rank"), F.col("blocks")
    shards_ = F.when(F.col("copies") == 0, F.array().cast("array<int>")).when(F.col("copies") == 1, F.array(shard_of(rank))).otherwise(F.array(shard_of(rank), shard_of(rank + n)))
    return blocks.select("row", "doc_id", "sid", "size", "block", "words", shards_.alias("shards")), sources


def draws(blocks: DataFrame, seed: int = 17) -> DataFrame:
    """One row a drawn block: ``shard``, ``place`` (its random key within the shard), ``copy`` and the block's columns.

    Sort each shard by ``place``: that shuffle is local to the shard.
    """
    d = blocks.select("row", "doc_id", "sid", "block", "words", F.posexplode("shards").alias("copy", "shard"))
    return d.withColumn("place", F.xxhash64(F.lit(seed), "shard", "doc_id", "block", "copy"))


def per_document(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words of its draws, repeats counted), ``n_draws`` and ``n_shards`` (different ones) of every document.

    All but the sizes and targets come from the draws of the splitting tree.
    """
    d = draws(blocks).groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("n_draws"), F.count_distinct("shard").alias("n_shards")).withColumnRenamed("row", "d_row")
    whole = blocks.where("block = 0").select("row", "doc_id", "sid", "size")
    g = whole.join(d, F.col("row") == F.col("d_row"), "left").join(sources.select(F.col("sid").alias("s_sid"), "source_size", "target"), F.col("sid") == F.col("s_sid"))
    none = F.lit(0).cast("long")
    return g.select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("n_draws", none).alias("n_draws"), F.coalesce("n_shards", none).alias("n_shards"))


def mixed_documents(docs: DataFrame, shards: int = 16, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix as documents: whole ones, in their columns, repeated as often as drawn (same cases as :func:`mix`).

    Copies are drawn by (doc_id, source, size); repeated rows of a document share
    what was drawn for any of them evenly by rank.  Rows come shard by shard, each
    shard in the order of ``place``: one more shuffle, by shard, and a local sort.
    """
    blocks, sources = mix(docs, shards, None, weights, share, cap, seed)
    drawn = F.sort_array(F.collect_list(F.struct("shard", "place", "copy"))).alias("t_draws")
    taken = draws(blocks, seed).groupBy("doc_id", "sid").agg(drawn).join(sources.select("sid", "source"), "sid")
    taken = taken.select(F.col("doc_id").alias("t_doc_id"), F.col("source").alias("t_source"), "t_draws")
    # a document's own columns stay in a struct, so their names can't clash with those needed here; its text is ordered by hash
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").alias("o_doc_id"), F.col("source").cast("string").alias("o_source"), F.xxhash64(F.col("text").cast("string")).alias("o_text"))
    kept = own.join(taken, F.col("o_doc_id").eqNullSafe(F.col("t_doc_id")) & F.col("o_source").eqNullSafe(F.col("t_source")))
    same = Window.partitionBy("o_doc_id", "o_source")
    kept = kept.withColumn("o_rank", F.row_number().over(same.orderBy("o_text")) - 1).withColumn("o_rows", F.count(F.lit(1)).over(same))
    mine = F.filter("t_draws", lambda x, i: i % F.col("o_rows") == F.col("o_rank"))
    kept = kept.select("whole", "o_doc_id", "o_text", F.explode(mine).alias("draw"))
    kept = kept.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place", "o_doc_id", "o_text")
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
