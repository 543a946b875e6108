"""Exact top-k inner products, by distributed histogram selection.

All scores are computed, but none are kept.  Each pass counts, for every query,
the scores in the bins of a histogram over the range that can still hold the
k-th value; the bin with the k-th value is the next pass's range, until it is a
single score.  A last pass emits the scores above it and the smallest ids at it.

Vectors are packed into blocks.  A block of queries meets every block of
vectors by an equi-join on (length, share of the vectors), so both sides
are spread over the cluster and nothing is broadcast.  A task counts a query's
bins from the top and stops at the bin where it alone has k scores: the k-th
value of all is not below that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096
BINS = 1 << 9
#: A task holds the histograms of so many query blocks before it emits them.
HELD_BLOCKS = 8


def as_integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(256 * x) as longs; rows with null or non-finite parts go."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return (
        vectors.where("vec_id is not null and embedding is not null")
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
        .where(F.forall("e", finite))
        .select("vec_id", F.transform("e", lambda x: F.floor(256 * x).cast("long")).alias("v"))
    )


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack (row, vec_id, v) into rows (dim, rows, ids, data) of at most ``size`` vectors of one length, in the narrowest integers that hold them."""

    def pack(batches):
        for batch in batches:
            numbers, ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            for dim in np.unique(lengths):
                where = np.flatnonzero(lengths == dim)
                for at in range(0, len(where), size):
                    part = where[at : at + size]
                    data = flat[starts[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0), np.int64)
                    least, most = int(data.min(initial=0)), int(data.max(initial=0))
                    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)]), *(pa.array([x.tobytes()]) for x in (numbers[part].astype("<i8"), ids[part].astype("<i8"), data.astype(kind)))],
                        names=["dim", "rows", "ids", "data"],
                    )

    return rows.mapInArrow(pack, "dim long, rows binary, ids binary, data binary")


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where no sum can leave its exact range."""
    most = float(np.sqrt((left.astype(float) ** 2).sum(1).max(initial=0) * (right.astype(float) ** 2).sum(1).max(initial=0)))
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def each_score(batches, start: int):
    """(block, low bounds, first query, queries' rows, scores, own, vector ids) of each pair of blocks, by parts."""
    unpack = lambda x: np.frombuffer(x.as_py(), "<i8")

    def vectors(x, n: int, dim: int) -> np.ndarray:
        data = x.as_py()
        return np.frombuffer(data, f"<i{len(data) // (n * dim)}" if dim else "<i8").reshape(n, dim)

    for batch in batches:
        for k in range(batch.num_rows):
            q_ids, c_rows, c_ids = (unpack(batch.column(n)[k]) for n in ("q_ids", "rows", "ids"))
            dim = batch.column("dim")[k].as_py()
            q, c = vectors(batch.column("q_data")[k], len(q_ids), dim), vectors(batch.column("data")[k], len(c_ids), dim)
            low = np.full(len(q_ids), start, np.int64)
            if batch.column("known")[k].is_valid:
                low[np.searchsorted(q_ids, batch.column("known")[k].as_py())] = batch.column("lows")[k].as_py()
            for at in range(0, len(q_ids), 256):
                part = slice(at, at + 256)
                own = q_ids[part, None] == c_rows[None, :]
                yield batch.column("block")[k].as_py(), low[part], at, q_ids, scores(q[part], c), own, c_ids


def count_bins(k: int, start: int, width: int, span: int):
    """Emit (block, query_id, bin, n) of the scores in [low, low + span), in bins of ``width`` (a power of two)."""
    shift = width.bit_length() - 1

    def emit(held):
        out = [[], [], [], []]
        for block, (q_ids, counts) in held.items():
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            rows, bins = np.nonzero((counts > 0) & (above < k))
            for column, x in zip(out, (np.full(len(rows), block), q_ids[rows], bins, counts[rows, bins]), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["block", "query_id", "bin", "n"])

    def run(batches):
        held: dict = {}
        for block, low, at, q_ids, s, own, _ in each_score(batches, start):
            if block not in held:
                if len(held) == HELD_BLOCKS:
                    yield emit(held)
                    held = {}
                held[block] = (q_ids, np.zeros((len(q_ids), BINS), np.int64))
            above = s - low[:, None]
            ok = (above >= 0) & (above < span) & ~own  # passes before have counted what lies above
            flat = ((above >> shift) + np.arange(len(s))[:, None] * BINS)[ok]
            held[block][1][at : at + len(s)] += np.bincount(flat, minlength=len(s) * BINS).reshape(len(s), BINS)
        if held:
            yield emit(held)

    return run


def pick_scores(k: int, start: int):
    """Emit (query_id, vec_id, score) of at most k scores a query and pair of blocks, none below its bound."""

    def run(batches):
        for _, low, at, q_ids, s, own, c_ids in each_score(batches, start):
            rows, cols = np.nonzero((s >= low[:, None]) & ~own)
            best = np.lexsort((c_ids[cols], -s[rows, cols], rows))
            rows, cols = rows[best], cols[best]
            first = (np.arange(len(rows)) - np.searchsorted(rows, rows)) < k
            rows, cols = rows[first], cols[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[at + rows]), pa.array(c_ids[cols]), pa.array(s[rows, cols])], names=["query_id", "vec_id", "score"]
            )

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score).

    Queries are the rows where the Column ``is_query`` holds; each is compared
    with every vector of its length but its own row.  Scores are integer
    inner products of floor(256 * x); ties go to the smaller vec_id.  Vectors
    that are null or hold null, NaN or infinite parts take no part, nor do rows
    without vec_id.  A repeated row is a candidate as often as it stands, also of
    others of its vec_id, and each row of a repeated query has results of its own.
    Scores must fit a long.  ``is_query`` may read vec_id; other columns are ignored,
    whatever their names.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ints = materialise(as_integers(vectors).withColumn("row", F.monotonically_increasing_id()))
    queries = materialise(ints.where(is_query))
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = math.ceil(n_queries / QUERY_BLOCK)
    query_blocks = materialise(
        blocks(queries.repartition(n_blocks, "row").sortWithinPartitions("row"), QUERY_BLOCK)
        .select("dim", F.col("rows").alias("q_ids"), F.col("data").alias("q_data"))
        .withColumn("block", F.monotonically_increasing_id())
    )
    vector_blocks = materialise(blocks(ints, VECTOR_BLOCK))
    shares = min(int(spark.conf.get("spark.sql.shuffle.partitions")), vector_blocks.count())  # of the vectors, for each block of queries
    vector_blocks = vector_blocks.withColumn("share", F.pmod(F.xxhash64("rows"), F.lit(shares)))
    largest = ints.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    start, width = -int(largest) - 1, 1  # no product is farther from zero than the largest square
    while width * BINS < 2 * -start + 1:
        width *= 2
    span = width * BINS

    def pairs(bounds: DataFrame | None) -> DataFrame:
        """Each pair of blocks of one length, with what is known of the queries' k-th values."""
        if bounds is None:
            left = query_blocks.withColumns({c: F.lit(None).cast("array<long>") for c in ("known", "lows")})
        else:
            packed = bounds.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("query_id", "base"))).alias("p"))
            left = query_blocks.join(packed, "block", "left").select(*query_blocks.columns, F.col("p.query_id").alias("known"), F.col("p.base").alias("lows"))
        spread = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        # The planner takes the copies for as small as one file of compressed blocks, so it is told not to broadcast them.
        return spread.hint("merge").join(vector_blocks, ["dim", "share"])

    wanted = None
    while True:
        counted = pairs(wanted).mapInArrow(count_bins(k, start, width, span), "block long, query_id long, bin long, n long")
        totals = counted.groupBy("block", "query_id", "bin").agg(F.sum("n").alias("n"))
        if wanted is None:
            totals = totals.withColumns({"need": F.lit(k).cast("long"), "base": F.lit(start).cast("long")})
        else:
            totals = totals.join(wanted, ["block", "query_id"])
        # A task gives at most k bins a query, so these running sums from the top are short.
        top = Window.partitionBy("block", "query_id").orderBy(F.col("bin").desc())
        enough = F.col("reached") >= F.col("need")
        first = Window.partitionBy("block", "query_id").orderBy(~enough, F.when(enough, -F.col("bin")).otherwise(F.col("bin")))
        wanted = materialise(
            totals.withColumn("reached", F.sum("n").over(top)).withColumn("place", F.row_number().over(first)).where("place = 1")
            .select(
                "block", "query_id", (F.col("base") + F.col("bin") * width).alias("base"),
                F.when(enough, F.col("need") - F.col("reached") + F.col("n")).otherwise(F.col("n")).alias("need"),
            )
        )
        if width == 1:
            break
        span, width = width, max(1, width // BINS)
    picked = pairs(wanted).mapInArrow(pick_scores(k, start), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = picked.withColumn("rank", place).where(F.col("rank") <= k).withColumnRenamed("query_id", "row")
    return ranked.join(queries.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
