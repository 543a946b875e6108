"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into two halves, and each half has a codebook of its own.
A vector lies in the cell of its two nearest codewords, so the codebooks' product
makes a fine grid of few codewords.  To find a vector's neighbours, a
multi-sequence traversal visits cells by the sum of two bounds, one for each half:
how far the half would have to move, at least, to be nearest to the other
codeword.  It stops where the target recall is reached.  Vectors in the cells
visited are verified by their cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, small_batches
from .components import connected_components

#: Codewords of a half: so many at most.
MOST_CODES = 512


def units(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of length one, in double precision, filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # else squares may leave the doubles' range
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1))


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; a codeword that loses all its points starts again at one of them."""
    codes = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        nearest = squared(x, codes).argmin(axis=1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, x)
        codes = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return codes


class MultiIndex:
    """Two codebooks over halves of ``width`` numbers, and how far a traversal goes."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        rng = np.random.default_rng(0)
        self.half = (sample.shape[1] + 1) // 2
        self.codes = [codebook(x, k, rng) for x in self.halves(sample)]
        self.gaps = [np.sqrt(squared(c, c)) for c in self.codes]
        self.reach = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12  # the squared distance of the farthest pairs: no link is missed
        if recall < 1:
            self.reach = min(self.reach, np.quantile(self.needed(sample, threshold, rng), recall))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def needed(self, sample: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
        """How far to go from each vector to the cell of another just at the threshold, in a random direction."""
        aside = rng.standard_normal(sample.shape)
        aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
        aside /= np.maximum(1e-300, np.sqrt((aside * aside).sum(axis=1, keepdims=True)))
        _, bounds = self.bounds(sample)
        cells, _ = self.bounds(threshold * sample + np.sqrt(1 - threshold**2) * aside)
        row = np.arange(len(sample))
        return bounds[0][row, cells[0]] + bounds[1][row, cells[1]]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the nearest codewords, and the squared distances to the middle between these and any other."""
        nearest, bounds = [], []
        for part, codes, gaps in zip(self.halves(x), self.codes, self.gaps, strict=True):
            d = squared(part, codes)
            at = d.argmin(axis=1)
            gap = gaps[at]
            b = np.where(gap > 0, (d - d.min(axis=1, keepdims=True)) / (2 * np.where(gap > 0, gap, 1)), 0)
            nearest.append(at)
            bounds.append(b * b)
        return nearest, bounds

    def traverse(self, bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells within reach, the nearest first.

        Each half's codewords are sorted by bound.  For every codeword of the first
        half a pointer says which of the second comes next; the smallest sum is
        visited and its pointer moves on.
        """
        n, k = bounds[0].shape
        orders = [b.argsort(axis=1, kind="stable") for b in bounds]
        first, second = (np.take_along_axis(b, o, axis=1) for b, o in zip(bounds, orders, strict=True))
        second = np.concatenate((second, np.full((n, 1), np.inf)), axis=1)
        pointer, sums = np.zeros((n, k), np.int64), first + second[:, :1]
        rows, cells, active = [], [], np.arange(n)
        while len(active):
            at = sums[active].argmin(axis=1)
            near = sums[active, at] <= self.reach
            active, at = active[near], at[near]
            to = pointer[active, at]
            rows.append(active)
            cells.append(orders[0][active, at] * k + orders[1][active, to])
            pointer[active, at] = to + 1
            sums[active, at] = first[active, at] + second[active, to + 1]
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(cells) if cells else np.zeros(0, np.int64)


def forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of links between rows and columns, as few as keep whatever is joined together."""
    rows_left, cols_left = close.any(axis=1), np.ones(close.shape[1], bool)
    links = [(np.zeros(0, np.int64),) * 2]
    while rows_left.any():
        frontier = [int(rows_left.argmax())]
        rows_left[frontier[0]] = False
        while frontier:
            r = frontier.pop()
            cols = np.flatnonzero(close[r] & cols_left)
            cols_left[cols] = False
            links.append((np.full(len(cols), r), cols))
            for c in cols:
                more = np.flatnonzero(close[:, c] & rows_left)
                rows_left[more] = False
                links.append((more, np.full(len(more), c)))
                frontier.extend(more.tolist())
    return tuple(np.concatenate(x) for x in zip(*links, strict=True))


def comparable(embedding: Column, label: Column) -> Column:
    """Whether a vector takes part: it has a label, a number other than zero, and no null or non-finite one."""
    unfit = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & ~unfit & F.exists(embedding, lambda x: x != 0), F.lit(False))


def link_vectors(
    vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, sample: int = 20_000, population: int = 20, block: int = 1024
) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), a row per row.

    Vectors with equal labels and lengths are linked if their cosine is
    ``threshold`` or more; links never cross labels.  ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest vec_id that links reach,
    and ``kept`` says whether that is the row's own.

    ``recall`` is the share of pairs just at the threshold that the traversal is
    to meet, by the codebooks' fit on about ``sample`` vectors; closer pairs are
    met more often, and 1 misses none.  A pair counts on both sides or on neither.
    A cell of a label has some ``population`` vectors; one with over ``block``
    vectors or visits is dealt to several tasks, each pair of blocks to one.

    Null, empty and zero vectors, those with null or non-finite numbers, and
    those without label have no links.  Equal vectors are compared once and
    counted with their number.  Rows with one vec_id are rows like others; a null
    vec_id takes part and never names a component that has another.  Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    c = F.col
    rows = vectors.select(c("vec_id").cast("long"), "embedding", "label")
    ok = comparable(c("embedding"), c("label"))
    digests = [F.when(c("ok"), F.xxhash64(F.lit(k), "embedding")).alias(f"d{k}") for k in (1, 2)]
    rows = rows.withColumn("ok", ok).select("vec_id", "label", "embedding", F.size("embedding").alias("size"), *digests)
    narrow = materialise(rows.drop("embedding"))
    copies = rows.where("d1 is not null").groupBy("label", "size", "d1", "d2").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = materialise(copies.withColumn("node", F.monotonically_increasing_id()))

    sizes = classes.groupBy("label", "size").agg(F.count("*").cast("double").alias("m")).agg(F.sum("m"), F.sum(F.expr("m * m")), F.max("size")).first()
    if not sizes[0]:
        return narrow.select("vec_id", F.lit(0).cast("long").alias("n_links"), c("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = sizes[2]
    k = int(min(MOST_CODES, max(1, np.ceil(np.sqrt(sizes[1] / sizes[0] / population)))))
    part = min(1.0, sample / sizes[0])
    drawn = classes.where(F.pmod("d1", F.lit(1 << 20)) < int(np.ceil(part * (1 << 20)))).select("embedding").toArrow()
    index = MultiIndex(units(drawn.column("embedding"), width), k, threshold, recall)

    found = materialise(verified(classes, index, width, threshold, block))
    links = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(c("a").alias("node")).agg(F.sum("links").alias("links"))
    named = links.join(classes.select("node", "smallest"), "node")
    lowest = named.groupBy("component").agg(F.min("smallest").alias("lowest"))
    linked = named.join(lowest, "component").select("node", "lowest")
    told = classes.join(counts, "node", "left").join(linked, "node", "left").select(
        *[c(x).alias(f"_{x}") for x in ("label", "size", "d1", "d2")],
        (c("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("lowest", "smallest").alias("lowest"),
    )
    told = materialise(told)
    same = [c(x) == c(f"_{x}") for x in ("label", "size", "d1", "d2")]
    component = F.when(c("_d1").isNull(), c("vec_id")).otherwise(c("lowest"))
    return narrow.join(told, same, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), c("vec_id").eqNullSafe(component).alias("kept")
    )


def verified(classes: DataFrame, index: MultiIndex, width: int, threshold: float, block: int) -> DataFrame:
    """(a, b, links): links between nodes that keep components whole, and, with b null, numbers of linked rows of a."""
    label = dict(classes.dtypes)["label"]

    def visits(batch):
        near, bounds = index.bounds(units(batch.column("embedding"), width))
        k = len(index.codes[0])
        rows, cells = index.traverse(bounds)
        n = batch.num_rows
        return np.concatenate((np.arange(n), rows)), np.concatenate((near[0] * k + near[1], cells)), np.repeat([0, 1], [n, len(rows)]).astype(np.int8)

    def dealt(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, cell, side = visits(batch)
                out = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(side)], names=[*out.schema.names, "cell", "side"])

    def tallied(batches):
        for batch in batches:
            row, cell, side = visits(batch)
            (pairs, counts), labels = np.unique(np.stack((row, cell, side)), axis=1, return_counts=True), batch.column("label")
            yield pa.RecordBatch.from_arrays(
                [labels.take(pa.array(pairs[0])), batch.column("size").take(pa.array(pairs[0])), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int8)), pa.array(counts)],
                names=["label", "size", "cell", "side", "rows"],
            )

    narrow = small_batches(classes).select("label", "size", "node", "n", "embedding")
    tally = narrow.select("label", "size", "embedding").mapInArrow(tallied, f"label {label}, size int, cell long, side byte, rows long")
    parts = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, F.col("rows")).otherwise(0)) / block)
    crowded = materialise(tally.groupBy("label", "size", "cell").agg(parts(0).alias("stays"), parts(1).alias("visits")).where("stays > 1 or visits > 1"))
    a, b, d = fresh(narrow, "l", "s", "x")
    crowded = crowded.toDF(a, b, d, "stays", "visits")

    both = narrow.mapInArrow(dealt, f"label {label}, size int, node long, n long, embedding {dict(classes.dtypes)['embedding']}, cell long, side byte")
    both = both.join(crowded, [F.col("label") == F.col(a), F.col("size") == F.col(b), F.col("cell") == F.col(d)], "left")
    stays, visits_ = (F.coalesce(x, F.lit(1)).cast("long") for x in ("stays", "visits"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, stays).otherwise(visits_))
    both = both.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, visits_).otherwise(stays) - 1)))
    key = [F.col(x) for x in ("label", "size", "cell")] + [F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other")).alias("p"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine")).alias("q")]
    keyed = both.select(*key, "side", "node", "n", "embedding")

    def meet(table: pa.Table) -> pa.Table:
        side, node, n = (table.column(x).to_numpy() for x in ("side", "node", "n"))
        x = units(table.column("embedding"), width)
        u, v = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        cosine = x[u] @ x[v].T
        i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)  # the same sum from either side decides
        cosine[i, j] = (x[u[i]] * x[v[j]]).sum(axis=1)
        close = (cosine >= threshold) & (node[u][:, None] < node[v])
        into, out = close @ n[v], close.T @ n[u]
        r, s = forest(close)
        a = np.concatenate((node[u[r]], node[u[into > 0]], node[v[out > 0]]))
        links = np.concatenate((np.zeros(len(r), np.int64), into[into > 0], out[out > 0]))
        b = np.concatenate((node[v[s]], np.zeros(len(a) - len(r), np.int64)))
        return pa.table({"a": a, "b": pa.array(b, mask=np.arange(len(a)) >= len(r)), "links": links})

    return keyed.groupBy("label", "size", "cell", "p", "q").applyInArrow(meet, "a long, b long, links long")
