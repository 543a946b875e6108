"""Mix sources to target weights, with DataFrame operations only.

Every document gets a hash-random key, made of its id and text.  Within its source
the documents are range-partitioned by that key into buckets of bounded expected
size, sorted inside each bucket, and prefix sums of their word counts are put
together from the buckets' sums and the running sums inside them.  Each source is
then cut where the prefix sum reaches its budget; budgets beyond a source's size
repeat it for whole epochs first.

Only narrow rows (source, key, size) are shuffled, repeated rows as one; texts never
move.  The cut of a source is one row, so documents are compared with it in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (5, 2, 1)


def random_key(seed: str) -> Column:
    """60 bits of the md5 of seed, doc_id and text, as a long: the same in every run, and for repeated rows alone the same."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1])), 1, 15), 16, 10).cast("long")


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def numbered(parts: DataFrame, name: str, order: tuple[Column, ...] = (), by: str | None = None) -> DataFrame:
    """Rows of ``parts`` numbered from 0 by partition and, inside each, by ``order``; with ``by``, for each of its values anew.

    Rows are counted per partition and numbered inside each, so no group goes
    through one task, only its partitions' counts.
    """
    value = F.col(by) if by else F.lit(0)
    kept = materialise(parts.withColumns({"__part": F.spark_partition_id(), "__by": value}))
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("__by", "__part").count().select(F.col("__by").alias("__b"), F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__by", "__part").orderBy(*order or (F.lit(0),))) - 1
    return (
        kept.withColumn(name, inside).join(offsets, F.expr("__part = __p and __by <=> __b"))
        .withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__by", "__p", "__b", "__before")
    )


def source_targets(sources: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """sources(source, source_size, ...) with its weight and target.

    Sources are ranked by code point, null last, and take the weights in turn.
    Targets share ``share`` times all sizes by weight; a target above ``cap``
    times its source's size stops there and the excess is shared again.  With
    level L, targets are min(weight * L, cap * size); every round of sharing is
    one aggregate that gives the next L, so no source leaves the executors.

    The rank takes a range partitioning of the distinct sources.
    """
    order = (F.col("source").isNull(), F.col("source"))
    ranked = materialise(
        numbered(sources.repartitionByRange(*order), "rank", order)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
    )
    level, stopped = 0.0, -1
    while True:
        stops = F.col("most") < F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(stops, F.col("most"))).alias("fixed"),
            F.sum(F.when(~stops, F.col("weight"))).alias("weight"),
            F.count_if(stops).alias("stopped"),
        ).first()
        if row["total"] is None or row["weight"] is None or row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        level = (share * row["total"] - (row["fixed"] or 0.0)) / row["weight"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))).drop("most")


def source_cuts(sized: DataFrame, share: float, cap: float, weights, bucket_rows: int) -> DataFrame:
    """One row per source: size, target, whole epochs, and the key at which the rest is cut."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = materialise(
        source_targets(sources, share, cap, weights)
        .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.col("n_docs") / bucket_rows).cast("long"))
    )
    # Repeated rows share a key and a size; they form one unit of the order.
    units = (
        sized.groupBy("source", "key").agg(F.sum("size").alias("unit"), F.count("*").alias("rows"))
        .join(plan.select(F.col("source").alias("s"), "buckets", "rest"), F.expr("source <=> s")).drop("s")
        .withColumn("bucket", F.expr(f"key div ({1 << 60} div buckets + 1)"))
    )
    so_far = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(*so_far)
    sums = units.groupBy("source", "bucket").agg(F.sum("unit").alias("n")).withColumn("block", F.expr("bucket div 1024"))
    blocks = sums.groupBy("source", "block").agg(F.sum("n").alias("n"))
    over_blocks = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(*so_far)), F.lit(0))
    in_block = F.coalesce(F.sum("n").over(Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(*so_far)), F.lit(0))
    first = blocks.select(F.col("source").alias("bs"), F.col("block").alias("bb"), over_blocks.alias("before"))
    offsets = (
        sums.withColumn("within", in_block).join(first, F.expr("source <=> bs and block = bb"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("before") + F.col("within")).alias("offset"))
    )
    cut = (
        units.withColumn("running", F.coalesce(F.sum("unit").over(inside), F.lit(0)))
        .join(offsets, F.expr("source <=> s and bucket = b"))
        .withColumn("prefix", F.col("offset") + F.col("running"))
        .where((F.col("prefix") <= F.col("rest")) & (F.col("rest") < F.col("prefix") + F.col("unit")))
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("rows").alias("cut_rows"), (F.col("rest") - F.col("prefix")).alias("cut_words"))
    )
    return plan.join(cut, F.expr("source <=> s"), "left").select(
        "source", "source_size", "weight", "target", "epochs", "cut_key", "cut_rows", "cut_words"
    )


ADDED = ("size", "source_size", "weight", "target", "taken", "epochs")


def mix_sources(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: str = "mix", bucket_rows: int = 1024
) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, weight, target, taken, epochs.

    ``taken`` is the number of the document's words in the mix, repeats counted:
    whole epochs, one more for documents before the cut, and the first words of
    the document at the cut, so that a source's words meet its budget exactly.

    Null and empty texts have size 0; long texts are counted whole.  A null source is
    a source of its own, ranked last.  Missing ids and one id on several texts make no
    difference, as the text is part of the key; repeated rows at the cut take their
    words one after the other.  An empty table gives an empty result.  Columns of the
    input with the names added here are replaced, all others stay, whatever their names.
    """
    names = [c for c in docs.columns if c.lower() not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "source", random_key(seed).alias("key"), word_count().alias("size"))
    cuts = materialise(source_cuts(materialise(rows.select("source", "key", "size")), share, cap, weights, bucket_rows)).withColumnRenamed("source", "s")
    joined = rows.join(cuts, F.expr("source <=> s"), "left")
    at_cut = F.coalesce(F.col("key") == F.col("cut_key"), F.lit(False))
    repeated = F.coalesce(F.col("cut_rows") > 1, F.lit(False)) & at_cut
    cut_part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(at_cut, F.col("cut_words"))

    def finish(df: DataFrame, once_more: Column) -> DataFrame:
        taken = F.col("epochs") * F.col("size") + F.coalesce(once_more, F.lit(0))
        return df.withColumn("taken", taken).select("row.*", *ADDED)

    if cuts.where("cut_rows > 1").isEmpty():
        return finish(joined, cut_part)
    # Equal rows at a cut cannot be told apart by their values, so they are numbered where they lie.
    placed = numbered(joined.where(repeated), "place", by="source")
    share_of_row = F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut_words") - F.col("place") * F.col("size")))
    return finish(joined.where(~repeated), cut_part).unionByName(finish(placed, share_of_row))
