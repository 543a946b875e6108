"""Find benchmark items in documents by template windows, with DataFrame operations only.

Texts are canonicalised to templates: numbers, names and units become typed
placeholders, other words lower case.  Windows of five template words are
hashed; the documents' windows meet the benchmark's by an equi-join on the hash.
A window of placeholders alone would meet any table of numbers, so it is hashed by
its raw words; the windows with a plain word cover runs of up to eight placeholders.
Items of three or four words are matched whole: by their raw words, and with two
plain words or more by their template too, so their re-parameterised copies are
found.  Items of one or two words stand in too many texts by chance and are not
searched for; ``unsearchable`` lists them.
A document holds an item if the windows that match cover 0.8 or more of the
item's words, and if its slots are consistent: what stands for one value of
the item's placeholders is one value in the document.  So re-parameterised
copies of a question are found as well as plain ones.  This is judged for each
occurrence by itself (the windows of one alignment, or of alignments up to
``SHIFT`` words off it) and for all places together; one that passes is enough.

The benchmark's windows are broadcast if they are few (``broadcast_windows``,
checked by a count); otherwise the join shuffles.  Only hits go on from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

WINDOW = 5
#: Words of the shortest item that is searched for, and plain ones that a whole template needs.
LEAST_WORDS, LEAST_PLAIN = 3, 2
SIMILARITY = 0.8
#: Alignments that words put in or left out may shift within one occurrence.
SHIFT = 2
# Units that make a placeholder after a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg t lb lbs oz pound pounds ml l liter liters litre litres "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros usd eur cent cents degree degrees mph kmh kb mb gb tb w kw kwh v hz khz mhz ghz"
)
# Marks in canonical texts; control characters, so no word has them.
NAME_MARK, JOIN_MARK = "\u0001", "\u0003"
NUMBER, NAME, UNIT = "0num", "0name", "0unit"
BREAK = rf"[^\p{{L}}\p{{N}}{NAME_MARK}{JOIN_MARK}]+"


def marked(text: Column) -> Column:
    """Lower case, with names marked and the parts of a number joined.

    A name is a capitalised word inside a sentence: after a lower-case letter,
    a digit or a comma and one blank.
    """
    plain = F.regexp_replace(text, f"[{NAME_MARK}{JOIN_MARK}]", " ")
    joined = F.regexp_replace(plain, r"(\p{N})[.,:](?=\p{N})", f"$1{JOIN_MARK}")
    return F.lower(F.regexp_replace(joined, r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}\p{Ll}+)", f"{NAME_MARK}$1"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """The words of a text as they fill the template's places."""
    return words(marked(text))


def template(text: Column) -> Column:
    """The words of a text with placeholders; the same number of words as ``raw_words``."""
    named = F.regexp_replace(marked(text), rf"{NAME_MARK}\p{{L}}+", NAME)
    numbered = F.regexp_replace(named, rf"(?<![\p{{L}}\p{{N}}])\p{{N}}[\p{{N}}{JOIN_MARK}]*(?![\p{{L}}{JOIN_MARK}])", NUMBER)
    units = "|".join(UNITS.split())
    return words(F.regexp_replace(numbered, rf"(?<={NUMBER} )({units})(?![\p{{L}}\p{{N}}])", UNIT))


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def raw_hash(part: Column) -> Column:
    return F.xxhash64(F.lit("raw"), part)


def window_hash(tokens: Column, raw: Column, i: Column) -> Column:
    """The hash of the window that starts at word ``i``, counted from 1."""
    part = F.slice(tokens, i, WINDOW)
    slots = is_slot(F.element_at(tokens, i)) & F.forall(part, is_slot)  # most windows are told by their first word
    return F.when(slots, raw_hash(F.slice(raw, i, WINDOW))).otherwise(F.xxhash64(part))


def window_hashes(tokens: Column, raw: Column) -> Column:
    n = F.size(tokens) - WINDOW + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: window_hash(tokens, raw, i)))


def whole_hash(part: Column) -> Column:
    return F.xxhash64(F.lit("whole"), part)


def short_hashes(tokens: Column, raw: Column, lengths: list[int]) -> Column:
    """(doc_pos, h) of all runs of so many words, hashed as whole items are: by raw words and by template."""

    def runs(k: int) -> Column:
        n = F.size(raw) - k + 1
        spots = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.array(*[F.struct((i - 1).alias("doc_pos"), h.alias("h")) for h in (raw_hash(F.slice(raw, i, k)), whole_hash(F.slice(tokens, i, k)))])))
        return F.when(n > 0, spots).otherwise(F.array().cast("array<struct<doc_pos:int,h:bigint>>"))

    return F.concat(*[runs(k) for k in lengths])


def unsearchable(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_words) of the items that have too few words to be searched for."""
    counted = benchmark.select("item_id", F.size(raw_words(F.coalesce("text", F.lit("")))).alias("n_words"))
    return counted.where(F.col("n_words") < LEAST_WORDS)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_hash, item_pos, h, item_words, slots) of benchmark(item_id, text); slots: (k, value)."""
    rows = (
        benchmark.where("item_id is not null and text is not null")
        .select("item_id", F.xxhash64("text").alias("item_hash"), template(F.col("text")).alias("tokens"), raw_words(F.col("text")).alias("raw"))
        .dropDuplicates(["item_id", "item_hash"])
    )
    spots = rows.select("*", F.size("tokens").alias("item_words"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - WINDOW + 1))).alias("item_pos"))
    part = F.slice("tokens", F.col("item_pos"), WINDOW)
    slots = F.filter(
        F.transform(part, lambda w, k: F.struct(k.alias("k"), is_slot(w).alias("slot"), F.element_at("raw", F.col("item_pos") + k).alias("value"))),
        lambda x: x["slot"],
    )
    plain = F.size(F.filter("tokens", lambda w: ~is_slot(w)))
    short = F.when(plain >= LEAST_PLAIN, F.array(raw_hash(F.col("raw")), whole_hash(F.col("tokens")))).otherwise(F.array(raw_hash(F.col("raw"))))
    hashes = F.when(F.col("item_words") < WINDOW, short).otherwise(F.array(window_hash(F.col("tokens"), F.col("raw"), F.col("item_pos"))))
    return (
        spots.where(F.col("item_words") >= LEAST_WORDS)
        .withColumn("slots", F.transform(slots, lambda x: F.struct(x["k"].alias("k"), x["value"].alias("value"))))
        .withColumn("h", F.explode(hashes))
        .select("item_id", "item_hash", "item_pos", "h", "item_words", "slots")
    )


def covered_words(positions: Column) -> Column:
    """Words covered by windows at the sorted, distinct ``positions``; a short item's one window counts as five."""
    gaps = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


#: What an occurrence of an item is known by.
PLACE = ("doc_id", "text_hash", "item_id", "item_hash", "width", "anchor")


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, broadcast_windows: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, similarity, n_slots, n_conflicts): items that documents hold.

    A row per document text and item.  Items of three or four words are held
    where all their words, or those of their template, stand in a row; shorter ones
    are not searched for.  Null and empty texts hold nothing, long ones are searched
    whole; a null doc_id is kept as it is; repeated rows of one id and text give one
    row.  Of equally full occurrences the first place decides.  Other columns are
    ignored, whatever their names.  Either table may be empty.
    """
    windows = materialise(benchmark_windows(benchmark))
    # A column of its own: inside the windows' lambda the template would be made anew for each.
    short = [r[0] for r in windows.where(F.col("item_words") < WINDOW).select("item_words").distinct().collect()]  # two at most
    tokens = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"), template(F.col("text")).alias("tokens"))
    # Raw words are needed for short items, and where so many placeholders stand that a window may have no other word.
    raw = raw_words(F.col("text"))
    tokens = tokens.withColumn("raw", raw if short else F.when(F.size(F.filter("tokens", is_slot)) >= WINDOW, raw)).drop("text")
    found = tokens.select("doc_id", "text_hash", F.posexplode(window_hashes(F.col("tokens"), F.col("raw"))).alias("doc_pos", "h"))
    if short:
        runs = tokens.select("doc_id", "text_hash", F.explode(short_hashes(F.col("tokens"), F.col("raw"), sorted(short))).alias("run"))
        found = found.unionByName(runs.select("doc_id", "text_hash", "run.doc_pos", "run.h"))
    few = windows.count() <= broadcast_windows
    keys = windows.select("h", "item_id", "item_hash", "item_pos", "item_words", F.size("slots").alias("n_slots"))
    hits = materialise(found.join(F.broadcast(keys) if few else keys, "h"))
    pairs = (
        occurrences(hits).groupBy(*PLACE)
        .agg(F.array_sort(F.collect_set("item_pos")).alias("at"), F.first("item_words").alias("item_words"), F.sum("n_slots").alias("n_slots"))
        # the set has at most as many entries as the item has windows
        .withColumn("similarity", F.least(covered_words(F.col("at")), F.col("item_words")) / F.col("item_words"))
        .where(F.col("similarity") >= similarity)
        .select(*PLACE, F.size("at").alias("n_windows"), "similarity", "n_slots")
    )
    pairs = materialise(pairs)
    if pairs.where("n_slots > 0").isEmpty():
        judged = pairs.withColumn("n_conflicts", F.lit(0).cast("long"))
    else:
        judged = with_conflicts(docs, pairs, hits, windows)
    passed = judged.where(F.col("n_conflicts") <= (1 - similarity) * F.col("n_slots"))
    # all places together go first, then the fullest occurrence
    best = F.min(F.struct("width", (-F.col("similarity")).alias("less"), "n_conflicts", "anchor", "n_windows", "similarity", "n_slots")).alias("best")
    return passed.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(best).select(
        "doc_id", "text_hash", "item_id", *[F.col(f"best.{c}").alias(c) for c in ("n_windows", "similarity", "n_slots", "n_conflicts")]
    )


def occurrences(hits: DataFrame) -> DataFrame:
    """``hits`` in each occurrence they are part of: (width -1) all places, (0) one alignment, (SHIFT) alignments around the anchor."""
    shift = F.col("doc_pos") - F.col("item_pos")
    spots = [(-1, F.lit(0)), (0, shift), *((SHIFT, shift + k) for k in range(-SHIFT, SHIFT + 1))]
    return hits.withColumn("spot", F.explode(F.array(*[F.struct(F.lit(w).alias("width"), a.alias("anchor")) for w, a in spots]))).select("*", "spot.width", "spot.anchor").drop("spot")


def with_conflicts(docs: DataFrame, pairs: DataFrame, hits: DataFrame, windows: DataFrame) -> DataFrame:
    """``pairs`` with the number of distinct item values (n_slots) and those that meet several values (n_conflicts)."""
    slotted = pairs.where("n_slots > 0").select(*PLACE)
    same_doc = F.expr("p.doc_id <=> d.doc_id and p.text_hash = d.text_hash")
    same_place = F.expr(" and ".join(["p.doc_id <=> d.doc_id", *(f"p.{c} = d.{c}" for c in PLACE[1:])]))
    texts = (
        docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("d")
        .join(slotted.select("doc_id", "text_hash").distinct().alias("p"), same_doc, "left_semi")
        .dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", raw_words(F.col("text")).alias("raw"))
    )
    places = (
        occurrences(hits.where("n_slots > 0")).select(*PLACE, "item_pos", "doc_pos").alias("d")
        .join(slotted.alias("p"), same_place, "left_semi")
        .join(windows.select("item_id", "item_hash", "item_pos", F.explode("slots").alias("slot")), ["item_id", "item_hash", "item_pos"])
        .alias("d").join(texts.alias("p"), same_doc)
        .select("d.doc_id", "d.text_hash", "item_id", "item_hash", "width", "anchor", "slot.value", F.get("raw", F.col("doc_pos") + F.col("slot.k")).alias("here"))
    )
    conflicts = (
        places.groupBy(*PLACE, "value").agg(F.min("here").alias("a"), F.max("here").alias("b"))
        .groupBy(*PLACE).agg(F.count("*").alias("values"), F.count_if(F.col("a") != F.col("b")).alias("n_conflicts"))
    )
    joined = pairs.drop("n_slots").alias("d").join(conflicts.alias("p"), same_place, "left")
    return joined.select("d.*", F.coalesce("p.values", F.lit(0)).alias("n_slots"), F.coalesce("p.n_conflicts", F.lit(0)).alias("n_conflicts"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; columns as they are, whatever their names.

    Null and empty texts hold nothing and stay; long texts are searched whole; rows
    without an id and repeated rows are judged by their text.  Either table may be empty.
    """
    (mark,) = fresh(docs, "text_hash")
    bad = materialise(find_contamination(docs, benchmark, similarity).select("doc_id", "text_hash").distinct())
    keyed = docs.withColumn(mark, F.xxhash64("text")).alias("d")
    return keyed.join(bad.alias("b"), F.expr(f"d.doc_id <=> b.doc_id and d.{mark} = b.text_hash"), "left_anti").drop(mark)
