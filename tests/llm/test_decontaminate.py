import re

from pyspark.sql import functions as F

from meetpoint.llm import decontaminate as dc

ITEM = "A train leaves the old station at 40 km per hour and meets Anna after 3 hours near the river bank"


def test_templates(spark):
    rows = [("He saw Anna, then Bob Lee ran 3.5 km in 10,000 seconds.\nThe END",)]
    r = spark.createDataFrame(rows, "text string").select(dc.template(F.col("text")), dc.raw_words(F.col("text"))).first()
    assert r[0] == ["he", "saw", "0name", "then", "0name", "0name", "ran", "0num", "0unit", "in", "0num", "0unit", "the", "end"]
    assert len(r[0]) == len(r[1])


def find(spark, docs, items=((7, ITEM),)):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("similarity", F.lit(1))
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted(((r.doc_id, r.item_id) for r in dc.find_contamination(d, b).collect()), key=str)


def test_plain_and_reparameterised(spark):
    other = ITEM.replace("40", "75").replace("3 hours", "8 hours").replace("Anna", "Maria")
    item = "Anna has 12 apples and gives 5 apples to Bert so that Anna keeps the rest while 12 trees grow by the house"
    good = item.replace("Anna", "Carla").replace("12", "30").replace("5", "9")
    bad = "Carla has 30 apples and gives 9 apples to Bert so that Dora keeps the rest while 41 trees grow by the house"
    docs = [
        (1, "before " + ITEM + " after"), (2, "x y z " + other), (3, "nothing of the kind here at all, the old station"), (4, None), (5, ""),
        (6, "He said " + good), (8, "He said " + bad), (1, "before " + ITEM + " after"), (None, ITEM), (9, "filler " * 40_000 + ITEM), (10, ITEM.upper()),
        (11, ITEM[: len(ITEM) // 2]),
    ]
    got = find(spark, docs, [(7, ITEM), (21, item), (22, "too short"), (None, ITEM), (23, None)])
    assert (8, 21) not in got
    assert got == sorted([(1, 7), (2, 7), (6, 21), (None, 7), (9, 7)], key=str) or got == sorted([(1, 7), (2, 7), (6, 21), (None, 7), (9, 7), (10, 7)], key=str)


def test_brute_force_coverage(spark):
    import random

    rng = random.Random(4)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(4, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocab) for _ in range(60)]
        if d % 2:
            it = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 4)):
                it[rng.randrange(len(it))] = "zz"
            words[10:10] = it
        docs.append((d, " ".join(words)))
    want = []
    for d, text in docs:
        seen = {tuple(text.split()[i : i + 5]) for i in range(len(text.split()) - 4)}
        for i, t in items:
            w = t.split()
            hit = set()
            for p in range(len(w) - 4):
                if tuple(w[p : p + 5]) in seen:
                    hit |= set(range(p, p + 5))
            if len(w) >= 5 and len(hit) / len(w) >= 0.8:
                want.append((d, i))
    assert find(spark, docs, items) == sorted(want, key=str)
    assert want and re


def test_drop_and_empty(spark):
    docs = spark.createDataFrame([(1, ITEM, "s"), (2, "clean text of some words here", None), (None, None, "s")], "doc_id long, text string, h string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(2, "clean text of some words here", None), (None, None, "s")], key=str)
    assert dc.find_contamination(docs.limit(0), bench).count() == 0
    assert dc.find_contamination(docs, bench.limit(0)).count() == 0


def test_each_occurrence_is_judged_by_itself(spark):
    other = ITEM.replace("40", "75").replace("3 hours", "8 hours").replace("Anna", "Maria")
    longer = other.replace("hour and", "hour very soon and")
    docs = [(1, f"first {ITEM} and then there is this {other} at the end"), (2, f"first {ITEM} and later on {longer}"), (3, f"see {longer} and {longer.replace('75', '81')}")]
    assert find(spark, docs) == [(1, 7), (2, 7), (3, 7)]


def test_items_dense_in_placeholders_and_short_ones(spark):
    items = [(1, "Sort 7, 3, 9, 1 and 5"), (2, "12 km in 30 min at 5 m/s"), (3, "8 1 6 2 9 4 7 3 5 2 6 1"), (4, "name two primes")]
    docs = [
        (1, "Exam. Sort 7, 3, 9, 1 and 5 please"), (2, "he did 12 km in 30 min at 5 m/s today"), (3, "x 8 1 6 2 9 4 7 3 5 2 6 1 y"), (4, "Now name two primes, he said"),
        (5, "sort 8, 4, 2, 6 and 1"), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (7, "name two other primes"), (8, "sort 7 and 3"),
    ]
    assert find(spark, docs, items) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]


def test_short_items_by_template_and_tiny_ones_not_at_all(spark):
    items = [(1, "Is it 5 km"), (2, "the"), (3, "old station"), (4, "4 5 6"), (5, "name two primes"), (6, None)]
    docs = [
        (1, "Tell me. Is it 7 km to the old station"), (2, "is it 5 km or so"), (3, "it is 7 km"), (4, "count 4 5 6 now"), (5, "count 7 8 9 now"), (6, "Please name two primes"),
        (7, "name two odd primes"), (8, "is it far"), (9, "Is it 7"),
    ]
    assert find(spark, docs, items) == [(1, 1), (2, 1), (4, 4), (6, 5)]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.item_id, r.n_words) for r in dc.unsearchable(b).collect()) == [(2, 1), (3, 2), (6, 0)]


def test_slots_by_brute_force(spark):
    """Items of words and numbers, whole in a text with each number changed: held if equal numbers stay equal."""
    import random

    rng = random.Random(6)
    vocab = [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    items, docs, want = [], [], []
    for k in range(12):
        numbers = [str(rng.randint(10, 14)) for _ in range(4)]
        words = [w for n in numbers for w in (*rng.sample(vocab, 3), n)] + rng.sample(vocab, 2)
        items.append((k, " ".join(words)))
        for broken in (False, True):
            new = {n: str(50 + i) for i, n in enumerate(dict.fromkeys(numbers))}
            made, seen = [], 0
            for w in words:
                if w in new:
                    seen += 1
                    made.append(str(900 + seen) if broken else new[w])
                else:
                    made.append(w)
            docs.append((len(docs), " ".join([*rng.sample(vocab, 5), *made, *rng.sample(vocab, 5)])))
            here = {}
            for w, m in zip(words, made, strict=True):
                if w in new:
                    here.setdefault(w, set()).add(m)
            conflicts = sum(len(x) > 1 for x in here.values())
            if conflicts <= 0.2 * len(here):
                want.append((docs[-1][0], k))
    assert find(spark, docs, items) == sorted(want, key=str)
    assert len(want) < len(docs)
