from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from meetpoint.llm import golay, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints):
    """prints: list of (doc_id, fp) -> list of (doc_id, fp, component)."""
    label = [d for d, _ in prints]
    changed = True
    while changed:
        changed = False
        for (i, (_, x)), (j, (_, y)) in combinations(enumerate(prints), 2):
            if (x ^ y).bit_count() <= 4 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return sorted((d, x, c) for (d, x), c in zip(prints, label, strict=True))


def test_golay_decodes_up_to_three_errors():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 1 << 12, 500)
    code = np.array([(int(x) << 11) | golay.remainder(int(x) << 11) for x in m])
    for n in range(4):
        noise = np.array([sum(1 << int(b) for b in rng.choice(23, n, replace=False)) for _ in m], dtype=np.int64)
        assert (golay.decode(code ^ noise) == m).all()


def test_words_one_bit_apart_share_a_key():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 22, 300)
    rows, found = golay.nearby(words, 22)
    assert np.bincount(rows).max() <= 6
    for k, w in enumerate(words):
        near = set(found[rows == k].tolist())
        assert all(int(golay.decode(np.array([w ^ (1 << b)]))[0]) in near for b in range(22))


def test_fingerprint_equals_plain_form():
    for text in (None, "", "  \n", "one", "Ünï two\x0bTHREE", "a b c d", "a b c d e a b c d e", "é " * 9000, "x y z w v"):
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_all_pairs_within_four_bits_meet():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in base], dtype=np.uint64)
    rows, keys, sides = simhash.segment_keys(np.concatenate((base, base ^ noise)))
    for k in range(400):
        a, b = ({(int(x), int(s)) for x, s in zip(keys[rows == r], sides[rows == r], strict=True)} for r in (k, k + 400))
        assert any((x, 2) in b if s == 2 else (x, 1 - s) in b for x, s in a)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(4)
    prints = []
    for group in range(30):  # chains, stars, and a crowd around few bits
        x = int(rng.integers(0, 1 << 63))
        for _ in range(40 if group == 0 else 6):
            prints.append(x)
            x ^= sum(1 << int(b) for b in rng.choice(64, 4 if group % 2 else 2, replace=False))
    prints += [prints[0]] * 5 + [0, 0, 15, (1 << 64) - 1]
    rows = [(int(i) * 7 % 1009, x) for i, x in enumerate(prints)]
    signed = [(d, x - (1 << 64) if x >> 63 else x) for d, x in rows]
    groups = spark.createDataFrame(signed, "doc_id long, fp long").repartition(5)
    distinct = groups.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    member = simhash.connected_components(simhash.fingerprint_links(distinct))
    label = {r.node: r.component for r in member.collect()}
    by = {}
    for d, x in signed:
        by.setdefault(label.get(x, x), []).append(d)
    got = sorted((d, x, min(by[label.get(s, s)])) for (d, x), (_, s) in zip(rows, signed, strict=True))
    assert got == plain_components(rows)


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t", None), (4, long, "x"), (4, long, "x"), (None, "a b c d e", "x"), (9, "a b c d e", "x"), (None, "only null id here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 9), (9, 9), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
