import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from meetpoint.llm import suffix_tree as st


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def plain(rows):
    train = [lower(t) for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 10]
    c = Counter(w for ws in train for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        tokens = [*lower(t), None]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((d, zlib.crc32(str("" if d is None else d).encode()) % 10 == 0, len(tokens), sum(c[w] > 0 for w in tokens), n, base))
    return out


def sample_rows():
    rng = random.Random(8)
    words = ["the", "a", "Wort", "été", "x" * 40, "12,5", "\x01odd", "日本"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 50)))) for i in range(80)]
    return rows + [(80, None), (81, ""), (82, " \t\x0b"), (83, "unseen " * 30_000), (None, "the a the"), (3, rows[3][1])]


@pytest.mark.parametrize("common", [0, 10, 1000])
def test_base_part(spark, common, monkeypatch):
    monkeypatch.setattr(st, "HELD_WORDS", 10)
    monkeypatch.setattr(st, "PART_TOKENS", 100)
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in st.score_texts(docs, most_common=common).collect()), key=str)
    want = sorted(plain(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert g[6] < 0 and math.isfinite(g[6])


def plain_scores(rows, least, longest, evidence):
    """log10 probability of each text, a function (context, next symbol) -> probability, and the tree, by loops over dictionaries."""
    train = [lower(t) for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 10]
    c = Counter(w for ws in train for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    counts = {}
    for ws in train:
        s = [None, *ws, None]
        for i in range(1, len(s)):
            for d in range(1, min(i, longest) + 1):
                counts.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    kept = set()

    def p(context, w):
        if not context:
            return (c[w] + 0.1) / (n + 0.1 * (v + 1))
        if context not in kept:
            return p(context[1:], w)
        own, size = counts[context], sum(counts[context].values())
        left = sum(0.75 if m > 1 else 1 for m in own.values()) / size
        return (own[w] - 0.75 if own[w] > 1 else 0) / size + left * p(context[1:], w)

    for context in sorted(counts, key=len):
        own, size = counts[context], sum(counts[context].values())
        often = {w: m for w, m in own.items() if m > 1}
        if size < least or (len(context) > 1 and context[1:] not in kept) or not often:
            continue
        rest = size - sum(often.values())
        ratio = sum(m * math.log(m / size / p(context[1:], w)) for w, m in often.items())
        if rest:
            ratio += rest * math.log(rest / size / (1 - sum(p(context[1:], w) for w in often)))
        if 2 * ratio > evidence * (len(often) + (rest > 0)):
            kept.add(context)
    out = []
    for _, t in rows:
        s = [None, *lower(t), None]
        out.append(sum(math.log10(p(tuple(s[:i]), s[i])) for i in range(1, len(s))))
    return out, p, kept, [*c]


@pytest.mark.parametrize(("common", "least", "longest"), [(0, 8, 9), (40, 8, 2), (10_000, 3, 4)])
def test_scores_are_those_of_the_tree(spark, common, least, longest, monkeypatch):
    monkeypatch.setattr(st, "HELD_TOKENS", 50)
    monkeypatch.setattr(st, "SLICE_TOKENS", 300)  # several slices, with contexts that are split
    monkeypatch.setattr(st, "PART_TOKENS", 100)
    rng = random.Random(3)
    phrases = ["the cat sat on the mat", "a dog sat on a log", "été à la mer", "on the sea", "so on", "x on the y on the z", "z on the y on the x"] + [f"x{i}" for i in range(9)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 15)))) for i in range(150)] + [(200, None), (201, "never seen"), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored = st.score_texts(docs, least=least, longest=longest, most_common=common).collect()
    got = {r.doc_id: r.score for r in scored}
    want, p, kept, symbols = plain_scores(rows, least, longest, 2.0)
    assert {len(k) for k in kept} >= {1, 2, min(3, longest)}
    unseen = 0.1 / (len(symbols) * 0.1 + 0.1 + next(r.train_tokens for r in scored))
    for context in [*kept, ("never", "kept")]:
        assert sum(p(context, w) for w in symbols) <= 1 + 1e-9
        assert sum(p(context, w) for w in symbols) + unseen >= 1 - 1e-9
    for (d, _), x in zip(rows, want, strict=True):
        assert math.isclose(got[d], x, rel_tol=1e-6), d
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_a_context_counts_all_its_uses_or_none(spark):
    """Contexts whose prefix is not retained are counted all the same."""
    rows = [(i, "q r s t" if i % 2 else "u v s w") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in st.score_texts(docs).collect()}
    for (d, _), x in zip(rows, plain_scores(rows, 16, 4, 2.0)[0], strict=True):
        assert math.isclose(got[d], x, rel_tol=1e-6)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert st.score_texts(docs).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {r.train_tokens for r in st.score_texts(only_held).collect()} == {0}


@pytest.mark.parametrize("coded", [0, 6])
def test_words_without_codes(spark, coded, monkeypatch):
    monkeypatch.setattr(st, "MOST_CODED", coded)
    monkeypatch.setattr(st, "HELD_PAIRS", 50)
    monkeypatch.setattr(st, "SLICE_TOKENS", 300)
    monkeypatch.setattr(st, "LOOKUP_TOKENS", 300)
    rng = random.Random(5)
    phrases = ["the cat sat on the mat", "a dog sat on a log", "on the sea", "so on"] + [f"x{i}" for i in range(9)] + [f"y{i} z" for i in range(300)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 15)))) for i in range(150)] + [(200, None), (201, "never seen"), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored = {r.doc_id: r for r in st.score_texts(docs, least=8, longest=3, most_common=20).collect()}
    for (d, _), x in zip(rows, plain_scores(rows, 8, 3, 2.0)[0], strict=True):
        assert math.isclose(scored[d].score, x, rel_tol=1e-6), d
    for d, _, n, known, _, base in plain(rows):
        assert scored[d][2:4] == (n, known) and math.isclose(scored[d].base_score, base, rel_tol=1e-9)


def test_pairs_of_common_words_are_short():
    """A pair takes under 5 bytes on its way to its slice; its hash and count took 12."""
    rng = np.random.default_rng(1)
    codes = st.Codes(rng.integers(0, 1 << 63, 50_000).astype(np.uint64), np.arange(50_000, 0, -1) * 10)
    pairs = (rng.zipf(1.3, 300_000) % 50_000) << st.CODE_BITS | rng.zipf(1.2, 300_000) % 50_000
    packed = pa.Table.from_batches([st.packed_pairs(x, np.arange(50_000) < 3, 4) for x in np.split(pairs, 3)])
    size = sum(len(x) for c in ("kinds", "keys", "n") for x in packed.column(c).to_pylist())
    assert size < 5 * sum(len(np.unique(x)) for x in np.split(pairs, 3))
    found = pa.concat_tables(st.merged_pairs(packed.filter(pa.compute.equal(packed.column("slice"), k)), codes, 1e6) for k in set(packed.column("slice").to_pylist()))
    pair, n = np.unique(pairs, return_counts=True)
    assert sorted(found.column("n").to_pylist()) == sorted(n[n > 1])
    context = st.mixed(np.zeros(len(pair), np.uint64), codes.word[pair >> st.CODE_BITS])
    keys = codes.word[pair & (st.MOST_CODED - 1)] ^ context
    assert dict(zip(found.column("key").to_numpy().view(np.uint64), found.column("n").to_pylist())) == dict(zip(keys[n > 1], n[n > 1]))
