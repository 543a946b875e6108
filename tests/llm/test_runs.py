import hashlib
import zlib

import numpy as np
import pytest

from meetpoint.llm import runs
from meetpoint.llm.queries import op11_runs


def brute(words, least_length=6, least_exponent=4):
    """Runs by comparing all words at each distance; a stretch counts under its smallest period."""
    n, found, covered = len(words), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and (length := j + q - i) >= 2 * q:
                multiple = any(q % p == 0 and all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
                if not multiple and length >= max(least_length, least_exponent * q):
                    found.append((i, length, q))
            i = max(i + 1, j)
    return sorted(found)


def collapse(words, found):
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in dropped]


def test_all_squares_of_short_words():
    rng = np.random.default_rng(1)
    for _ in range(600):
        n, letters = int(rng.integers(0, 40)), int(rng.integers(1, 4))
        words = rng.integers(0, letters, n).tolist()
        assert [(s, m, q) for s, m, q in runs.repetitions(words, 2, 2)] == brute(words, 2, 2), words


@pytest.mark.parametrize("letters", [2, 3, 8, 50])
def test_stretches_lose_no_run(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        words = []
        while len(words) < 300:
            part = rng.integers(0, letters, rng.integers(1, 12)).tolist()
            words += part * int(rng.integers(1, 8))
        ids = np.array(words)
        found = []
        for a, b in runs.candidates(ids, np.zeros(len(ids), int), 6, 4):
            found += [(a + s, n, q) for s, n, q in runs.repetitions(ids[a:b].tolist(), 6, 4)]
        assert sorted(found) == brute(words)


def test_very_regular_words():
    for words in ([0] * 3000, [0, 1] * 1500, [0, 0, 1] * 700 + [2] + [0, 0, 1] * 700):
        assert runs.repetitions(words, 6, 4) == brute(words)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_words_with_many_squares():
    words = fibonacci(400)
    assert runs.repetitions(words, 2, 2) == brute(words, 2, 2)


ODD = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a A a a a", "x\x0by\x0cx\x1cy", "ä ä ä ä ä ä ä ä", "a b " * 9 + "c " * 7 + "a b " * 3, "w " * 40_000, "a b c d e f g h"]


def test_documents(spark):
    rows = [(k if k % 4 else None, t, "x", 0) for k, t in enumerate([*ODD, *ODD])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    got = runs.periodic_runs(docs).collect()
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        found = brute(words) if len(words) < 1000 else [(0, 40_000, 1)]
        want.append((i, len(words), found, b" ".join(collapse(words, found)).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        runs.periodic_runs(docs, 6, 1)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [*ODD[:-2], *(" ".join(rng.choice(["a", "b", "c"], rng.integers(1, 120))) for _ in range(250))]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for k, t in enumerate(texts):
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(k).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *((best[0], best[1], best[2]) if best else (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode())
        assert r.collapsed_sha256 == sha(b" ".join(collapse(words, found)))
    assert planted > 10
