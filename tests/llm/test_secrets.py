import hashlib
import math
import random
import re
import string

import numpy as np
import pytest

from meetpoint.llm import secrets


def plain_base(text):
    """The base patterns as they are stated."""
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def test_base_and_method(spark):
    rng = random.Random(5)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    texts = [
        None, "", "plain words only", 'é PassWord = "abc" token:abcdef, api_key=\'x/y+z=\' APIKEY : short1', "password=abcdefpassword=abcdef",
        "toKen=kelvin ſecret=abcdef1", "AKIA" + pick(string.ascii_uppercase + string.digits, 16) + " AKIASHORT", pick("0123456789abcdef", 23) + " " + pick("0123456789abcdef", 24) + "g" + pick("0123456789abcdef", 40),
        "x " * 40_000 + "secret=" + pick(alnum, 30),
    ]
    texts += [f"word {pick(alnum, 32)} end {pick(string.ascii_uppercase + '234567', 32)}" for _ in range(40)]
    ordinary = ["the-quick-brown-fox-2024-jumps", "aaaaaaaaaaaaaaaa1111111", "path/to/some/file/name2/index", "introduction_to_chapter_12_final", "aaaaaaabbbbbbbccccccc1234567"]
    texts += [f"see {x} there" for x in ordinary * 20]
    # prose, of whose words the decoys are made
    prose = "the method of a measured test gives plain answers when every reader sees what was asked about and nobody has changed them since".split()
    texts += [" ".join(rng.choice(prose) for _ in range(60)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert len(got) == len(texts)
    random_hits = ordinary_hits = 0
    for i, text in enumerate(texts):
        base = plain_base(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for k, _, _ in base) for n in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == [x for x in line.split(",") if x]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        n = sum(s.startswith("random") for s in spans)
        random_hits += n if 9 <= i < 49 else 0
        ordinary_hits += n if i >= 49 else 0
    assert random_hits >= 70
    assert ordinary_hits <= 5


def test_redaction_and_odd_rows(spark):
    rows = [(1, "token = abcdef1 end", None, 19), (1, "token = abcdef1 end", None, 19), (None, None, "s", None), (3, "", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "[SECRET] end", None, 12)] * 2 + [(None, None, "s", None), (3, "", "s", 0)], key=str)
    assert secrets.find_secrets(docs).count() == 4
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_overlaps_are_joined():
    assert secrets.redact("0123456789", [(1, 4), (3, 6), (8, 9)], "#") == "0#67#9"


ALNUM = string.ascii_letters + string.digits
# Words that are not those of the fixed decoys.
OTHER = "invoice Kunde Rechnung panier livraison almacen velocity torque matrix kernel widget banner gradient shadow border layout packet socket mutex thread vector tensor layer weight bias epoch corpus token lexer syntax grammar ledger audit payroll tenant region cluster shard replica".split()


def ordinary(rng, n):
    style, out = rng.randrange(4), ""
    while len(out) < n:
        word = rng.choice(OTHER)
        word = word.capitalize() if style == 0 else word
        out += (("", "_", "-", "/")[style] if out else "") + word + (str(rng.randrange(100)) if rng.random() < 0.3 else "")
    return out[:n]


@pytest.mark.parametrize("many", [0, 20, 200, 2000, 20_000])
def test_control_keeps_its_power(spark, many):
    hits = false = 0
    planted = 0
    for seed in (1, 2):
        rng = random.Random(seed * 100 + many)
        texts = [f"see {''.join(rng.choice(ALNUM) for _ in range(40))} there" for _ in range(20)]
        texts += [f"use {ordinary(rng, rng.randrange(24, 60))} here" for _ in range(many)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        for r in secrets.find_secrets(docs).collect():
            n = sum(x["kind"] == "random" for x in r.found)
            hits += n if r.doc_id < 20 else 0
            false += n if r.doc_id >= 20 else 0
        planted += 20
    assert hits >= 0.9 * planted
    assert false <= 0.05 * (hits + false) + 1


def test_a_repeated_name_counts_once(spark):
    rng = random.Random(9)
    odd = next(t for t in (ordinary(rng, 24) for _ in range(100_000)) if (e := secrets.infer_encoding(t)) and 14 < secrets.battery(t, e[1]) < 22)
    texts = [f"{odd} again"] * 3000 + [f"use {ordinary(rng, 24)}" for _ in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(len(r.found) for r in secrets.find_secrets(docs).collect()) == 0


def test_battery_equals_plain_formulas():
    def tail(x, dof):  # of chi-squared, by summing its density
        at = np.linspace(0, x, 200_001)[1:] if x else np.zeros(1)
        mid = at - x / 400_000
        return 1 - float((mid ** (dof / 2 - 1) * np.exp(-mid / 2)).sum() * x / 200_000 / (2 ** (dof / 2) * math.gamma(dof / 2)))

    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    rng = random.Random(2)
    for _, alphabet in secrets.ENCODINGS:
        for n in (20, 33, 40, 90):
            token = "".join(rng.choice(alphabet) for _ in range(n))
            v = np.array([alphabet.index(c) for c in token])
            size = len(alphabet)
            counts = np.bincount(v, minlength=size)
            x, dof = float(size / n * (counts**2).sum() - n), size - 1
            mean, var = dof, 2 * dof * (n - 1) / n
            k = 2 * mean**2 / var
            p0 = 0.5 * math.erfc((((max(x, 0) * 2 * mean / var / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k))) / math.sqrt(2))
            classes = 8 if n >= 40 else 4
            part = np.arange(size) * classes // size
            expected = n * np.bincount(part, minlength=classes) / size
            p1 = tail(float(((np.bincount(part[v], minlength=classes) - expected) ** 2 / expected).sum()), classes - 1)
            high = 2 * v >= size
            n1, n0 = high.sum(), (~high).sum()
            m = 1 + 2 * n0 * n1 / n
            p2 = normal((1 + (high[1:] != high[:-1]).sum() - m) / math.sqrt((m - 1) * (m - 2) / (n - 1)))
            d = v - (size - 1) / 2
            p3 = normal((d[1:] * d[:-1]).sum() / (d * d).sum() * math.sqrt(n))
            kind = lambda c: (c.islower(), c.isupper(), c.isdigit())
            kinds = [kind(c) for c in alphabet]
            pairs = np.mean([a != b for a in kinds for b in kinds])
            triples = np.mean([a != b and b != c for a in kinds for b in kinds for c in kinds])
            p4 = normal((sum(kind(a) != kind(b) for a, b in zip(token, token[1:], strict=False)) - (n - 1) * pairs) / math.sqrt((n - 1) * pairs * (1 - pairs) + 2 * (n - 2) * (triples - pairs**2)))
            letters = [c for c in alphabet if c.isalpha()]
            q = np.mean([c.lower() in "etaoinsrl" for c in letters])
            mine = [c for c in token if c.isalpha()]
            p5 = normal((sum(c.lower() in "etaoinsrl" for c in mine) - len(mine) * q) / math.sqrt(len(mine) * q * (1 - q)))
            want = -2 * sum(math.log(p) for p in (p0, p1, p2, p3, p4, p5))
            assert secrets.battery(token, alphabet) == pytest.approx(want, abs=0.01)


def test_selection_equals_the_rule():
    rng = np.random.default_rng(3)
    for _ in range(100):
        shape = (3, secrets.BINS)
        tokens, made = rng.poisson(0.02, shape), rng.poisson(np.linspace(0, 3, secrets.BINS), shape)
        tokens[rng.integers(0, 3, 10), rng.integers(0, 200, 10)] += 1
        p = np.stack([secrets.p_values(m) for m in made])
        assert (np.diff(p) >= -1e-12).all() and (p >= np.cumsum(made, axis=1) / made.sum(axis=1, keepdims=True) - 1e-12).all()
        values = np.sort(np.repeat(p.ravel(), tokens.ravel()))
        passed = [x for k, x in enumerate(values, 1) if x <= 0.05 * k / len(values)]
        last = secrets.last_reported(tokens, made, 0.05)
        assert sum(tokens[k, : b + 1].sum() for k, b in last.items()) == (values <= max(passed, default=-1)).sum()
