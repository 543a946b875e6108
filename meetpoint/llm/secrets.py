"""Secrets in text: patterns, and tokens that pass a battery of randomness tests.

For a token over an encoding's alphabet six tests measure how far it is from
uniform, independent symbols: chi-squared over all symbols of the alphabet, over
classes of it, and over the letters that words have often against the others; runs
about its middle and runs of letters, capitals and digits; lag-one serial
correlation.  Fisher's statistic joins them; random material has a small one.

How small it must be is told by decoys: identifiers of like length, made of the
words of the documents themselves (a name in camel case, with underscores or
slashes, and digits), one for each document and each tested token, and of a fixed
list of words, so that there are always some.  The share of decoys with no larger a
statistic is a token's p-value under "ordinary".  Below the lowest twentieth of the
decoys, where there are too few to count, it is fitted: the logarithm of the share
falls at least as fast as it does there.  So p gets as small as it must for a few
secrets among very many ordinary tokens.  The Benjamini-Hochberg rule
over all lengths bounds the share of ordinary tokens among those reported by
``alpha``; a token that occurs often counts once.  It needs only histograms of
statistics, which are small whatever the corpus.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a whole leftmost match
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

# Alphabets by encoding, in the order in which they are tried.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Classes of the statistic, 64 for each doubling; the last is open.
BINS = 1024
#: Lengths have four classes for each doubling; the last, from 256 symbols on, is open.
LONGEST = 32
# Letters that words of many European languages have often, and words that identifiers are made of.
COMMON = set("etaoinsrlETAOINSRL")
NAMES = (
    "get set user name value index file path data list item count size time date start end first last next node tree table row column query "
    "result error message handler service client server request response option default parse format build create update delete load save "
    "read write open close send stream buffer cache queue event state action context manager factory controller model view test helper core"
).split()
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIXED = re.compile(r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer_encoding(token: str) -> tuple[str, str] | None:
    """The first encoding whose alphabet has all symbols; None if letters and digits aren't mixed."""
    if not MIXED.search(token):
        return None
    symbols = set(token)
    return next(((name, alphabet) for name, alphabet in ENCODINGS if symbols <= set(alphabet)), None)


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-squared with an even or odd number of degrees of freedom > x)."""
    if x <= 0:
        return 1.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, math.exp(-x / 2) * total)
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(3, dof + 1, 2):
        total += term
        term *= x / i
    return min(1.0, total)


def sparse_tail(x: float, dof: int, n: int) -> float:
    """Upper tail of the chi-squared statistic of ``n`` symbols in dof + 1 cells, few in each: mean and variance are exact."""
    mean, var = dof, 2 * dof * (n - 1) / n
    k = 2 * mean * mean / var
    z = ((x * 2 * mean / var / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: str) -> float:
    """Fisher's statistic of the six tests; large where the token is not random over the alphabet."""
    n, size = len(token), len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    values = [place[c] for c in token]
    symbols = [0] * size
    for v in values:
        symbols[v] += 1
    p0 = sparse_tail(max(0.0, size / n * sum(c * c for c in symbols) - n), size - 1, n)
    classes = 8 if n >= 40 else 4
    counts, share = [0] * classes, [0] * classes
    for v, c in enumerate(symbols):
        counts[v * classes // size] += c
        share[v * classes // size] += 1
    p1 = chi2_tail(sum((c - n * s / size) ** 2 / (n * s / size) for c, s in zip(counts, share, strict=True)), classes - 1)
    high = [2 * v >= size for v in values]
    n1 = sum(high)
    n0 = n - n1
    if n0 == 0 or n1 == 0:
        p2 = 2.0 ** (1 - n)
    else:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * n0 * n1 / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p2 = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    middle = (size - 1) / 2
    d = [v - middle for v in values]
    power = sum(x * x for x in d)
    r = sum(a * b for a, b in zip(d, d[1:], strict=False)) / power if power else 1.0
    p3 = math.erfc(abs(r) * math.sqrt(n / 2))
    p4, p5 = class_runs(token, alphabet), common_letters(token, alphabet)
    return -2 * sum(math.log(max(p, 1e-300)) for p in (p0, p1, p2, p3, p4, p5))


def kind_of(symbol: str) -> int:
    return 0 if "a" <= symbol <= "z" else 1 if "A" <= symbol <= "Z" else 2 if "0" <= symbol <= "9" else 3


def class_runs(token: str, alphabet: str) -> float:
    """Two-sided normal tail of the number of places where small letters, capitals, digits and others change."""
    n, kinds = len(token), [kind_of(c) for c in alphabet]
    shares = [kinds.count(k) / len(kinds) for k in set(kinds)]
    p = 1 - sum(x * x for x in shares)
    if not p:
        return 1.0
    twice = sum(x * (1 - x) ** 2 for x in shares)  # a change on either side of a symbol
    var = (n - 1) * p * (1 - p) + 2 * (n - 2) * (twice - p * p)
    changes = sum(kind_of(a) != kind_of(b) for a, b in zip(token, token[1:], strict=False))
    return math.erfc(abs(changes - (n - 1) * p) / math.sqrt(2 * max(var, 1e-9)))


def common_letters(token: str, alphabet: str) -> float:
    """Two-sided normal tail of the number of common letters among the token's letters."""
    letters = [c for c in alphabet if kind_of(c) < 2]
    q = sum(c in COMMON for c in letters) / len(letters)
    mine = [c for c in token if kind_of(c) < 2]
    return math.erfc(abs(sum(c in COMMON for c in mine) - len(mine) * q) / math.sqrt(2 * len(mine) * q * (1 - q))) if mine else 1.0


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the sorted spans, overlapping ones joined."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans, and (start, end, statistic) of tested tokens that no base span touches."""
    base = base_spans(text)
    starts, ends = merged(base)
    tested = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        token = m[0]
        encoding = infer_encoding(token)
        if encoding:
            k = bisect_right(ends, a)  # the first that ends after the token's start
            if k == len(starts) or starts[k] >= b:
                tested.append((a, b, battery(token, encoding[1])))
    return base, tested


WORDS = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_-])")


def identifier(words, length: int, style: int, number: int) -> str | None:
    """The words joined into a name of ``length`` symbols; None if there are too few."""
    made, size = [], 0
    for k, word in enumerate(words):
        word = word.capitalize() if style == 0 else word.lower()
        if k % 3 == 1:
            word += str(number)
        made.append(word)
        size += len(word) + (style > 0)
        if size >= length:
            break
    token = ("", "_", "/")[style].join(made)[:length]
    return token if len(token) == length else None


def tested_decoy(token: str | None) -> tuple[int, int] | None:
    encoding = infer_encoding(token) if token else None
    return (length_class(len(token)), s_bin(battery(token, encoding[1]))) if encoding else None


def decoys(text: str, lengths: list[int]) -> list[tuple[int, int]]:
    """(length class, statistic's class) of identifiers made of the text's words from hashed places on: one of each length and one of any."""
    found, data = [], text.encode(errors="surrogatepass")
    for k, length in enumerate([0, *lengths]):
        roll = xxhash.xxh64_intdigest(data, 7 + k)
        length = length or 20 + (roll >> 8) % 108
        at = (roll >> 24) % max(1, len(text) - 6 * length)
        words = (m[0] for m in WORDS.finditer(text, at))
        found.append(tested_decoy(identifier(words, length, (roll >> 20) % 3, (roll >> 40) % 100)))
    return [x for x in found if x]


@cache
def prior_decoys(each: int = 1000) -> np.ndarray:
    """Histogram (length class, statistic's class) of identifiers made of the fixed words, ``each`` of every length class."""
    counts, rng = np.zeros((LONGEST + 1, BINS), np.int64), random.Random(0)
    for k in range(length_class(20), LONGEST + 1):
        lengths = [n for n in range(20, 300) if length_class(n) == k]
        for _ in range(each):
            words = rng.choices(NAMES, k=200)
            made = tested_decoy(identifier(words, rng.choice(lengths), rng.randrange(3), rng.randrange(100)))
            if made:
                counts[made] += 1
    return counts


SCANNED = (
    "doc_id long, n_assign long, n_access long, n_hex long, base string, "
    "tested array<struct<start: int, stop: int, length_class: int, s_bin: int, token: long>>, decoys array<struct<length_class: int, s_bin: int>>"
)


def s_bin(statistic: float) -> int:
    return min(BINS - 1, int(64 * math.log2(1 + statistic)))


def length_class(length: int) -> int:
    return min(LONGEST, int(4 * math.log2(length)))


def scan_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): base counts, base spans (kind:start:end text), tested tokens and the text's decoys."""

    def run(batches):
        for batch in batches:
            counts = [[], [], []]
            bases, tests, made = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base, tested = scan(text)
                for k, column in enumerate(counts):
                    column.append(sum(kind == k for _, kind, _ in base))
                bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base))
                tests.append([
                    {"start": s, "stop": e, "length_class": length_class(e - s), "s_bin": s_bin(x), "token": xxhash.xxh64_intdigest(text[s:e].encode()) - (1 << 63)}
                    for s, e, x in tested
                ])
                made.append([{"length_class": k, "s_bin": x} for k, x in decoys(text, [e - s for s, e, _ in tested])])
            struct = lambda *names: pa.struct([(n, pa.int64() if n == "token" else pa.int32()) for n in names])
            columns = [
                batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()),
                pa.array(tests, pa.list_(struct("start", "stop", "length_class", "s_bin", "token"))), pa.array(made, pa.list_(struct("length_class", "s_bin"))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base", "tested", "decoys"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def p_values(decoys: np.ndarray, least: int = 25) -> np.ndarray:
    """For each class of the statistic, the share of ordinary tokens up to it, from a histogram of decoys.

    Up to the lowest twentieth (or ``least`` decoys) the share's logarithm is taken
    to fall in a straight line, as steeply as the decoys below do on average;
    measured shares that are larger count instead.
    """
    upto, n = np.cumsum(decoys), decoys.sum()
    counted = (1 + upto) / (1 + n)
    enough = max(least, int(np.ceil(n / 20)))
    if n <= enough:
        return counted
    u = int(np.searchsorted(upto, enough))  # the first class by which there are enough
    below = np.arange(u + 1)
    gap = ((u + 0.5 - below) * decoys[: u + 1]).sum() / upto[u]
    fitted = upto[u] / n * np.exp(-(u - below) / gap)
    out = counted.copy()
    out[: u + 1] = np.minimum(counted[: u + 1], np.maximum(fitted, upto[: u + 1] / n))
    return out


def last_reported(tokens: np.ndarray, decoys: np.ndarray, alpha: float) -> dict[int, int]:
    """length class -> the last class of the statistic that Benjamini and Hochberg's rule reports.

    Both are histograms (length class, statistic's class).  A token's p-value is
    that of its length's decoys; the rule takes the tokens of all lengths together.
    """
    used = np.flatnonzero(tokens.any(axis=1))
    if not len(used):
        return {}
    p = np.stack([p_values(decoys[k]) for k in used])
    real = tokens[used]
    order = np.argsort(p, axis=None, kind="stable")
    sorted_p, upto = p.ravel()[order], np.cumsum(real.ravel()[order])
    upto = upto[np.searchsorted(sorted_p, sorted_p, side="right") - 1]  # equal p-values count together
    good = np.flatnonzero((upto > 0) & (sorted_p * upto[-1] <= alpha * upto))
    if not len(good):
        return {}
    most = sorted_p[good[-1]]
    return {int(k): int(at[-1]) for k, row in zip(used, p, strict=True) if len(at := np.flatnonzero(row <= most))}


def reported_bins(scanned: DataFrame, alpha: float) -> dict[int, int]:
    """length class -> the last class of the statistic that is reported as random.

    Tokens are told apart by a hash and counted once, after a count for each task.
    The driver gets two histograms, of at most LONGEST x BINS numbers each.
    """
    tested = scanned.select(F.explode("tested").alias("t")).groupBy("t.length_class", "t.s_bin", "t.token").agg(F.lit(1).alias("one"))
    tokens = tested.groupBy("length_class", "s_bin").agg(F.count("*").alias("n"), F.lit(True).alias("real"))
    made = scanned.select(F.explode("decoys").alias("d")).groupBy("d.length_class", "d.s_bin").agg(F.count("*").alias("n"), F.lit(False).alias("real"))
    real, decoy = np.zeros((LONGEST + 1, BINS), np.int64), prior_decoys().copy()
    for r in tokens.unionByName(made).collect():
        (real if r["real"] else decoy)[r["length_class"], r["s_bin"]] += r["n"]
    return last_reported(real, decoy, alpha)


def find_secrets(docs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans, found).

    ``spans`` is text (kind:start:end, in code points, end exclusive, by start
    and kind), ``found`` the same as an array of structs.  Null and empty texts
    have no spans; long ones are scanned whole.  Repeated rows and null ids are kept as
    they are; an empty table gives no rows.  Other columns are not read, so their names
    do not matter.
    """
    scanned = materialise(scan_texts(docs))
    limits = reported_bins(scanned, alpha)  # a small map
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map().cast("map<int,int>")
    random = F.filter("tested", lambda t: t["s_bin"] <= F.coalesce(F.element_at(known, t["length_class"]), F.lit(-1)))

    def as_struct(kind, start, stop):
        order = F.array_position(F.array(*map(F.lit, KINDS)), kind)
        return F.struct(start.cast("int").alias("start"), order.cast("int").alias("k"), kind.alias("kind"), stop.cast("int").alias("stop"))

    from_base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: as_struct(F.split_part(x, F.lit(":"), F.lit(1)), F.split_part(x, F.lit(":"), F.lit(2)), F.split_part(x, F.lit(":"), F.lit(3))),
    )
    both = F.array_sort(F.concat(from_base, F.transform(random, lambda t: as_struct(F.lit("random"), t["start"], t["stop"]))))
    return (
        scanned.withColumn("found", both)
        .select(
            "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
            F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",").alias("spans"), "found",
        )
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with every span, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, alpha: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in ``text`` replaced by ``mark`` (and n_chars, if there, set anew).

    All rows and columns stay, whatever their names; null and empty texts stay as they
    are, repeated rows are treated alike, an empty table gives no rows.  The texts are
    scanned whole and twice, once for the corpus's statistics and once to replace, and
    are never shuffled.
    """
    limits = reported_bins(materialise(scan_texts(docs)), alpha)
    names = docs.columns
    has_length = "n_chars" in names

    def run(batches):
        for batch in batches:
            texts = []
            for value in batch.column("text"):
                text = value.as_py()
                if text:
                    base, tested = scan(text)
                    spans = [(s, e) for s, _, e in base]
                    spans += [(s, e) for s, e, x in tested if s_bin(x) <= limits.get(length_class(e - s), -1)]
                    text = redact(text, spans, mark) if spans else text
                texts.append(text)
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if has_length:
                kind = batch.schema.field("n_chars").type
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return small_batches(docs).mapInArrow(run, docs.schema)
