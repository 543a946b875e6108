"""Personal data in text: patterns, and a skip-chain conditional random field.

The field's nodes are a document's tokens with a digit or an at sign, its labels
none, email, ip, card and phone.  Digit groups that blanks part are one token:
a number that a pattern proves elsewhere in the document, in any spelling, or else
the whole stretch of groups.  Tokens next to each other share chain potentials;
distant tokens that are equal or similar (same text, same last seven digits, same
mailbox) share skip potentials, by links from each to the next one alike.  Where
a pattern proves one of a group of alike tokens, all are linked to a hub node that
holds the proof, by a potential that carries it.  Loopy sum-product message
passing, until the messages stay, then enforces one label for a value throughout
the document.

Weights are learned by pseudo-likelihood from tokens that the patterns label,
on a bounded sample of tokens chosen by hash.  What no pattern labels is not
always none: tokens alike to a proved one, and tokens that a word announces, are
left out, and the features by which the patterns know a kind are hidden in one copy
of the rows, so that words and shapes must do.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The base patterns; emails are found from their at signs.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SIGN = re.compile(r"[0-9@]")
REST = re.compile(r"[0-9@]\S*")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = ".,;:!?\"'<>[]{}*#%$&"
# Words that announce a kind.
CUES = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "credit", "account", "iban"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "cell"},
}
#: Potential by which a token inside a base span holds its label, and that of a token and the hub that holds its group's proof.
EVIDENCE, PROOF = 8.0, 12.0
#: Messages of a document are passed until none changes by more than TOLERANCE; a document that doesn't settle in ROUNDS rounds takes the beliefs it has then.
ROUNDS = 1000
TOLERANCE = 1e-4
LEAST_BELIEF = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(end, at + 1))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the blank-separated tokens with a digit or an at sign, without marks at their edges."""
    out = []
    for m in REST.finditer(text):
        start = m.start()
        floor = out[-1][1] if out else 0
        while start > floor and not text[start - 1].isspace():
            start -= 1
        token = text[start : m.end()]
        left = len(token) - len(token.lstrip(EDGE))
        kept = token.strip(EDGE)
        out.append((start + left, start + left + len(kept)))
    return [(a, b) for a, b in out if b > a]


GROUP = re.compile(r"[0-9().+-]+")
#: Digits of a number that is joined over blanks, and the least of it that tells it apart.
MOST_DIGITS, LEAST_DIGITS = 19, 7


def joined(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``spans`` with digit groups that single blanks part joined, by the numbers that ``base`` proves or as a whole."""
    proved = {d for a, _, b in base if len(d := NOT_DIGIT.sub("", text[a:b])) >= LEAST_DIGITS}
    wanted = proved | {d[-k:] for d in proved for k in range(LEAST_DIGITS, len(d))}
    out, i = [], 0
    while i < len(spans):
        j = i
        while GROUP.fullmatch(text, *spans[j]) and j + 1 < len(spans) and 1 <= spans[j + 1][0] - spans[j][1] <= 2 and not text[spans[j][1] : spans[j + 1][0]].strip(" (") and GROUP.fullmatch(text, *spans[j + 1]):
            j += 1
        stretch = spans[i : j + 1]
        i = j + 1
        digits = [NOT_DIGIT.sub("", text[a:b]) for a, b in stretch]
        k, loose = 0, []
        while k < len(stretch):
            ends = [m for m in range(len(stretch), k, -1) if len(d := "".join(digits[k:m])) <= MOST_DIGITS and d in wanted]
            if ends:
                out += whole(loose, digits[k - len(loose) : k]) + [(stretch[k][0], stretch[ends[0] - 1][1])]
                k, loose = ends[0], []
            else:
                loose.append(stretch[k])
                k += 1
        out += whole(loose, digits[k - len(loose) : k])
    return out


def whole(stretch: list[tuple[int, int]], digits: list[str]) -> list[tuple[int, int]]:
    return [(stretch[0][0], stretch[-1][1])] if stretch and LEAST_DIGITS <= sum(map(len, digits)) <= MOST_DIGITS else stretch


def features(text: str, start: int, stop: int) -> int:
    """Binary features of a token as bits."""
    token = text[start:stop]
    digits = NOT_DIGIT.sub("", token)
    n = len(digits)
    before = text[max(0, start - 24) : start].lower().split()[-2:]
    cue = {w.strip(".,:;()#") for w in before}
    tests = (
        True, "@" in token, n == len(token), n < 4, 4 <= n < 7, 7 <= n < 10, 10 <= n < 12, 12 <= n < 16, 16 <= n < 20, n >= 20,
        "." in token, token.count(".") == 3, "-" in token or " " in token, "(" in token or ")" in token, token.startswith("+"), any(c.isalpha() for c in token),
        12 <= n <= 19 and luhn(digits), *(bool(cue & words) for words in CUES.values()),
    )
    return sum(1 << i for i, x in enumerate(tests) if x)


N_FEATURES = 17 + len(CUES)
# Features by which the patterns know a kind: a leading plus, Luhn's sum, three dots.
KNOWN_BY = (11, 14, 16)
#: Bits of the cue words.
CUE_BITS = ((1 << len(CUES)) - 1) << 17


def possible(f: np.ndarray) -> np.ndarray:
    """Whether a token's shape, as rows of features, may have each label: an email needs an at sign, and so on."""
    at, none = f[:, 1] > 0, np.ones(len(f), bool)
    return np.stack([none, at, (f[:, 11] > 0) & ~at, f[:, 7:9].any(axis=1) & ~at, f[:, 5:8].any(axis=1) & ~at], axis=1)


def unpack(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


def graph(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Labels that the base spans give the tokens, and edges (a, b, 0 for chain or 1 for skip)."""
    labels, k = [0] * len(spans), 0
    for start, kind, end in base:
        while k and spans[k - 1][1] > start:
            k -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < end:
            labels[j] = labels[j] or kind + 1
            j += 1
    edges = [(i, i + 1, 0) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 2]
    last: dict[str, int] = {}
    for i, (a, b) in enumerate(spans):
        token = text[a:b].lower()
        digits = NOT_DIGIT.sub("", token)
        keys = {f"t{token}"} if len(token) > 3 else set()
        if len(digits) >= 7:
            keys.add(f"d{digits[-7:]}")
        if "@" in token[1:]:
            keys.add(f"m{token.split('@')[0]}")
        near = {last[key] for key in keys if key in last}
        edges += [(j, i, 1) for j in near]
        last.update(dict.fromkeys(keys, i))
    return labels, edges


def with_hubs(labels: list[int], edges: list[tuple[int, int, int]]) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """(members of each hub, edges): the skip edges of a group with a proved token lead to its hub, as edges of kind 2.

    The hubs are numbered on from the tokens.
    """
    root = list(range(len(labels)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, kind in edges:
        if kind:
            root[find(b)] = find(a)
    groups: dict[int, list[int]] = {}
    for i in range(len(labels)):
        groups.setdefault(find(i), []).append(i)
    hubs = [g for g in groups.values() if len(g) > 1 and any(labels[i] for i in g)]
    inside = {i for g in hubs for i in g}
    kept = [e for e in edges if not (e[2] and e[0] in inside)]
    return hubs, kept + [(i, len(labels) + h, 2) for h, g in enumerate(hubs) for i in g]


def neighbour_counts(n: int, labels: list[int], edges: list[tuple[int, int, int]]) -> np.ndarray:
    """(n, 2, labels): how many chain and skip neighbours have each label."""
    out = np.zeros((n, 2, len(LABELS)))
    for a, b, kind in edges:
        out[a, kind, labels[b]] += 1
        out[b, kind, labels[a]] += 1
    return out


def training_rows(docs: DataFrame, sample_docs: int, sample_tokens: int) -> DataFrame:
    """(bits, label, around) of a bounded, hash-chosen sample of tokens."""
    n = max(1, docs.count())
    roll = F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(1_000_000)) / 1e6
    chosen = docs.where(F.col("text").rlike("[0-9@]") & (roll < min(1.0, sample_docs / n))).select("text")

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                base = base_spans(text)
                spans = joined(text, tokens(text), base)
                labels, edges = graph(text, spans, base)
                around = neighbour_counts(len(spans), labels, edges)
                hubs, _ = with_hubs(labels, edges)
                unsure = {i for g in hubs for i in g if not labels[i]}  # alike to a proved one
                for i, (a, b) in enumerate(spans):
                    bits = features(text, a, b)
                    announced = not labels[i] and bits & CUE_BITS and ("@" in text[a:b] or sum(c.isdigit() for c in text[a:b]) >= LEAST_DIGITS)
                    if i not in unsure and not announced:
                        rows.append((bits, labels[i], around[i].ravel().tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["bits", "label", "around"])

    drawn = chosen.mapInArrow(run, "bits long, label long, around array<double>")
    # Few tokens differ in all of this, so rows alike are counted first.
    return drawn.groupBy("bits", "label", "around").count().orderBy(F.xxhash64("bits", "label", "around"), "bits", "label", "around").limit(sample_tokens)


def learn(docs: DataFrame, sample_docs: int = 50_000, sample_tokens: int = 20_000, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pair potentials of chain and skip edges) by penalised pseudo-likelihood."""
    rows = training_rows(docs, sample_docs, sample_tokens).collect()
    k = len(LABELS)
    unary, pair = np.zeros((N_FEATURES, k)), np.zeros((2, k, k))
    unary[0, 0] = 1.0
    pair[1] = 4 * np.eye(k)  # the prior: tokens alike have the same label
    if not rows:
        return unary, pair
    f = unpack(np.array([r["bits"] for r in rows], np.int64))
    y = np.array([r["label"] for r in rows], np.int64)
    around = np.array([r["around"] for r in rows]).reshape(len(rows), 2, k)
    weight = np.array([r["count"] for r in rows], float)
    # Once with the token's shape hidden, so that the pair potentials learn to carry a label alone.
    hidden = np.zeros_like(f)
    hidden[:, 0] = 1
    unknown = f.copy()
    unknown[:, KNOWN_BY] = 0
    f, y, around, weight = np.concatenate((f, hidden, unknown)), np.tile(y, 3), np.tile(around, (3, 1, 1)), np.tile(weight, 3)
    weight /= np.bincount(y, weight, k)[y] * len(np.unique(y))  # rare labels count as much as "none"
    truth = np.eye(k)[y]
    prior = pair.copy()
    for step in range(steps):
        z = f @ unary + np.einsum("nek,ekl->nl", around, pair)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p = (p / p.sum(axis=1, keepdims=True) - truth) * weight[:, None]
        rate = 4.0 / (1 + step / 100)
        unary -= rate * (f.T @ p + 1e-4 * unary)
        grad = np.einsum("nek,nl->ekl", around, p) + 1e-3 * (pair - prior)
        pair -= rate * 0.25 * (grad + grad.transpose(0, 2, 1)) / 2
    return unary, pair


def beliefs(potentials: np.ndarray, edges: np.ndarray, pair: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy sum-product; edges (a, b, kind) may belong to many documents, ``group`` being each node's.

    Each document's messages pass until they stay, whatever the others do.
    """
    k = potentials.shape[1]
    base = potentials - potentials.max(axis=1, keepdims=True)
    if len(edges):
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        kind = np.concatenate((edges[:, 2], edges[:, 2]))
        table, message = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)), np.zeros((len(source), k))
        doc = np.zeros(len(source), np.int64) if group is None else group[source]
        live = np.arange(len(source))
        for _ in range(ROUNDS):
            total = base.copy()
            np.add.at(total, target, message)
            out = total[source[live]] - message[back[live]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", out, table[kind[live]]))
            new -= new.max(axis=1, keepdims=True)
            moves = np.zeros(doc.max() + 1, bool)
            moves[doc[live][np.abs(new - message[live]).max(axis=1) >= TOLERANCE]] = True
            message[live] = 0.5 * message[live] + 0.5 * new
            live = live[moves[doc[live]]]
            if not len(live):
                break
        np.add.at(base, target, message)
    p = np.exp(base - base.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_pii(docs: DataFrame, sample_docs: int = 50_000, sample_tokens: int = 20_000) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    ``spans`` has the base spans and those of tokens outside them to which the
    field gives a label with a belief of 0.8 or more (the likeliest; of equal ones
    the first of LABELS), if one alike is proved or a word before announces that
    kind, not for their shape alone; neighbours with one label make one span.  Null and empty
    texts have none; long ones are taken whole, and a document's result depends on
    it and the weights alone.  Repeated rows and null ids stay; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    small_batches(docs)
    unary, pair = learn(docs.where("text is not null"), sample_docs, sample_tokens)
    pair = np.concatenate((pair, PROOF * np.eye(len(LABELS))[None]))  # edges to hubs: not learned

    def run(batches):
        for batch in batches:
            column, n = batch.column("text"), batch.num_rows
            base, nodes, bits, labels, edges, proved, alike = [[]] * n, [], [], [], [], [], []
            for i in range(n):
                text = column[i].as_py()
                if not text or not SIGN.search(text):
                    continue
                base[i] = base_spans(text)
                spans = joined(text, tokens(text), base[i])
                given, links = graph(text, spans, base[i])
                hubs, links = with_hubs(given, links)
                first = len(nodes)
                alike += [first + j for g in hubs for j in g]
                proved += [(first + len(spans) + h, given[j], len(g)) for h, g in enumerate(hubs) for j in g if given[j]]
                nodes += [(i, a, b) for a, b in spans] + [(i, -1, -1)] * len(hubs)
                bits += [features(text, a, b) for a, b in spans] + [0] * len(hubs)
                labels += given + [0] * len(hubs)
                edges += [(a + first, b + first, kind) for a, b, kind in links]
            added: dict[int, list] = {}
            if nodes:
                given, shape = np.array(labels), unpack(np.array(bits, np.int64))
                potentials = shape @ unary
                token = np.array([a >= 0 for _, a, _ in nodes])
                potentials[(token & (given == 0))[:, None] & ~possible(shape)] = -4 * EVIDENCE
                told = shape[:, 17:] > 0  # by a word before
                told[alike] = True
                potentials[np.flatnonzero(given), given[given > 0]] += EVIDENCE
                for hub, label, size in proved:  # so many tokens must not outvote the proof
                    potentials[hub, label] += EVIDENCE * size
                p = beliefs(potentials, np.array(edges, np.int64).reshape(-1, 3), pair, np.array([i for i, _, _ in nodes]))
                best = p.argmax(axis=1)
                for j in np.flatnonzero((given == 0) & (best > 0) & (p.max(axis=1) >= LEAST_BELIEF)):
                    i, a, b = nodes[j]
                    if a < 0:
                        continue
                    kind = int(best[j]) - 1
                    if not told[j, kind] or any(s < b and a < e for s, _, e in base[i]):
                        continue
                    mine = added.setdefault(i, [])
                    if mine and mine[-1][1] == kind and a - mine[-1][2] <= 2:
                        mine[-1] = (mine[-1][0], kind, b)
                    else:
                        mine.append((a, kind, b))
            lines = [as_line(x) for x in base]
            every = [as_line(sorted(x + added[i])) if i in added else lines[i] for i, x in enumerate(base)]
            counts = [[sum(k == kind for _, k, _ in x) for x in base] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(lines, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    def as_line(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
