"""Near-duplicates by SimHash fingerprints, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits, and each
segment is decoded to a codeword of the Golay code.  If two fingerprints differ
in at most 4 bits, then by the pigeonhole principle either two segments differ
in at most one bit each, or one segment is equal.  Hence the keys:

- for two segments, (any codeword near the first, the codeword of the second)
  on one side and (the codeword of the first, any codeword near the second) on
  the other: two fingerprints with at most one error in each segment meet;
- each segment as it stands.

Distinct fingerprints that meet under a key are verified bit by bit.  From a
crowded key only the links of a spanning forest leave, which keeps components
whole without writing all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import materialise, small_batches
from .components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Segments of the fingerprint: (shift, bits).
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: A key with more candidate pairs than this is linked by a spanning forest.
CROWDED = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text; zero if it has no words."""
    words = text.lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = np.array(hashes[at : at + 4096], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text, ...); fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of the keys of fingerprints; pairs meet on sides 0 and 1, or both on 2."""
    segments = [(prints >> np.uint64(s)).astype(np.int64) & ((1 << b) - 1) for s, b in SEGMENTS]
    exact = [golay.decode(x) for x in segments]
    near = [golay.nearby(x, b) for x, (_, b) in zip(segments, SEGMENTS, strict=True)]
    rows, keys, sides = [], [], []
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (ri, ai), (rj, aj) = near[i], near[j]
        rows += [ri, rj]
        keys += [k << 24 | ai << 12 | exact[j][ri], k << 24 | exact[i][rj] << 12 | aj]
        sides += [np.zeros(len(ri), np.int8), np.ones(len(rj), np.int8)]
    for i, x in enumerate(segments):
        rows.append(np.arange(len(x)))
        keys.append(x | (3 + i) << 24)
        sides.append(np.full(len(x), 2, np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def forest(prints: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever is linked among distinct fingerprints, one fewer than each tree's nodes."""
    found, left = [], prints
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            close = np.bitwise_count(left ^ x) <= max_bits
            if close.any():
                new, left = left[close], left[~close]
                found.append((np.full(len(new), x, np.uint64), new))
                frontier.extend(new)
    return found


def linked(keys: np.ndarray, sides: np.ndarray, prints: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links among rows sorted by key and side (whole keys)."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    first = np.add.reduceat(sides == 0, starts)
    same = np.add.reduceat(sides == 2, starts)
    pairs = np.where(same > 0, same * same, first * (sizes - first))
    found = []
    for at in np.flatnonzero(pairs > CROWDED):
        found += forest(np.unique(prints[starts[at] : starts[at] + sizes[at]]), max_bits)
    few = np.flatnonzero((pairs > 0) & (pairs <= CROWDED) & (sizes > 1))
    if len(few):
        n_left = np.where(same[few] > 0, sizes[few], first[few])
        n_right = np.where(same[few] > 0, sizes[few], sizes[few] - first[few])
        right_from = np.where(same[few] > 0, starts[few], starts[few] + first[few])
        n = n_left * n_right
        run = np.repeat(np.arange(len(few)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = prints[starts[few][run] + k // n_right[run]]
        b = prints[right_from[run] + k % n_right[run]]
        close = (a != b) & (np.bitwise_count(a ^ b) <= max_bits)
        found.append((a[close], b[close]))
    return found


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all of the distinct prints(fp) within ``max_bits`` (at most 4) bits.

    Two prints of one component are connected by links; not every pair in
    reach is listed.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find pairs that differ in at most 4 bits")

    def deal(batches):
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 8192):
                part = whole[at : at + 8192]
                rows, keys, sides = segment_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sides), pa.array(part[rows])], names=["key", "side", "fp"])

    def meet(batches):
        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side", "fp")]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            kept = [x[last:] for x in now]
            if last:
                yield from as_links(*(x[:last] for x in now))
        if kept is not None:
            yield from as_links(*kept)

    def as_links(keys, sides, values):
        for a, b in linked(keys, sides, values.view(np.uint64), max_bits):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return (
        prints.select("fp").mapInArrow(deal, "key long, side byte, fp long")
        .repartition("key").sortWithinPartitions("key", "side")
        .mapInArrow(meet, "a long, b long")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, component_id), a row per row of docs.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits.  Copies share a fingerprint and are grouped
    before any comparison.  Null, empty and blank texts have fingerprint zero,
    which links like any other.  Rows whose doc_id is null get a component too
    and never name one, unless all of its ids are null.  Repeated rows stay.
    """
    prints = materialise(with_fingerprints(docs, shingle))
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    member = materialise(connected_components(fingerprint_links(groups, max_bits)))
    named = (
        member.join(groups, F.col("node") == F.col("fp"))
        .groupBy("component").agg(F.min("smallest").alias("component_id"))
    )
    by_print = materialise(
        groups.join(member.join(named, "component").select("node", "component_id"), F.col("fp") == F.col("node"), "left")
        .select(F.col("fp").alias("f"), F.coalesce("component_id", "smallest").alias("component_id"))
    )
    return prints.join(by_print, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
