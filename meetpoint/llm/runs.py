"""Periodic runs of words, found with a suffix automaton and link-cut access.

The automaton of the words read so far is extended word by word.  Its suffix
links form a tree, held as a link-cut tree whose preferred paths are coloured
with the place where their strings ended last.  Appending the word at r accesses
the path from the new state to the root: each segment of one colour v on it says
that all suffixes up to the length L of its deepest state ended last at v, so the
words from v - L + 1 to r have the period r - v.  If L is r - v or more, that is
a square; its start cannot move left, its period is the smallest, and the last r
at which it shows is the end of the run.

Words that no run of the wanted length and exponent can hold are left out
before: in a stretch of m words that a run fills, each word has an equal one
within m / exponent words.  Stretches shrink until that holds for all their
words, which loses no run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, small_batches


def repetitions(words: list[int], least_length: int, least_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with at least that length and ``least_exponent`` (2 or more) periods."""
    size = 2 * len(words) + 2
    longest, link, step = [0] * size, [0] * size, [None] * size  # the automaton; state 1 is its root
    up, left, right, colour = [0] * size, [0] * size, [0] * size, [-1] * size  # splay trees of the paths; a path's colour is at its splay root
    found: dict[tuple[int, int], int] = {}

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if left[p] == x:
                side = left
            elif right[p] == x:
                side = right
            else:
                return
            g = up[p]
            if left[g] == p or right[g] == p:
                rotate(p if side[g] == p else x)
                rotate(x)
                colour[x] = colour[g]
            else:
                rotate(x)
                colour[x] = colour[p]

    step[1], last, top = {}, 1, 1
    for r, w in enumerate(words):
        top += 1
        new, p = top, last
        longest[new], step[new] = r + 1, {}
        while p and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if not p:
            link[new] = 1
        elif longest[q := step[p][w]] == longest[p] + 1:
            link[new] = q
        else:
            top += 1
            clone = top
            longest[clone], step[clone], link[clone] = longest[p] + 1, step[q].copy(), link[q]
            link[q] = link[new] = clone
            while p and step[p].get(w) == q:
                step[p][w] = clone
                p = link[p]
            splay(q)  # the clone joins q's path just above it, and so takes its colour
            if b := left[q]:
                left[clone] = b
                up[b] = clone
            left[q] = clone
            up[clone] = q
        up[new] = link[new] if link[new] > 1 else 0  # the root holds the empty string only and is left out
        last = new
        x, below = new, 0
        while x:
            splay(x)
            v = colour[x]
            if v >= 0 and (n := r - v + longest[x]) >= least_length and n >= least_exponent * (r - v):
                found[r + 1 - n, r - v] = r
            if right[x]:
                colour[right[x]] = v
            right[x] = below
            x, below = up[x], x
        colour[below] = r
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def candidates(ids: np.ndarray, doc: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of ``ids`` outside of which no run lies; ids of different documents differ."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    at = np.arange(n)
    while len(at):
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(doc[at]) != 0))))
        sizes = np.diff(np.concatenate((starts, [len(at)])))
        first, m = np.repeat(at[starts], sizes), np.repeat(sizes, sizes)
        nearest = np.minimum(np.where(before[at] >= first, at - before[at], n), np.where(after[at] < first + m, after[at] - at, n))
        keep = (m >= least_length) & (nearest * least_exponent <= m)
        if keep.all():
            return [(int(a), int(a + k)) for a, k in zip(at[starts], sizes, strict=True)]
        at = at[keep]
    return []


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, runs, collapsed), a row per row of docs.

    Words are maximal stretches of anything but ASCII white space, numbered from
    0.  ``runs`` has (start, length, period) of each maximal stretch with the
    smallest period ``period`` and a length of at least ``least_length`` words and
    ``least_exponent`` periods, by start, then period.  ``collapsed`` has the words
    that no run holds after its first period, joined by one space.  Null, empty
    and blank texts have no words and no runs.  Texts of any length are taken
    whole; one text is the work of one task, in memory in proportion to it.
    Repeated rows and null ids stay.  Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    if least_exponent < 2 or least_length < 1:
        raise ValueError("a run has at least two periods")
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            for a, b in byte_blocks(where):
                yield part(batch.column("doc_id")[a:b], [t.as_py().split() for t in column[a:b]])  # of bytes: ASCII white space only

    def part(doc_ids, texts):
        numbers, base = [], 0
        for words in texts:
            number: dict[bytes, int] = {}
            numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + base)
            base += len(number)
        sizes = np.array([len(x) for x in texts])
        ids, doc, starts = np.concatenate(numbers), np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        counts, flat = np.zeros(len(texts), np.int64), [[], [], []]
        kept = np.ones(len(ids), bool)
        for a, b in candidates(ids, doc, least_length, least_exponent):
            d = doc[a]
            for start, length, period in repetitions(ids[a:b].tolist(), least_length, least_exponent):
                for out, x in zip(flat, (a + start - starts[d], length, period), strict=True):
                    out.append(x)
                counts[d] += 1
                kept[a + start + period : a + start + length] = False
        collapsed = []
        for d, words in enumerate(texts):
            if counts[d]:
                words = [w for w, k in zip(words, kept[starts[d] : starts[d] + sizes[d]].tolist(), strict=True) if k]
            collapsed.append(b" ".join(words))
        structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], fields=list(run_type))
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(collapsed, pa.binary())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    found = small_batches(docs).select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
