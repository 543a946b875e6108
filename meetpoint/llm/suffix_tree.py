"""Score texts with a probabilistic suffix tree over words, and with word counts.

Symbols are 64-bit hashes of all lower-cased words, and an end-of-text symbol.
A context is a run of symbols before a token, the text's start counting as one.
It is retained if it is used ``least`` times, its suffix (itself less its first
symbol) is retained, and its next symbols diverge from what that suffix predicts
by a likelihood-ratio test.  Contexts grow by a symbol as long as the test
retains any, up to ``longest`` symbols.  A token is scored in the state of the longest retained context
before it.  A state's distribution takes a discount off each entry seen more
than once and all of those seen once, and deals that share as the state's suffix
would; the suffix of one symbol deals it by the word counts.

So the log probability of a token is that of its word by the counts, plus for each
retained context before it the log of the share left, plus for each entry (context,
token) seen more than once a gain.  All of these are values of 64-bit keys, and a text's
score is a sum of values.  Words, contexts and entries are distributed tables that grow
with the corpus.  The commonest keys (a bounded number) are added in the tasks; the
others are joined with the tables, but for those that a filter of fixed size rules out.
Pairs of the commonest words (a bounded number) are counted as short codes, others by
their hashes.  None of these shortcuts changes a score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, delete_shared, free_shuffles, materialise, small_batches

#: The end of a text, and what stands before its first word.
END = np.uint64(xxhash.xxh64_intdigest(b""))
#: Multipliers of the hash of a context.
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
DISCOUNT = 0.75
#: What a word used once adds to the score of the counts.
ONCE = np.log10(11.0)
#: Words whose hashes a task remembers.
HELD_WORDS = 400_000
#: Tokens that a counting task holds before it counts and emits them.
HELD_TOKENS = 1_000_000
PART_TOKENS = 500_000
#: The bits of a word's code in a pair of words, so as many words have one at most, and the pairs that a task holds.
CODE_BITS, HELD_PAIRS = 20, 4_000_000
MOST_CODED = 1 << CODE_BITS
#: Training tokens for each slice of the entries, and of the keys to look up, and the words whose contexts are split at most.
SLICE_TOKENS, LOOKUP_TOKENS, MOST_SPLIT = 1_500_000, 6_000_000, 1 << 18
#: Parts of the texts whose keys are looked up one after another, so that their shuffles share the disk.
ROUNDS = 3
#: Bits of a filter for each key, and at most: 16 MB whatever the corpus.
BITS, MOST_BITS = 16, 1 << 27


def normal(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # of bytes: ASCII letters and white space only


class Hashes(dict):
    """The hashes of the words asked for so far."""

    def __missing__(self, word: bytes) -> int:
        self[word] = xxhash.xxh64_intdigest(word)
        return self[word]


def encode(rows: DataFrame) -> DataFrame:
    """rows(doc_id, held_out, text binary) -> (doc_id, held_out, n_tokens, symbols): hashes of the words, then the end."""

    def run(batches):
        known = Hashes()
        for batch in batches:
            flat, offsets, done = [], [0], 0
            for k, value in enumerate(batch.column("text")):
                words = normal(value.as_py())
                flat.append(np.array([*map(known.__getitem__, words), int(END)], np.uint64))
                offsets.append(offsets[-1] + len(words) + 1)
                if len(known) > HELD_WORDS:
                    known.clear()
                if offsets[-1] >= PART_TOKENS or k == len(batch) - 1:
                    symbols = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
                    same = (batch.column(c).slice(done, k + 1 - done) for c in ("doc_id", "held_out"))
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.diff(offsets)), symbols], names=["doc_id", "held_out", "n_tokens", "symbols"])
                    flat, offsets, done = [], [0], k + 1

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, symbols array<long>")


def parts(column):
    """Symbols of a column in parts of whole texts: (first row, symbols, place of each in its text, first symbol of each text)."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().view(np.uint64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_TOKENS, "right")) - 1)
        s = values[offsets[at] : offsets[to]]
        starts = offsets[at:to] - offsets[at]
        yield at, s, np.arange(len(s)) - np.repeat(starts, np.diff(offsets[at : to + 1])), starts
        at = to


def mixed(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hashes of the contexts with a symbol before them."""
    x = context * MULTIPLIERS[0] + symbol
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def longer(context: np.ndarray, s: np.ndarray, index: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the contexts of ``depth`` symbols, from those of one symbol less; undefined where the text is shorter."""
    symbol = np.full(len(s), END)
    symbol[depth:] = s[:-depth]
    return mixed(context, np.where(index >= depth, symbol, END))


def key_filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """The length and bits of a bitmap of keys(key), written before: a key that has one of its two bits off is not there.

    Its length is bounded; with more keys more are looked for in vain, and the
    results stay the same.
    """
    length = min(MOST_BITS, BITS * keys.count() + 1)
    halves = F.explode(F.array("key", F.shiftrightunsigned("key", 32))).alias("half")
    slot = F.pmod("half", F.lit(length)) + 1
    blocks = keys.select(halves).groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    found = np.zeros((length // 32768 + 1) * 4096, np.uint8)
    for r in blocks:
        found[(r["block"] - 1) * 4096 : r["block"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return length, found


def may_be(filter_: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    length, bits = filter_

    def on(halves):
        slot = halves.view(np.int64) % length
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    there = on(keys)
    there[there] = on(keys[there] >> np.uint64(32))
    return there


def commonest(values: DataFrame, most: int) -> int:
    """The least number of uses at which at most ``most`` rows of values(uses) are as common, from a histogram of a thousand bins at most."""
    size = F.floor(F.log2("uses") * 16).cast("int")
    cut, taken = None, 0
    for r in sorted(values.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), F.min("uses").alias("uses")).collect(), key=lambda r: -r["size"]):
        taken += r["rows"]
        if taken > most:
            break
        cut = r["uses"]
    return (1 << 62) if cut is None else cut


class Lookup:
    """A sorted table of distinct hashes, with the place where those of each first bits begin."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 1
        self.table, self.shift = table, np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, -1 if it is not there."""
        out = np.full(len(keys), -1)
        slot = (keys >> self.shift).astype(np.int64)
        at, to = self.first[slot], self.first[slot + 1]
        rows = np.flatnonzero(at < to)
        at, to, keys = at[rows], to[rows], keys[rows]
        while len(rows):
            hit = self.table[at] == keys
            out[rows[hit]] = at[hit]
            on = np.flatnonzero(~hit & (at + 1 < to))
            rows, at, to, keys = rows[on], at[on] + 1, to[on], keys[on]
        return out


class Codes:
    """Codes of the commonest words, small for common ones; ``word`` and ``uses`` are by code."""

    def __init__(self, word: np.ndarray, uses: np.ndarray):
        self.word, self.uses = word, uses
        order = np.argsort(word)
        self.sorted, self.code = word[order], order.astype(np.int32)

    def known(self) -> Lookup:
        return Lookup(self.sorted)

    def of(self, known: Lookup, s: np.ndarray) -> np.ndarray:
        """The code of each symbol, -1 if it has none."""
        at = known.place(s)
        return np.where(at >= 0, self.code[at] if len(self.code) else 0, -1).astype(np.int64)


def word_codes(words: DataFrame, most: int) -> tuple[Codes, int]:
    """Codes of at most ``most`` words, and the least number of uses of a word that has one."""
    cut = commonest(words.select(F.col("n").alias("uses")), most)
    found = words.where(F.col("n") >= cut).toArrow()
    word, uses = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.lexsort((word, -uses))
    return Codes(word[order], uses[order]), cut


def counted(s: np.ndarray, index: np.ndarray, filters: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens to count at this depth, hash of each token's context, of that context's suffix, which tokens were counted a depth before).

    ``filters`` has for each smaller depth the retained contexts and the entries
    used often enough.  A context is counted if its suffix may be retained and
    it may be used often enough itself, which the entry that it makes up tells
    where such entries were counted.  So all its uses are counted, or none.
    """
    context, suffix = longer(np.zeros(len(s), np.uint64), s, index, 1), np.zeros(len(s), np.uint64)
    now = then = np.ones(len(s), bool)
    for depth, (kept, often) in enumerate(filters, 2):
        rows = np.flatnonzero(index >= depth - 1)
        rows = rows[may_be(kept, context[rows])]
        before = rows - 1
        rows = rows[~now[before] | may_be(often, s[before] ^ context[before])]
        then, now = now, np.zeros(len(s), bool)
        now[rows] = True
        suffix, context = context, longer(context, s, index, depth)
    return np.flatnonzero(now), context, suffix, then


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the keys are in the sorted array ``some``."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` in pieces that end before the given places."""
    offsets = np.concatenate(([0], ends)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, *map(pa.py_buffer, (offsets, np.ascontiguousarray(values)))])


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of the sorted columns ``keys`` starts."""
    return np.flatnonzero(np.concatenate(([len(keys[0]) > 0], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys]))))


def packed(context: np.ndarray, suffix: np.ndarray, key: np.ndarray, split: np.ndarray, slices: int) -> pa.RecordBatch:
    """The entries of some tokens, counted, a row for each slice: its contexts, and each one's keys and counts.

    A context's entries are in one slice, and those of a context to split are dealt by key to
    as many other slices.  Rows of a pair each would be twice as long.
    """
    order = np.argsort(key)
    key = key[order]
    first = starts_of(key)
    n = np.diff(np.append(first, len(key))).astype(np.int32)
    key, context, suffix, split = key[first], *(x[order[first]] for x in (context, suffix, split))
    of = np.uint64(slices)
    piece = np.where(split, of + key % of, context % of).astype(np.int64)
    order = np.lexsort((context, piece))
    key, n, context, suffix, piece = (x[order] for x in (key, n, context, suffix, piece))
    runs = starts_of(piece, context)
    kinds = np.diff(np.append(runs, len(key))).astype(np.int32)
    pieces = starts_of(piece)
    ends = np.append(pieces[1:], len(key))
    run_ends = np.searchsorted(runs, ends)
    columns = [pa.array(piece[pieces]), *(binaries(x, run_ends) for x in (context[runs], suffix[runs], kinds)), binaries(key, ends), binaries(n, ends)]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "contexts", "suffixes", "kinds", "keys", "n"])


def merged(table: pa.Table, least: int, whole: bool) -> pa.Table:
    """(context, key, n, own) of a slice: entries seen more than once, and each context's uses with its suffix as key.

    Of a slice that has its contexts ``whole``, those used less than ``least`` times and their entries go.
    """
    contexts, suffixes, kinds, keys, n = (
        np.frombuffer(b"".join(table.column(c).to_pylist()), d)
        for c, d in (("contexts", np.uint64), ("suffixes", np.uint64), ("kinds", np.int32), ("keys", np.uint64), ("n", np.int32))
    )
    uses = np.add.reduceat(n, np.cumsum(kinds) - kinds, dtype=np.int64)
    order = np.argsort(contexts)
    first = starts_of(contexts[order])
    uses = np.add.reduceat(uses[order], first)
    own, of = contexts[order[first]], suffixes[order[first]]
    enough = uses >= (least if whole else 0)
    holder = np.repeat(np.searchsorted(own, contexts), kinds)
    rows = np.flatnonzero(enough[holder])
    rows = rows[np.argsort(keys[rows])]
    first = starts_of(keys[rows])
    seen = np.add.reduceat(n[rows], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    first, seen = rows[first[seen > 1]], seen[seen > 1]
    columns = np.concatenate((own[holder[first]], own[enough])), np.concatenate((keys[first], of[enough])), np.concatenate((seen, uses[enough]))
    is_own = np.repeat([False, True], [len(first), enough.sum()])
    return pa.table([*(pa.array(x.view(np.int64)) for x in columns), pa.array(is_own)], names=["context", "key", "n", "own"])


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, those of one place together, as the high ones are mostly 0."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), asbytes=True)


def spread(data: bytes, kind: type, count: int) -> np.ndarray:
    """What ``squeezed`` was given."""
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=count * size), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, count).T).view(kind).ravel()


def packed_pairs(pairs: np.ndarray, split: np.ndarray, slices: int) -> pa.RecordBatch:
    """Pairs of codes of some tokens, counted, a row for each slice, as differences and counts.

    Slices follow those of ``packed``; ``split`` has for each code if its pairs are dealt out by the second word.
    """
    pairs = np.sort(pairs)
    first = starts_of(pairs)
    n = np.diff(np.append(first, len(pairs))).astype(np.int32)
    pairs = pairs[first]
    before, code = pairs >> CODE_BITS, pairs & ((1 << CODE_BITS) - 1)
    piece = 2 * slices + np.where(split[before], slices + code % slices, before % slices)
    order = np.argsort(piece.astype(np.min_scalar_type(4 * slices)), kind="stable")
    pairs, n, piece = pairs[order], n[order], piece[order]
    runs = [*starts_of(piece), len(piece)]
    rows = [(piece[a], b - a, squeezed(np.diff(pairs[a:b], prepend=0)), squeezed(n[a:b])) for a, b in zip(runs, runs[1:])]
    of, counts, keys, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    none = pa.nulls(len(rows), pa.binary())
    kinds = pa.array([int(c).to_bytes(8, "little") for c in counts], pa.binary())
    columns = [pa.array(of, pa.int64()), none, none, kinds, pa.array(keys, pa.binary()), pa.array(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "contexts", "suffixes", "kinds", "keys", "n"])


def merged_pairs(table: pa.Table, codes: Codes, norm: float) -> pa.Table:
    """(context, key, n, size, parent, kind 0) of a slice of coded pairs: the entries seen more than once."""
    rows = [(int.from_bytes(c, "little"), k, n) for c, k, n in zip(*(table.column(x).to_pylist() for x in ("kinds", "keys", "n")), strict=True)]
    pairs = np.concatenate([np.cumsum(spread(k, np.int64, c)) for c, k, _ in rows])
    n = np.concatenate([spread(x, np.int32, c) for c, _, x in rows])
    order = np.argsort(pairs)
    first = starts_of(pairs[order])
    seen = np.add.reduceat(n[order], first, dtype=np.int64)
    pairs, seen = pairs[order[first[seen > 1]]], seen[seen > 1]
    before, code = pairs >> CODE_BITS, pairs & ((1 << CODE_BITS) - 1)
    context = mixed(np.zeros(len(pairs), np.uint64), codes.word[before])
    columns = context.view(np.int64), (codes.word[code] ^ context).view(np.int64), seen, codes.uses[before], (codes.uses[code] + 0.1) / norm, np.zeros(len(pairs), np.int32)
    return pa.table([pa.array(x) for x in columns], names=["context", "key", "n", "size", "parent", "kind"])


def count_pairs(training: DataFrame, words: DataFrame, often: np.ndarray, slices: int, least: int, norm: float) -> DataFrame:
    """(context, key, n, size, parent, kind) over all tokens in contexts of one word used ``least`` times.

    A context's uses are its word's, so tokens after rarer words are left out, and
    those whose own word is seen once.  Entries of two coded words are complete
    (kind 0); of the others (kind 1), ``size`` and ``parent`` are to be found, and rows of
    kind 2 have each context of theirs with its word as key.
    """
    codes, cut = word_codes(words, MOST_CODED)
    rare = words.where(F.col("n") < cut)
    start = codes.of(codes.known(), np.array([END]))[0]
    place = codes.of(codes.known(), often)
    split = np.zeros(len(codes.word), bool)
    split[place[place >= 0]] = True
    shared = training.sparkSession.sparkContext.broadcast((codes, split, key_filter(rare.where(F.col("n") >= least)), key_filter(rare.where(F.col("n") > 1))))

    def hashed(held):
        context, word, key = (np.concatenate(x) for x in zip(*held, strict=True))
        return packed(context, word, key, among(word, often), slices)

    def run(batches):
        codes, split, contexts, symbols = shared.value
        known = codes.known()
        coded, others, sizes = [], [], [0, 0]
        for batch in batches:
            for _, s, index, starts in parts(batch.column("symbols")):
                code = codes.of(known, s)
                before, word = np.roll(code, 1), np.roll(s, 1)
                before[starts], word[starts] = start, END
                both = (code >= 0) & (before >= 0)
                rows = np.flatnonzero(both)
                rows = rows[(codes.uses[before[rows]] >= least) & (codes.uses[code[rows]] > 1)]
                coded.append(before[rows] << CODE_BITS | code[rows])
                rows = np.flatnonzero(~both)
                for of, symbol, filter_, most in ((before, word, contexts, least), (code, s, symbols, 2)):
                    there = of[rows] >= 0
                    there[there] = codes.uses[of[rows[there]]] >= most
                    rest = np.flatnonzero(of[rows] < 0)
                    there[rest] = may_be(filter_, symbol[rows[rest]])
                    rows = rows[there]
                context = mixed(np.zeros(len(rows), np.uint64), word[rows])
                others.append((context, word[rows], s[rows] ^ context))
                sizes = [sizes[0] + len(coded[-1]), sizes[1] + len(rows)]
                if sizes[0] >= HELD_PAIRS:
                    yield packed_pairs(np.concatenate(coded), split, slices)
                    coded, sizes[0] = [], 0
                if sizes[1] >= HELD_TOKENS:
                    yield hashed(others)
                    others, sizes[1] = [], 0
        if sizes[0]:
            yield packed_pairs(np.concatenate(coded), split, slices)
        if sizes[1]:
            yield hashed(others)

    def merge(key, table):
        if key[0].as_py() >= 2 * slices:
            return merged_pairs(table, shared.value[0], norm)
        found = merged(table, 0, False)
        kind = np.where(found.column("own").to_numpy(zero_copy_only=False), 2, 1).astype(np.int32)
        return pa.table([*found.columns[:3], pa.array(np.zeros(len(kind), np.int64)), pa.array(np.zeros(len(kind))), pa.array(kind)], names=["context", "key", "n", "size", "parent", "kind"])

    found = training.select("symbols").mapInArrow(run, "slice long, contexts binary, suffixes binary, kinds binary, keys binary, n binary")
    return found.groupBy("slice").applyInArrow(merge, "context long, key long, n long, size long, parent double, kind int")


def count_entries(training: DataFrame, filters: list, often: np.ndarray, large: np.ndarray, slices: int, least: int) -> DataFrame:
    """(context, key, n, own) over all tokens in contexts to count, as ``merged`` has them, for two symbols and more.

    Contexts that are a large share of a slice are split: of those that end in one of the words
    ``often``, the ones that make up one of the entries ``large`` (both sorted), or an entry that was not
    counted.  Their own rows hold parts of their uses, one for each slice, so others are left whole.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, s, index, _ in parts(batch.column("symbols")):
                rows, context, suffix, then = counted(s, index, [f.value for f in filters])
                before = rows - 1
                split = among(s[before], often)
                split[split] = among((s ^ suffix)[before[split]], large) | ~then[before[split]]
                held.append((context[rows], suffix[rows], s[rows] ^ context[rows], split))
                size += len(rows)
                if size >= HELD_TOKENS:
                    yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)), slices)
                    held, size = [], 0
        if size:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)), slices)

    def merge(key, table):
        return merged(table, least, key[0].as_py() < slices)

    found = training.select("symbols").mapInArrow(run, "slice long, contexts binary, suffixes binary, kinds binary, keys binary, n binary")
    return found.groupBy("slice").applyInArrow(merge, "context long, key long, n long, own boolean")


def count_words(training: DataFrame) -> DataFrame:
    """(key, n): the uses of each symbol."""

    def summed(held):
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        first = starts_of(keys[order])
        return keys[order[first]], np.add.reduceat(n[order], first)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, s, _, _ in parts(batch.column("symbols")):
                held.append(np.unique(s, return_counts=True))
                size += len(held[-1][0])
                if size >= HELD_TOKENS:  # few words are new after a while, so one count goes on
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size >= HELD_TOKENS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["key", "n"])
                        held, size = [], 0
        if held:
            keys, n = summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return training.select("symbols").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def retained(entries: DataFrame, evidence: float) -> DataFrame:
    """(context, size, left) of the contexts to keep, from entries(context, size, n, parent) used more than once.

    ``parent`` is the entry's probability in the context's suffix.  All symbols
    without such an entry are one outcome of the test: the ratio 2 n KL must be
    over ``evidence`` times the number of outcomes.
    """
    found = entries.groupBy("context").agg(
        F.max("size").alias("size"), F.count("*").alias("kinds"), F.sum("n").alias("seen"),
        F.sum(F.col("n") * F.log(F.col("n") / F.col("parent"))).alias("info"), F.sum("parent").alias("share"),
    )
    rest = F.col("size") - F.col("seen")
    other = F.when(rest > 0, rest * F.log(rest / F.col("size") / F.greatest(1 - F.col("share"), F.lit(1e-12)))).otherwise(0.0)
    ratio = 2 * (F.col("info") - F.col("seen") * F.log("size") + other)
    outcomes = F.col("kinds") + F.when(rest > 0, 1).otherwise(0)
    return found.where(ratio > evidence * outcomes).select("context", "size", ((DISCOUNT * F.col("kinds") + rest) / F.col("size")).alias("left"))


def grow(training: DataFrame, words: DataFrame, tokens: int, norm: float, least: int, longest: int, evidence: float) -> list[tuple[DataFrame, DataFrame]]:
    """For each depth: the retained contexts(context, size, left) and their entries(key, n, p, gain), written tables."""
    spark = training.sparkSession
    tree: list[tuple[DataFrame, DataFrame]] = []
    filters: list = []  # broadcast once each
    slices = tokens // SLICE_TOKENS + 1
    share = max(tokens // slices // 4, tokens // MOST_SPLIT)  # so there are fewer than MOST_SPLIT such words
    common = np.sort(words.where(F.col("n") > share).select("key").toArrow().column("key").to_numpy().view(np.uint64))
    while len(tree) < longest:
        if tree:
            counts = materialise(count_entries(training, filters, common, large, slices, least), "zstd", "own")
            free_shuffles(spark)
            rows, is_own = counts.where("not own").select("context", "key", "n"), F.col("own")
            contexts = counts.where("own").groupBy("context").agg(F.max("key").alias("suffix"), F.sum("n").alias("size")).where(F.col("size") >= least)
            contexts = contexts.join(tree[-1][0].select(F.col("context").alias("suffix")), "suffix", "left_semi")
            parents = tree[-1][1].select(F.col("key").alias("up"), F.col("p").alias("parent"))
        else:
            counts = materialise(count_pairs(training, words, common, slices, least, norm), "zstd", "kind")
            free_shuffles(spark)
            rows, is_own = counts.where("kind = 1").select("context", "key", "n"), F.col("kind") == 2
            uses = words.where(F.col("n") >= least).select("key", F.col("n").alias("size"))
            contexts = counts.where("kind = 2").select("context", "key").distinct().join(uses, "key").select("context", F.lit(0).cast("long").alias("suffix"), "size")
            parents = words.select(F.col("key").alias("up"), ((F.col("n") + 0.1) / norm).alias("parent"))
        up = F.col("key").bitwiseXOR(F.col("context")).bitwiseXOR(F.col("suffix"))
        joined = materialise(rows.join(contexts, "context").withColumn("up", up).join(parents, "up").select("context", "key", "n", "size", "parent"), "zstd")
        entries = joined if tree else joined.unionByName(counts.where("kind = 0").drop("kind"))
        kept = materialise(retained(entries, evidence))
        if kept.isEmpty():
            for table in (counts, joined, kept):
                free_shuffles(spark)
                delete_shared(table)
            break
        own = (F.col("n") - DISCOUNT) / F.col("size")
        below = F.col("left") * F.col("parent")
        found = entries.drop("size").join(kept, "context").select("key", "n", (own + below).alias("p"), F.log10(1 + own / below).alias("gain"))
        tree.append((kept, materialise(found, "zstd")))
        free_shuffles(spark)
        delete_shared(joined)
        often = counts.where((F.col("n") >= least) & ~is_own)
        large = np.sort(often.where(F.col("n") > share).select("key").toArrow().column("key").to_numpy().view(np.uint64))  # fewer than MOST_SPLIT too
        pair = key_filter(kept.select(F.col("context").alias("key"))), key_filter(often)
        filters.append(spark.sparkContext.broadcast(pair))
        free_shuffles(spark)
        delete_shared(counts)
    return tree


def score_tokens(common: Lookup, base: np.ndarray, gain: np.ndarray, filters: tuple, depth: int, s: np.ndarray, index: np.ndarray, trained: np.ndarray):
    """(base and gain of each token from the common keys, [tokens, their other keys] to look up).

    ``filters`` are of the other keys used more than once, and of the words used once.  In a text
    ``trained`` on, a word that is neither common nor among the former is used once.
    """
    sums, asked = [np.zeros(len(s)), np.zeros(len(s))], []
    more, once = filters

    def take(rows, keys, words=False):
        """Which of the keys are there or may be."""
        at = common.place(keys)
        there = at >= 0
        sums[0][rows[there]] += base[at[there]]
        sums[1][rows[there]] += gain[at[there]]
        others = np.flatnonzero(~there)
        ask = may_be_sliced(more, keys[others])
        if words:
            no = ~ask
            own = trained[rows[others]]
            sums[0][rows[others[no & own]]] += ONCE
            new = np.flatnonzero(no & ~own)
            ask[new] = may_be_sliced(once, keys[others[new]])
        others = others[ask]
        asked.append((rows[others], keys[others]))
        there[others] = True
        return there

    rows = np.arange(len(s))
    take(rows, s, True)
    context = np.zeros(len(s), np.uint64)
    for d in range(1, depth + 1):
        context = longer(context, s, index, d)
        rows = rows[index[rows] >= d - 1]
        rows = rows[take(rows, context[rows])]
        take(rows, s[rows] ^ context[rows])
    return *sums, tuple(np.concatenate(x) for x in zip(*asked, strict=True))


def by_slice(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys by slice, the slices there, where each one's keys end)."""
    piece = keys.view(np.int64) % slices
    order = np.argsort(piece.astype(np.min_scalar_type(slices)), kind="stable")
    first = starts_of(piece[order])
    return order, piece[order[first]], np.append(first[1:], len(keys))[: len(first)]


def bitmap(keys: np.ndarray, most: int) -> bytes:
    """A filter of keys like that of ``key_filter``, for one slice."""
    length = min(most, BITS * len(keys)) // 8 * 8
    if not length:
        return b""
    found = np.zeros(length, bool)
    for half in (keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)):
        found[half % np.uint64(length)] = True
    return np.packbits(found, bitorder="little").tobytes()


def joined_bitmaps(found: dict[int, bytes], slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each slice's bitmap, where it begins, all bits)."""
    pieces = [found.get(k, b"") for k in range(slices)]
    lengths = np.array([8 * len(x) for x in pieces])
    return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(pieces) or b"\0", np.uint8)


def may_be_sliced(filter_: tuple, keys: np.ndarray) -> np.ndarray:
    lengths, begins, bits = filter_
    piece = keys.view(np.int64) % len(lengths)
    length, begin = lengths[piece], begins[piece]
    there = length > 0

    def on(halves, rows):
        slot = begin[rows] + halves[rows].view(np.int64) % length[rows]
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    for halves in (keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)):
        rows = np.flatnonzero(there)
        there[rows] = on(halves, rows)
    return there


def sliced_values(rest: DataFrame, slices: int) -> DataFrame:
    """(slice, keys, values, words, more, once) of rest(key, value, word, once): a row each, sorted by key, with filters of the keys."""

    def emitted(held):
        keys, values, words, once = (np.concatenate(x) for x in zip(*held, strict=True))
        order, pieces, ends = by_slice(keys, slices)
        flags = words[order] + 2 * once[order].astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array(pieces), binaries(keys[order], ends), binaries(values[order], ends), binaries(flags, ends)], names=["slice", "keys", "values", "flags"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "value", "word", "once")))
            size += len(batch)
            if size >= HELD_TOKENS:
                yield emitted(held)
                held, size = [], 0
        if size:
            yield emitted(held)

    def join(key, table):
        keys, values, flags = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("keys", np.uint64), ("values", float), ("flags", np.uint8)))
        order = np.argsort(keys)
        keys, values, flags = keys[order], values[order], flags[order]
        once = flags > 1
        most = MOST_BITS // slices
        row = [key[0].as_py(), keys.tobytes(), values.tobytes(), (flags & 1).tobytes(), bitmap(keys[~once], most), bitmap(keys[once], most)]
        return pa.table([[x] for x in row], names=["slice", "keys", "values", "words", "more", "once"])

    return rest.mapInArrow(run, "slice long, keys binary, values binary, flags binary").groupBy("slice").applyInArrow(join, "slice long, keys binary, values binary, words binary, more binary, once binary")


def asking(docs: np.ndarray, sums: np.ndarray, rows: np.ndarray, keys: np.ndarray, slices: int) -> pa.RecordBatch:
    """The sums of a block of texts, and keys to look up for them by their places in it: a row for each slice of the keys."""
    order, pieces, ends = by_slice(keys, slices)
    pieces = np.append(pieces, docs[0] % slices)  # the sums go to any slice
    nothing = np.zeros(len(ends), np.int64)
    columns = [
        pa.array(pieces), pa.array(np.full(len(pieces), docs[0])), binaries(docs, np.append(nothing, len(docs))), binaries(sums.ravel(), np.append(nothing, sums.size)),
        *(binaries(x[order], np.append(ends, len(keys))) for x in (rows.astype(np.int32), keys)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "block", "docs", "sums", "rows", "keys"])


def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """(block, docs, sums, rows, found) for each row of ``asked``: what its keys add to the texts in those places of its block."""
    rows, keys = (np.frombuffer(b"".join(asked.column(c).to_pylist()), d) for c, d in (("rows", np.int32), ("keys", np.uint64)))
    sizes = [len(x) // 8 for x in asked.column("keys").to_pylist()]
    ids, found = np.zeros(0, np.int64), np.zeros((0, 3))
    if len(keys) and len(known):
        table, values, words = (np.frombuffer(known.column(c)[0].as_py(), d) for c, d in (("keys", np.uint64), ("values", float), ("words", np.uint8)))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        there = np.flatnonzero(table[at] == keys)
        at = at[there]
        ids, which = np.unique((np.repeat(np.arange(len(sizes)), sizes) << 32)[there] + rows[there], return_inverse=True)
        found = np.stack([np.bincount(which, x, len(ids)) for x in (values[at] * words[at], values[at] * (1 - words[at].astype(float)), words[at])], axis=1)
    ends = np.searchsorted(ids >> 32, np.arange(len(sizes)), "right")
    columns = binaries((ids & 0xFFFFFFFF).astype(np.int32), ends), binaries(found.ravel(), 3 * ends)
    return pa.table([*(asked.column(c) for c in ("block", "docs", "sums")), *columns], names=["block", "docs", "sums", "rows", "found"])


def summed_up(table: pa.Table) -> pa.Table:
    """(k, base, gain, known) of the texts k of a block, from all its rows of ``answered``."""
    docs, sums, rows, found = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in (("docs", np.int64), ("sums", float), ("rows", np.int32), ("found", float)))
    more = (np.bincount(rows, x, len(docs)) for x in found.reshape(-1, 3).T)
    return pa.table([docs, *(x + y for x, y in zip(sums.reshape(-1, 3).T, more, strict=True))], names=["k", "base", "gain", "known"])


def score_texts(docs: DataFrame, folds: int = 10, least: int = 16, longest: int = 4, evidence: float = 2.0, most_common: int = 2_000_000) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Training texts are those whose crc32(doc_id as text) modulo ``folds`` is not
    0 (a null id counts as empty text).  Tokens are the lower-cased words and an
    end; a null text has just the end.  Every row is scored, repeated ones each;
    an empty table gives no rows, and without training texts N, V and all counts
    are 0 and the scores are those of the counts.  A context is retained from
    ``least`` uses on, whatever the corpus, and has at most ``longest`` symbols, the
    order of the model.  At most ``most_common`` keys go to
    the tasks, which saves shuffling and changes no score.  Two words with one
    64-bit hash would count as one.  Long texts are scored whole.  Other columns
    are not read, so their names do not matter.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), (crc_mod("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    corpus = materialise(encode(rows).withColumn("row", F.monotonically_increasing_id()), "zstd")
    training = corpus.where("not held_out")
    words = materialise(count_words(training))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = n + 0.1 * (v + 1)
    tree = grow(training, words, n, norm, least, longest, evidence)
    none = F.lit(0.0)
    tables = [words.select("key", F.col("n").alias("uses"), F.log10(F.col("n") * 10 + 1).alias("base"), none.alias("gain"))]
    for kept, entries in tree:
        tables.append(kept.select(F.col("context").alias("key"), F.col("size").alias("uses"), none.alias("base"), F.log10("left").alias("gain")))
        tables.append(entries.select("key", F.col("n").alias("uses"), none.alias("base"), "gain"))
    values = reduce(DataFrame.unionByName, tables)
    cut = commonest(values, most_common)
    top = values.where(F.col("uses") >= cut).select("key", "base", "gain").toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    base, gain = (top.column(c).to_numpy()[order] for c in ("base", "gain"))
    common = keys[order], base + gain, base > 0  # a word has no gain, other keys no base
    slices = n // LOOKUP_TOKENS + 1
    word = F.col("base") > 0
    rest = materialise(sliced_values(values.where(F.col("uses") < cut).select("key", (F.col("base") + F.col("gain")).alias("value"), word.alias("word"), (word & (F.col("uses") == 1)).alias("once")), slices), "zstd")
    free_shuffles(spark)
    bits = rest.select("slice", "more", "once").toArrow()
    filters = tuple(joined_bitmaps(dict(zip(bits.column("slice").to_pylist(), bits.column(c).to_pylist(), strict=True)), slices) for c in ("more", "once"))
    shared = spark.sparkContext.broadcast((common, filters))
    depth = len(tree)

    def run(batches):
        (keys, value, word), filters = shared.value
        known = Lookup(keys), value * word, value * ~word, filters, depth
        for batch in batches:
            row, trained = batch.column("row").to_numpy(), ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for at, s, index, starts in parts(batch.column("symbols")):
                here = slice(at, at + len(starts))
                text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
                base_of, gain_of, (tokens, asked) = score_tokens(*known, s, index, trained[here][text])
                sums = np.stack([np.add.reduceat(x, starts) for x in (base_of, gain_of, (base_of > 0).astype(float))], axis=1)
                yield asking(row[here], sums, text[tokens], asked, slices)

    def answer(key, asked, known):
        return answered(asked, known)

    def sum_up(key, table):
        return summed_up(table)

    def looked_up(texts):
        """The sums of some of the texts, a written table."""
        asked = texts.select("row", "held_out", "symbols").mapInArrow(run, "slice long, block long, docs binary, sums binary, rows binary, keys binary")
        answers = asked.groupBy("slice").cogroup(rest.groupBy("slice")).applyInArrow(answer, "block long, docs binary, sums binary, rows binary, found binary")
        return materialise(answers.groupBy("block").applyInArrow(sum_up, "k long, base double, gain double, known double"))

    found = None
    for part in range(ROUNDS):
        free_shuffles(spark)
        sums = looked_up(corpus.where(F.col("row") % ROUNDS == part))
        found = sums if found is None else found.unionByName(sums)
    # a token adds log10(0.1 / norm), and log10((c + 0.1) / 0.1) if it is known
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(norm * 10))
    return corpus.join(found, F.col("row") == F.col("k")).select(
        "doc_id", "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )
