"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and put together in another order.

The cuts are counted in code points, but found in the UTF-8 bytes eight at a
time (SWAR).  The bytes of many texts are viewed as 64-bit words; a few bitwise
operations mark each byte that ends a code point, one bit count gives the marks
of a word, and the counts are summed up.  The end of the k-th code point is then
found by a binary search for its word and a multiplication that sums up the
marks within the word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, small_batches

#: Marks of the three parts; a text that holds one stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
HIGH = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)


class Units:
    """Code points of texts that lie one after another in ``data``; text d is data[offsets[d]:offsets[d + 1]].

    A byte ends a unit if the next one is no continuation byte, or if its text
    ends; so a stray continuation byte belongs to the unit before it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        padded = np.zeros(8 * (len(data) // 8 + 2), np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        begins = HIGH & ~(words & ~(words << np.uint64(1)))  # all but bytes 10xxxxxx
        begins.view(np.uint8)[offsets] = 0x80
        self.ends = begins[:-1] >> np.uint64(8) | begins[1:] << np.uint64(56)
        self.offsets = offsets
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))
        self.rank = self.before[offsets >> 3] + np.bitwise_count(self.ends[offsets >> 3] & ((np.uint64(1) << (8 * (offsets & 7)).astype(np.uint64)) - np.uint64(1)))

    def counts(self) -> np.ndarray:
        return np.diff(self.rank)

    def cut(self, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Where in ``data`` the first ``units`` units of each of ``texts`` end."""
        k = self.rank[texts] + units
        word = np.searchsorted(self.before[1:], k)
        word = np.minimum(word, len(self.ends) - 1)
        rest = (k - self.before[word]).astype(np.uint64)
        sums = (self.ends[word] >> np.uint64(7)) * ONES  # of the marks up to each byte of the word
        reached = ((sums | HIGH) - rest * ONES) & HIGH
        at = 8 * word + 8 - np.bitwise_count(reached) + 1
        return np.where(units == 0, self.offsets[texts], at)


def seeds(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``seed:doc_id``; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n, form, prefix_chars, middle_chars, output), a row per row of docs.

    ``form`` is psm (prefix, suffix, middle), spm (suffix first) or plain; cuts
    and form hang on ``seed`` and doc_id alone.  Null and empty texts, texts that
    hold a mark, and ``plain_percent`` of the others are plain: the output is the
    text, and prefix_chars and middle_chars are null.  Repeated rows and ids give
    equal rows, a null id counts as empty text.  Texts of any length are taken
    whole.  Other columns of the input are ignored, whatever their names; an
    empty table gives no rows.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            draws = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            for a, b in byte_blocks(where):
                block = slice(a, b)
                yield part(batch.column("doc_id")[block], where[a : b + 1] - where[a], data[where[a] : where[b]], *(h[block] for h in draws))

    def part(ids, offsets, data, h1, h2, h3, h4):
        units, every = Units(data, offsets), np.arange(len(ids))
        n, whole = units.counts(), data.tobytes()
        first, second = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
        one, two = units.cut(every, first).tolist(), units.cut(every, second).tolist()
        plain, spm = h3 % 100 >= 100 - plain_percent, h4 % 100 < spm_percent
        forms, outputs = [], []
        for d, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = whole[start:end]
            if plain[d] or not text or any(m in text for m in marks):
                forms.append("plain")
                outputs.append(text)
                continue
            prefix, middle, suffix = whole[start : one[d]], whole[one[d] : two[d]], whole[two[d] : end]
            forms.append("spm" if spm[d] else "psm")
            outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle) if spm[d] else (marks[0], prefix, marks[1], suffix, marks[2], middle)))
        moved = np.array([f != "plain" for f in forms], bool)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(forms, pa.string()), pa.array(first, mask=~moved), pa.array(second - first, mask=~moved), pa.array(outputs, pa.binary())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = small_batches(docs).select(F.col("doc_id").cast("long"), text.alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(seeds(F.col("doc_id"), seed), 1)])
    moved = narrow.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return moved.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The exact text that ``fill_in_middle`` made ``output`` of; no two parts can make up a mark at their seam."""
    head = F.substring_index(F.substr(output, F.lit(len(PREFIX) + 1)), MIDDLE, 1)  # the two outer parts
    middle = F.substring_index(output, MIDDLE, -1)

    def outer(mark: str) -> tuple[Column, Column]:
        return F.substring_index(head, mark, 1), F.substring_index(head, mark, -1)

    (prefix, suffix), (last, first) = outer(SUFFIX), outer(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, middle, last)).otherwise(output)
