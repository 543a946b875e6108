"""Language identification with a byte convolutional network, trained in numpy.

Texts are cut into fixed-length windows of bytes.  A byte is embedded, filters
of widths 2, 4 and 6 run over it in steps of two bytes, each filter keeps its
maximum over the window, and a softmax layer gives the language.  As filters
step by two bytes, their inner products are sums of table entries for byte
pairs, which makes whole texts cheap to score: a document's probabilities are
the mean over all its windows.

The network is fitted on the driver on a bounded sample of labelled windows
(``sample`` of them, the same number per language, chosen by hash); the fitted
tables (under 40 MB) go to the tasks as a broadcast of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc_mod, small_batches

WINDOW = 256
WIDTHS = (2, 4, 6)
PAIRS = max(WIDTHS) // 2
FILTERS = 12  # of each width
EMBEDDING = 8
UNDETERMINED = "und"
LEAST_WINDOWS = 20
LETTER = r"\p{L}"


@dataclass
class Network:
    """Fitted parameters, and the byte-pair tables made from them."""

    classes: list[str]
    tables: list[np.ndarray]  # per pair of bytes in a filter: (65536, filters)
    bias: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray


def as_pairs(windows: np.ndarray) -> np.ndarray:
    """Windows of bytes as little-endian byte pairs."""
    return np.ascontiguousarray(windows).view("<u2")


def filter_mask() -> np.ndarray:
    """(bytes, filters): 1 where a filter's width covers the byte."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.arange(max(WIDTHS))[:, None] < widths[None, :]).astype(np.float32)


def fit(windows: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 12, seed: int = 7, rate: float = 0.01) -> Network:
    """Train the network on windows (n, WINDOW) of bytes by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    n_filters, n_classes = FILTERS * len(WIDTHS), len(classes)
    mask = filter_mask()
    p = {
        "e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "w": (rng.normal(0, 0.3, (max(WIDTHS), EMBEDDING, n_filters)) * mask[:, None, :]).astype(np.float32),
        "b": np.zeros(n_filters, np.float32),
        "v": rng.normal(0, 0.1, (n_filters, n_classes)).astype(np.float32),
        "c": np.zeros(n_classes, np.float32),
    }
    mean, square = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    spots = WINDOW // 2 - PAIRS + 1
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x = windows[rows]
            n = len(rows)
            embedded = p["e"][x]
            view = np.stack([embedded[:, j : j + 2 * spots : 2] for j in range(max(WIDTHS))], axis=2)  # n, spots, bytes, EMBEDDING
            h = view.reshape(n * spots, -1) @ p["w"].reshape(-1, n_filters)
            h = h.reshape(n, spots, n_filters)
            best = h.argmax(axis=1)
            top = np.take_along_axis(h, best[:, None, :], axis=1)[:, 0] + p["b"]
            active = np.maximum(top, 0)
            z = active @ p["v"] + p["c"]
            z -= z.max(axis=1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(axis=1, keepdims=True)
            dz = prob.copy()
            dz[np.arange(n), labels[rows]] -= 1
            dz /= n
            dtop = (dz @ p["v"].T) * (top > 0)
            picked = view[np.arange(n)[:, None], best]  # n, filters, bytes, EMBEDDING
            grad = {"v": active.T @ dz, "c": dz.sum(0), "b": dtop.sum(0)}
            grad["w"] = np.einsum("nf,nfje->jef", dtop, picked) * mask[:, None, :]
            into = np.einsum("nf,jef->nfje", dtop, p["w"])
            where = x[np.arange(n)[:, None, None], best[:, :, None] * 2 + np.arange(max(WIDTHS))]
            grad["e"] = np.zeros_like(p["e"])
            np.add.at(grad["e"], where.ravel(), into.reshape(-1, EMBEDDING))
            step += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                square[k] = 0.999 * square[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate / (1 + epoch / 4) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    single = np.einsum("xe,jef->jxf", p["e"], p["w"]).astype(np.float32)
    tables = [(single[2 * j][None, :, :] + single[2 * j + 1][:, None, :]).reshape(65536, n_filters) for j in range(PAIRS)]
    return Network(classes, tables, p["b"], p["v"], p["c"])


def window_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(n, classes) for windows (n, WINDOW) of bytes."""
    out = np.empty((len(windows), len(net.classes)), np.float32)
    pairs = as_pairs(windows)
    spots = pairs.shape[1] - PAIRS + 1
    for at in range(0, len(pairs), 64):
        part = pairs[at : at + 64]
        h = net.tables[0][part[:, :spots]]
        for j in range(1, PAIRS):
            h += net.tables[j][part[:, j : j + spots]]
        z = np.maximum(h.max(axis=1) + net.bias, 0) @ net.weights + net.offsets
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[at : at + 64] = z / z.sum(axis=1, keepdims=True)
    return out


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as windows, blanks filling the last of each; and windows per text.

    A text with a length over one window is covered to its end by whole windows:
    the last one starts WINDOW bytes before the end.
    """
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    out = np.full((counts.sum(), WINDOW), 32, np.uint8)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        data = np.frombuffer(text, np.uint8)
        whole = len(data) // WINDOW
        out[at : at + whole] = data[: whole * WINDOW].reshape(whole, WINDOW)
        if whole < n:
            tail = data[-WINDOW:]
            out[at + n - 1, : len(tail)] = tail
        at += n
    return out, counts


def train(docs: DataFrame, sample: int = 6000, seed: str = "langid") -> Network | None:
    """Fit a network on docs(doc_id, text, lang): about ``sample`` windows in all, and ``LEAST_WINDOWS`` of each language at least.

    Only documents outside the held-out fold with a label and a letter are
    used, for each language about the same number, chosen by a hash of id and text; of
    each, one window at a hashed place.  Repeated rows give one window.  The sample
    size is a parameter of the training alone; all languages are learned (the driver
    sees their names and sizes).  None if there is nothing to learn from.
    """
    labelled = docs.where((crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(LEAST_WINDOWS, sample // len(sizes))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))]), F.col("lang"))
    roll = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1_000_000)) / 1e6
    data = F.col("text").cast("binary")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit(1)), F.greatest(F.lit(1), F.length(data) - WINDOW + 1)) + 1
    window = F.substring(data, start.cast("int"), F.lit(WINDOW))
    rows = labelled.where(roll < share).select("lang", window.alias("w")).distinct().orderBy("lang", "w").collect()
    if not rows:
        return None
    classes = sorted({r["lang"] for r in rows})
    windows = cut([bytes(r["w"]) for r in rows])[0]
    return fit(windows, np.array([classes.index(r["lang"]) for r in rows]), classes)


def identify(docs: DataFrame, net: Network | None, keep: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) with lang_pred and score; just doc_id and those unless ``keep``.

    The score is the mean probability of the predicted language over all
    windows of the text.  A null text or one without a letter is ``und`` with
    score 1, as is every text (score 0) if there is no network.
    """
    names = docs.columns if keep else ["doc_id"]
    text = [] if "text" in names else [F.col("text")]
    rows = small_batches(docs).select(*names, *text, F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("__letter"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        network = shared.value
        for batch in batches:
            letters = batch.column("__letter").to_pylist()
            column = batch.column("text").cast(pa.binary())
            pred, score = [UNDETERMINED] * len(letters), np.where(letters, 0.0, 1.0)
            todo = [i for i, x in enumerate(letters) if x] if network else []
            while todo:  # parts of some MB, so that long texts don't pile up
                part, size = [], 0
                while todo and size < 4 << 20:
                    i = todo.pop()
                    part.append((i, column[i].as_py()))
                    size += len(part[-1][1])
                windows, counts = cut([t for _, t in part])
                probs = np.concatenate([window_probabilities(network, windows[at : at + 4096]) for at in range(0, len(windows), 4096)])
                means = np.add.reduceat(probs.astype(np.float64), np.cumsum(counts) - counts, axis=0) / counts[:, None]
                for (i, _), best, p in zip(part, means.argmax(axis=1), means.max(axis=1), strict=True):
                    pred[i], score[i] = network.classes[best], min(1.0, float(p))
            columns = [batch.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    schema = StructType([*rows.select(*names).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, sample: int = 6000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    The network learns from text and lang of the documents whose crc32(doc_id as
    text) modulo 5 is not 0 (a null id counts as empty text, so it is held out).
    Predictions see the text alone.  Repeated rows are predicted each; an empty
    table gives no rows.
    """
    net = train(docs, sample)
    return identify(docs, net).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3, sample: int = 6000) -> DataFrame:
    """The rows of docs whose text has a language, by a score of at least ``min_score``; columns as they are.

    Null and empty texts and texts without a letter go; long texts are scored whole;
    repeated rows stay or go together; a null id is an id like any other.  An empty
    table gives no rows, and without any labelled text all rows go.  Columns may have
    any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = identify(docs.select("text", row), train(docs, sample), keep=True)
    return marked.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
