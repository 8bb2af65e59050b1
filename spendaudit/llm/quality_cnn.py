"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes pass through learned filters of ``WIDTH`` bytes. Each filter's answers are max-pooled over overlapping chunks
that cover the whole document, whatever its length; over the chunks of a document the pooled answers are averaged, and their
least and largest are taken; a logistic layer combines these into the probability of label 1. Byte, place and filter form a
weight table, so that the filters are sums of table rows; for scoring, the tables of two neighbouring bytes are added up once.

The network is fitted on at most ``MOST_ROWS`` labelled rows, half of them of either label where there are enough, those with
the least hash of their id. Of each, up to ``SEGMENTS`` evenly spaced stretches of ``SEGMENT_BYTES`` bytes are used for
fitting. Scoring reads whole texts. Labels are learned from rows whose crc32 of the id as text is no multiple of 5.

Results for odd input: a null or empty text is scored as a chunk of zero bytes; a null id is never held out; several labels of
one id count as their least; rows without a label or id teach nothing; without labels of both kinds every score is the share of
label 1, or 0.5 without any; very long texts are scored in pieces of bounded size; equal texts get equal scores, one row each;
an empty table gives an empty table; other columns are not read (the filter passes them on unread).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit.llm.common import id_and_text, map_rows, on_workers
from spendaudit.session import materialize

WIDTH = 6
FILTERS = 16
#: A chunk is two neighbouring blocks, so each byte lies in two chunks.
BLOCK = 128
MOST_ROWS = 4000
SEGMENTS = 6
SEGMENT_BYTES = 1024
#: Bytes scored at a time.
PIECE = 1 << 16
THRESHOLD = 0.3


@dataclass(frozen=True)
class Network:
    """filters: (WIDTH, 256, FILTERS); weights of the mean, least and largest pooled answers; both biases."""

    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float

    def pair_tables(self) -> list[np.ndarray]:
        """For each two places of the filters, the sum of their rows for every two bytes."""
        w = self.filters.astype(np.float32)
        return [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(1 << 16, -1) for j in range(0, WIDTH, 2)]


def as_bytes(text: str | None) -> np.ndarray:
    """The text's bytes, with zero bytes after it up to one block at least."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(data + bytes(max(WIDTH, BLOCK + WIDTH - 1 - len(data))), np.uint8)


def block_maxima(data: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Largest answer of each filter in each block of places, (blocks, filters)."""
    places = len(data) - WIDTH + 1
    found = []
    for at in range(0, places, PIECE):
        piece = data[at : min(at + PIECE, places) + WIDTH - 1].astype(np.int32)
        pairs = (piece[:-1] << 8) + piece[1:]
        n = len(piece) - WIDTH + 1
        answers = tables[0].take(pairs[:n], axis=0)
        for k, table in enumerate(tables[1:], 1):
            answers += table.take(pairs[2 * k : 2 * k + n], axis=0)
        found.append(np.maximum.reduceat(answers, np.arange(0, n, BLOCK), axis=0))
    return np.concatenate(found)


def pooled(blocks: np.ndarray) -> np.ndarray:
    """Chunk maxima from block maxima: each chunk is two neighbouring blocks."""
    return np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks


def combine(chunks: np.ndarray, network: Network) -> float:
    active = np.maximum(chunks + network.filter_bias, 0)
    z = np.concatenate([active.mean(0), active.min(0), active.max(0)]) @ network.weights + network.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[list[bytes]], labels: list[int], epochs: int = 14, least_steps: int = 400, seed: int = 7) -> Network:
    """Adam on the logistic loss; only the places of the pooled maxima have gradients."""
    random = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    params = {
        "w": random.normal(0, 0.15, (WIDTH, 256, FILTERS)), "b": np.full(FILTERS, 0.1), "v": random.normal(0, 0.1, 3 * FILTERS), "c": np.zeros(1)
    }
    if len(set(labels)) < 2:
        odds = 0.0 if not 0 < share < 1 else np.log(share / (1 - share))
        constant = odds if len(set(labels)) != 1 else (30.0 if share == 1 else -30.0)
        return Network(params["w"] * 0, params["b"] * 0, params["v"] * 0, constant)
    chunk_rows, owner = [], []
    for k, segments in enumerate(texts):
        for segment in segments:
            data = np.frombuffer(segment + bytes(max(WIDTH, BLOCK + WIDTH - 1 - len(segment))), np.uint8)
            size = 2 * BLOCK + WIDTH - 1
            for at in range(0, max(1, len(data) - BLOCK - WIDTH + 1), BLOCK):
                chunk = data[at : at + size]
                chunk_rows.append(np.pad(chunk, (0, size - len(chunk))))
                owner.append(k)
    x, owner = np.stack(chunk_rows), np.array(owner)
    starts = np.searchsorted(owner, np.arange(len(texts)))
    counts = np.diff(np.append(starts, len(owner)))
    moments = {name: (np.zeros_like(p), np.zeros_like(p)) for name, p in params.items()}
    step, filters = 0, np.arange(FILTERS)
    for _ in range(max(epochs, -(-least_steps * 64 // len(texts)))):
        order = random.permutation(len(texts))
        for some in np.array_split(order, max(1, len(order) // 64)):
            rows = np.concatenate([np.arange(starts[k], starts[k] + counts[k]) for k in some])
            edges = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            xs = x[rows].astype(np.int32)
            n = xs.shape[1] - WIDTH + 1
            w32 = params["w"].astype(np.float32)
            answers = w32[0].take(xs[:, :n], axis=0)
            for j in range(1, WIDTH):
                answers += w32[j].take(xs[:, j : j + n], axis=0)
            where = answers.argmax(1)  # (chunks, filters)
            best = np.take_along_axis(answers, where[:, None, :], 1)[:, 0, :].astype(np.float64) + params["b"]
            active = np.maximum(best, 0)
            mean = np.add.reduceat(active, edges, axis=0) / counts[some][:, None]
            low, high = np.minimum.reduceat(active, edges, axis=0), np.maximum.reduceat(active, edges, axis=0)
            features = np.concatenate([mean, low, high], axis=1)
            p = 1 / (1 + np.exp(-np.clip(features @ params["v"] + params["c"], -30, 30)))
            dz = (p - y[some]) / len(some)
            grads = {"v": features.T @ dz + 1e-4 * params["v"], "c": np.array([dz.sum()])}
            df = dz[:, None] * params["v"][None, :]
            mine = np.repeat(np.arange(len(some)), counts[some])
            spread = df[mine, :FILTERS] / counts[some][mine][:, None]
            spread += df[mine, FILTERS : 2 * FILTERS] * (active == low[mine])
            spread += df[mine, 2 * FILTERS :] * (active == high[mine])
            spread *= best > 0
            grads["b"] = spread.sum(0)
            grads["w"] = np.zeros_like(params["w"])
            for j in range(WIDTH):
                letters = np.take_along_axis(xs, where + j, 1)
                np.add.at(grads["w"][j], (letters, filters[None, :]), spread)
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(params["w"].astype(np.float32), params["b"], params["v"], float(params["c"][0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """segments (array of binary), label: at most ``most_rows`` rows, a half of either label at most.

    The chosen ids are at most ``most_rows``, so they may be broadcast: the documents are read once and not shuffled.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    usable = usable.filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    half = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows // 2) for k in (0, 1)]
    chosen = materialize(half[0].unionByName(half[1]), "chosen-labels")
    rows = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]) if most_rows <= 100_000 else docs.join(chosen, "doc_id").dropDuplicates(["doc_id"])
    data = F.coalesce("text", F.lit("")).cast("binary")
    size = F.octet_length(data)
    apart = F.greatest(F.lit(SEGMENT_BYTES), F.floor((size - SEGMENT_BYTES) / (SEGMENTS - 1)))
    starts = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda k: k * apart)
    segments = F.transform(F.filter(starts, lambda s: (s == 0) | (s < size)), lambda s: F.substring(data, (s + 1).cast("int"), F.lit(SEGMENT_BYTES)))
    return rows.select("doc_id", "label", segments.alias("segments"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Network:
    """Fit on the bounded sample; at most most_rows x SEGMENTS x SEGMENT_BYTES bytes come to the driver."""
    rows = sorted(training_rows(docs, labels, most_rows).collect(), key=lambda r: r.doc_id)
    return fit([[bytes(s) for s in r.segments] for r in rows], [r.label for r in rows])


def scorer(network: Network) -> Callable[[str | None], float]:
    tables = network.pair_tables()
    return lambda text: combine(pooled(block_maxima(as_bytes(text), tables)), network)


def score_documents(docs: DataFrame, network: Network, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and prediction of every document; one map, no shuffle."""

    def make():
        score = scorer(network)

        def row(doc_id, text):
            found = score(text)
            return doc_id, found, int(found >= threshold)

        return row

    texts = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return map_rows(texts, make, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, network: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        score = scorer(network)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return on_workers(docs).mapInArrow(run, docs.schema)
