"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 6).

Training reads at most ``train_rows`` labelled documents (the smallest hashes of their ids; whole texts). Counts of
rows per class and n-gram are summed by Spark. The n-grams whose ratio, for either class, is ``MIN_Z`` of its own standard
errors away from none stay: a rule without a limit on their number that holds for few rows as for many. A logistic regression on
presence times ratio is fitted on them.
Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, read_table

ORDERS = (3, 4, 5, 6)
BITS = 20
TRAIN_ROWS = 6_000
MIN_Z = 2.5
THRESHOLD = 0.3

_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of each run of ``order`` code points (uint64 array), as an index below 2 ** BITS."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = codes[:n] + np.uint64(order)
    for j in range(1, order):
        h = h * _P + codes[j : j + n]
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased code points with runs of white space as one space, and a space at both ends."""
    text = " " + " ".join((text or "").lower().split()) + " "
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def distinct_grams(text: str | None, kept: np.ndarray | None = None, step: int = 1 << 18) -> np.ndarray:
    """Sorted distinct n-gram indices of a text; only those with ``kept[index]`` if given. Any length, bounded memory."""
    codes, found = code_points(text), []
    for at in range(0, len(codes), step):
        part = codes[at : at + step + max(ORDERS) - 1]
        for order in ORDERS:
            h = gram_hashes(part, order)
            found.append(np.unique(h) if kept is None else np.unique(h[kept[h]]))
    return np.unique(np.concatenate(found))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ones, zeros = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for b in batches:
        for text, y in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
            (ones if y else zeros)[distinct_grams(text.as_py())] += 1
    seen = np.flatnonzero(ones + zeros)
    for at in range(0, len(seen), 100_000):
        x = seen[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(ones[x].astype(np.int64)), pa.array(zeros[x].astype(np.int64))], names=["gram", "ones", "zeros"])


def _rows(kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [distinct_grams(t.as_py(), kept).astype(np.int32).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["label", "grams"])

    return run


def _fit(y: np.ndarray, begin: np.ndarray, col: np.ndarray, ratio: np.ndarray, l2: float = 0.5, steps: int = 200, block: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on x = ratio[col] for the columns present in each row (``col[begin[r] : begin[r + 1]]``); Adam on all
    rows, ``block`` of them at a time, so that little is held beside the columns."""
    n, d = len(y), len(ratio)
    w, b = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    # rows of long texts hold more n-grams by chance: each row is scaled by the root of what it holds
    norm = 1 / np.sqrt(1 + np.diff(begin))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb, wr = l2 * w / n, 0.0, w * ratio
        for low in range(0, n, block):
            high = min(n, low + block)
            own, row = col[begin[low] : begin[high]], np.repeat(np.arange(high - low), np.diff(begin[low : high + 1]))
            z = np.bincount(row, wr[own], high - low) * norm[low:high] + b
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[low:high]) / n
            g += np.bincount(own, (e * norm[low:high])[row], d) * ratio
            gb += float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 + t / 200)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> dict:
    """Model from labelled rows that are not held out: {"weight": float32 table by n-gram index, "bias": float}.

    Null ids, null labels and null texts teach nothing; without labelled rows of both kinds all texts score the share of ones.
    Several labels of one id: the largest counts; of several texts of one id the least teaches. Only doc_id and the label are read from ``labels``.
    """
    some = (
        labels.where(f"doc_id is not null and {label} is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    # at most train_rows pairs of numbers: small enough to send everywhere whatever the corpus
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    # one row an id, the least of its texts
    sample = materialize(sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label").repartition(8), "toxicity-sample")
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    weight = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return {"weight": weight, "bias": float(np.log((n1 + 1) / (n0 + 1)))}
    counts = sample.mapInArrow(_count, "gram int, ones long, zeros long").groupBy("gram").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    ratio = F.log((F.col("ones") + 0.5) / (n1 + 1)) - F.log((F.col("zeros") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("ones") + 0.5) + 1 / (F.col("zeros") + 0.5))
    chosen = counts.withColumn("ratio", ratio).where(F.abs("ratio") >= error * MIN_Z).select("gram", "ratio").toPandas().sort_values("gram")  # at most 2 ** BITS
    grams, ratios = chosen["gram"].to_numpy(np.int64), chosen["ratio"].to_numpy(float)
    if not len(grams):
        return {"weight": weight, "bias": float(np.log((n1 + 1) / (n0 + 1)))}
    kept = np.zeros(1 << BITS, bool)
    kept[grams] = True
    place = np.zeros(1 << BITS, np.int32)
    place[grams] = np.arange(len(grams))
    y, sizes, parts = [], [], []
    for b in sample.mapInArrow(_rows(kept), "label int, grams array<int>").toArrow().to_batches():
        y.append(b.column("label").to_numpy(zero_copy_only=False).astype(float))
        sizes.append(np.diff(b.column("grams").offsets.to_numpy()))
        parts.append(place[b.column("grams").flatten().to_numpy()])
    w, b = _fit(np.concatenate(y), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(parts), ratios)
    weight[grams] = w * ratios
    return {"weight": weight, "bias": b}


def score_text(text: str | None, model: dict, kept: np.ndarray) -> float:
    found = distinct_grams(text, kept)
    z = float(model["weight"][found].sum()) / np.sqrt(1 + len(found)) + model["bias"]
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for each row; a null or empty text scores the model's bias. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one table of 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        kept = own["weight"] != 0
        for b in batches:
            found = [score_text(t.as_py(), own, kept) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``; a null doc_id counts as not held out."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose texts score below the threshold, with all their columns.

    A null or empty text scores the model's bias, which is low unless most labels are toxic; a null id or a repeated row changes
    nothing; a score equal to the threshold goes. An empty table gives an empty one.
    """
    model = train(docs, labels)
    sent, kinds = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        kept = own["weight"] != 0
        for b in batches:
            yield b.filter(pa.array([score_text(t.as_py(), own, kept) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, kinds)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
