"""Quality by co-training a text view and a metadata view (operator 7).

Two logistic regressions see different sides of a document: measures of its text, and its metadata (source, language,
length). Both start from a bounded sample of labelled rows. In each round either one labels the unlabelled rows it is
surest of for the other. At the end both are calibrated side by side on labelled rows they were not fitted on, and their scaled log
odds are added. Features are made by the executors; the driver sees a bounded table of numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, read_table

LABELLED = 6_000
UNLABELLED = 6_000
ROUNDS = 5
PER_ROUND = 200
SURE = 0.95
SOURCE_BUCKETS, LANG_BUCKETS, LENGTH_BUCKETS = 64, 16, 16

_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASSES[_c] = (
        0 if _c >= 128 else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _c == 10 else 5 if _s.isspace() else 6 if _s in ".,;:'\"-()?" else 7
    )
_ODD = b"|%#&$*!{}<>@/\\=_~^+[]"
TEXT_DIM = 8 + len(_ODD) + 10


def text_features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes and odd marks, lengths, repetition. All of the text counts; zeros without text."""
    out = np.zeros(TEXT_DIM, np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    n = len(data)
    out[:8] = np.bincount(_CLASSES, weights=count, minlength=8) / n
    out[8 : 8 + len(_ODD)] = np.sqrt(count[np.frombuffer(_ODD, np.uint8)] / n)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    p = count[count > 0] / n
    w = max(1, len(words))
    out[8 + len(_ODD) :] = (
        math.log1p(n) / 12, math.log1p(len(words)) / 10, n / w / 20, distinct / w, distinct / math.sqrt(w) / 20, len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)) / 1000, float(-(p * np.log(p)).sum()) / 5, sum(map(len, map(str.strip, lines))) / n, text[-1:] in ".!?",
    )
    return out


META_DIM = SOURCE_BUCKETS + LANG_BUCKETS + LENGTH_BUCKETS


def meta_places(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """The three ones of the metadata vector; null is a value of its own."""
    return [
        zlib.crc32(f"s{source}".encode()) % SOURCE_BUCKETS,
        SOURCE_BUCKETS + zlib.crc32(f"l{lang}".encode()) % LANG_BUCKETS,
        SOURCE_BUCKETS + LANG_BUCKETS + (0 if n_chars is None else min(LENGTH_BUCKETS - 1, 1 + int(math.log2(1 + max(0, n_chars))) // 2)),
    ]


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_features(t.as_py()) for t in b.column("text")]) if b.num_rows else np.zeros((0, TEXT_DIM), np.float32)
    meta = np.zeros((b.num_rows, META_DIM), np.float32)
    for r, x in enumerate(zip(b.column("source").to_pylist(), b.column("lang").to_pylist(), b.column("n_chars").to_pylist(), strict=True)):
        meta[r, meta_places(*x)] = 1
    return text, meta


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, meta = _views(b)
        columns = [b.column("doc_id").cast(pa.int64()), b.column("label"), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "text", "meta"])


class Logistic:
    """Logistic regression on standardised features by Newton steps, with weights per row."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))].astype(np.float64)
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (weight * (p - y)) + ridge * w
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            w -= np.linalg.solve(h, g)
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return _logit((self.mean, self.scale, self.w), x)


def _logit(fitted: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    mean, scale, w = fitted
    return np.clip((x - mean) / scale @ w[:-1] + w[-1], -20, 20)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Slopes (not below zero) and offset that fit the views' logits, side by side, to the labels. A view that says nothing beyond
    the other gets a slope near zero."""
    use = list(range(z.shape[1]))
    while True:
        one = Logistic().fit(z[:, use], y, np.ones(len(y)), l2=0.1)
        slopes = one.w[:-1] / one.scale
        if len(use) == 1 or (slopes >= 0).all():
            break
        del use[int(slopes.argmin())]
    out = np.zeros(z.shape[1])
    out[use] = np.maximum(slopes, 0)
    return out.tolist(), float(one.w[-1] - slopes @ one.mean)


def set_aside(ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labelled rows kept for calibration: a quarter, by the hash of the id. All rows both train and calibrate where
    either part would lack a kind of label."""
    part = np.array([zlib.crc32(f"calibrate{i}".encode()) % 4 == 3 for i in ids], bool)
    both = all(len(np.unique(x)) == 2 for x in (y[part], y[~part]))
    return part if both else np.ones(len(y), bool)


def co_train(ids: np.ndarray, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Both views after exchanging pseudo-labels, calibrated on the rows set aside."""
    calibrate = set_aside(ids, y)
    if calibrate.all():
        ids, text, meta, y = (np.concatenate([x, x]) for x in (ids, text, meta, y))
        calibrate = np.arange(len(y)) < len(y) // 2
    views, pools = [text[~calibrate], meta[~calibrate]], [pool_text, pool_meta]
    base = y[~calibrate]
    rows = [[v] for v in views]
    labels = [[base], [base]]
    weights = [[np.ones(len(base))], [np.ones(len(base))]]
    free = np.ones(len(pool_text), bool)

    def fitted() -> list[Logistic]:
        return [Logistic().fit(np.concatenate(rows[v]), np.concatenate(labels[v]), np.concatenate(weights[v])) for v in (0, 1)]

    models = fitted()
    for _ in range(rounds):
        moved = False
        for v in (0, 1):
            p = 1 / (1 + np.exp(-models[v].logit(pools[v])))
            for value, sure in ((1, p), (0, 1 - p)):
                pick = np.flatnonzero(free & (sure >= SURE))
                pick = pick[np.argsort(-sure[pick], kind="stable")][: max(1, round(PER_ROUND * (base.mean() if value else 1 - base.mean())))]
                if len(pick):
                    other = 1 - v
                    rows[other].append(pools[other][pick])
                    labels[other].append(np.full(len(pick), float(value)))
                    weights[other].append(np.full(len(pick), 0.5))
                    free[pick] = False
                    moved = True
        if not moved:
            break
        models = fitted()
    z = np.stack([m.logit(x[calibrate]) for m, x in zip(models, (text, meta), strict=True)], axis=1)
    slopes, offset = _calibrate(z, y[calibrate])
    # arrays only: what is broadcast must not need this package where it is read
    return {"models": [(m.mean, m.scale, m.w) for m in models], "slopes": slopes, "offset": offset}


def combined(model: dict, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    if model["models"] is None:
        return np.full(len(text), model["score"])
    z = model["offset"] + sum(a * _logit(m, x) for m, a, x in zip(model["models"], model["slopes"], (text, meta), strict=True))
    return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> dict:
    """Learns from at most ``labelled`` labelled rows that aren't held out and ``unlabelled`` others (smallest hashes of ids)."""
    told = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    some = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars")
    # ids only: both lists are bounded, so they can go to every executor
    pool = rows.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id").join(told, "doc_id", "left_anti").distinct()
    pool = pool.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).withColumn("label", F.lit(None).cast("int"))
    ids = materialize(some.unionByName(pool), "quality-ids")
    got = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text", "source", "lang", "n_chars").mapInArrow(_extract, "doc_id long, label int, text binary, meta binary")
    # one row an id, in the order of ids: the model is a function of the tables, whatever the order of their rows
    got = got.groupBy("doc_id", "label").agg(F.min(F.struct("text", "meta")).alias("x")).select("doc_id", "label", "x.text", "x.meta").toPandas().sort_values("doc_id")
    text = np.stack([np.frombuffer(x, np.float32) for x in got["text"]]) if len(got) else np.zeros((0, TEXT_DIM))
    meta = np.stack([np.frombuffer(x, np.float32) for x in got["meta"]]) if len(got) else np.zeros((0, META_DIM))
    known = got["label"].notna().to_numpy()
    y = got["label"].to_numpy(float)[known] if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return {"models": None, "score": float((y.sum() + 1) / (len(y) + 2))}
    return co_train(got["doc_id"].to_numpy()[known], text[known], meta[known], y, text[~known], meta[~known])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): the probability that a document is good. Null texts and metadata are values like any other; other
    columns are ignored; without labels of both kinds every score is the share of good labels."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(combined(own, *_views(b)).astype(float))], names=["doc_id", "score"])

    return docs.select("doc_id", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, keep) of each row of ``docs``. Empty tables give no rows; of several rows of one id the least by
    its features teaches; a score equal to the threshold is kept."""
    return score(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).alias("keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
