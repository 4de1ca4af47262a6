"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text come from byte classes, words and lines. They are standardised and mapped
to cosines of random projections, whose inner products approximate a Gaussian kernel. Every
partition of the training rows sums its own part of the normal equations; the driver adds these
few fixed-size parts, solves them, and fits a monotone curve to scores of rows that the solution
has not seen. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, id_fold, per_batch, slices, strings

# fixed values: the byte classes whose shares are statistics
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" ",
    b"\t\n\r\x0b\x0c",
    b".",
    b",;:",
    b"!",
    b"?",
    b"\"'`()-",
    b"|",
    b"#$%&*+=@^_~",
    b"/\\<>[]{}",
    bytes(range(128, 256)),
]
LETTERS = np.zeros(256, dtype=bool)
LETTERS[list(CLASSES[0] + CLASSES[1] + CLASSES[-1])] = True
_CLASS_OF = np.zeros((256, len(CLASSES)))
for _at, _class in enumerate(CLASSES):
    _CLASS_OF[list(_class), _at] = 1
N_STATISTICS = len(CLASSES) + 15


def statistics(text: str) -> list[float]:
    """The statistics of a whole text; an empty text has zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = counts / len(raw)
    seen = shares[shares > 0]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    halves = {b" ".join(words[i : i + 3]) for i in range(0, len(words) - 2)}
    lasts = [w[-1] for w in words]
    return (shares @ _CLASS_OF).tolist() + [
        math.log1p(len(text)),
        math.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        len(distinct) / len(words),
        math.log1p(len(distinct)) / math.log1p(len(words)),
        len(halves) / max(1, len(words) - 2),
        float((sizes <= 3).mean()),
        float((sizes >= 15).mean()),
        float(-(seen * np.log(seen)).sum()),
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(raw) / max(1, len(lines))),
        sum(not LETTERS[x] for x in lasts) / len(words),
        sum(w.isupper() for w in words) / len(words),
    ]


def _statistics_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, N_STATISTICS)


@dataclass
class QualityModel:
    """All of fixed size: N_STATISTICS, the number of features, the calibration's knots."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score, with a hundredth of the uncalibrated one so that flat steps keep an order."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.knots, self.values) + 0.01 * np.clip((raw + 0.5) / 2, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the monotone least-squares curve, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    weight = np.array([b[1] for b in blocks])
    # one pseudo-row of the overall mean keeps the end values off 0 and 1
    mean = float(np.mean(y)) if len(y) else 0.5
    values = (np.array([b[0] for b in blocks]) + mean) / (weight + 1)
    return np.array([b[2] for b in blocks]) / weight, np.maximum.accumulate(values)


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    schema = T.StructType([df.schema[n] for n in keep] + [T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = pa.array(_statistics_of(strings(batch, text)).tolist(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), made], names=[*keep, "statistics"])

        return step

    return per_batch(df.select(*keep, *([] if text in keep else [text])), schema, make)


def smallest_hashes(rows: DataFrame, max_rows: int) -> DataFrame:
    """The ``max_rows`` rows with the smallest ``h`` (a hash of 64 bits), written; all, if there are no more.

    The number of rows tells below which hash about as many lie, so that only those are sorted: a
    plain top-k would send as many rows from every task to one. If too few lie there (rows of one
    id share their hash), the bound is raised.
    """
    total = rows.count()
    wanted = max_rows + 10 * math.ceil(math.sqrt(max_rows))
    while wanted < total:
        bound = int(wanted / total * 2.0**64) - 2**63
        found = cut_lineage(rows.where(F.col("h") < F.lit(bound).cast("long")).orderBy("h").limit(max_rows))
        if found.count() == max_rows:
            return found
        wanted *= 4
    return cut_lineage(rows.orderBy("h").limit(max_rows) if total > max_rows else rows)


def fit_quality(
    rows: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    max_rows: int = 40_000,
    n_features: int = 384,
    ridge: float = 1e-4,
    width: float = 0.5,
    seed: int = 11,
) -> QualityModel:
    """Fit on labelled rows whose id's crc32 modulo ``folds`` is not 0.

    ``rows`` has doc_id and statistics, ``labels`` doc_id and quality. At most ``max_rows``
    labelled rows are used, those whose ids have the smallest hash: the documented bound of the
    training sample. An id with several labels counts with the largest; rows with a NULL id or
    label teach nothing. Without any labelled row every score is 0.5.
    """
    label = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    chosen = (
        rows.where(id_fold("doc_id", folds) != 0)
        .join(label, "doc_id")
        .select("statistics", "y", (F.crc32(F.concat_ws("-", F.lit("part"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0).alias("calibrates"), F.xxhash64("doc_id").alias("h"))
    )
    training = smallest_hashes(chosen, max_rows).drop("h")
    bounds = training.select(
        F.count("*"),
        *[f(F.col("statistics")[i]) for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)],
    ).first()
    rng = np.random.default_rng(seed)
    if not bounds[0]:
        flat = np.zeros(N_STATISTICS)
        return QualityModel(flat, flat + 1, np.zeros((N_STATISTICS, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.array([0.5]))
    centre, scale = np.array(bounds[1::2]), np.array(bounds[2::2])
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = QualityModel(
        centre,
        scale,
        rng.normal(size=(N_STATISTICS, n_features)) * width / math.sqrt(N_STATISTICS),
        rng.uniform(0, 2 * math.pi, n_features),
        np.zeros(n_features + 1),
        np.zeros(1),
        np.zeros(1),
    )
    size = n_features + 1

    def partial(batches):
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            x = model.features(np.array(batch.column("statistics").to_pylist()).reshape(-1, N_STATISTICS))
            y = batch.column("y").to_numpy()
            left, right, n = left + x.T @ x, right + x.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "left": [left.tobytes()], "right": [right.tobytes()]})

    # a few parts whatever the number of rows: the training sample is bounded
    parts = training.where("NOT calibrates").repartition(8).mapInArrow(partial, "n long, left binary, right binary").collect()
    if parts:
        left = sum(np.frombuffer(p["left"]).reshape(size, size) for p in parts)
        right = sum(np.frombuffer(p["right"]) for p in parts)
        n = sum(p["n"] for p in parts)
        model.weights = np.linalg.solve(left + ridge * n * np.eye(size) / size, right)
    unseen = training.where("calibrates").select("statistics", "y").toPandas()
    if not len(unseen):
        unseen = training.select("statistics", "y").toPandas()
    model.knots, model.values = isotonic(model.raw(np.array(unseen["statistics"].tolist())), unseen["y"].to_numpy())
    return model


def score_quality(df: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, **options) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    A NULL or empty text is scored like one without words; a NULL id is not held out and keeps
    its NULL; repeated rows give repeated results; other columns are ignored.
    """
    rows = cut_lineage(with_statistics(df.select("doc_id", "text"), ["doc_id"]))
    model = fit_quality(rows, labels, folds, **options)
    schema = T.StructType([df.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array(batch.column("statistics").to_pylist(), dtype=np.float64).reshape(-1, N_STATISTICS)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

        return step

    return per_batch(rows, schema, make).select(
        "doc_id",
        F.coalesce(id_fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(df: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``df``, all columns, whose score reaches ``threshold``. Texts are read twice, never shuffled."""
    rows = cut_lineage(with_statistics(df.select("doc_id", "text"), ["doc_id"]))
    model = fit_quality(rows, labels, folds, **options)
    held = df.toDF(*[f"of_{at}" for at in range(len(df.columns))])  # a column may have any name
    text = held.columns[df.columns.index("text")]

    def run(batches):
        for batch in slices(batches):
            kept = model.score(_statistics_of(strings(batch, text))) >= threshold
            yield batch.filter(pa.array(kept))

    return held.mapInArrow(run, held.schema).toDF(*df.columns)
