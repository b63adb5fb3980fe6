"""Quality classifier: ridge regression on random Fourier features of document statistics.

Plan: one pass over whole texts computes a short vector of statistics per row, which is
written. Random Fourier features approximate a Gaussian kernel over the standardised
statistics; every partition sums its normal equations (features x features), the sums are
added up in Spark, and the driver solves one small system. Isotonic regression on a fold that
the ridge has not seen turns scores into probabilities: scores are counted in fixed bins in
Spark and pooled by adjacent violators over the bins. What reaches the driver depends on the
number of features and bins only.

Labels are learned from rows whose crc32(id as text) modulo ``folds`` is not ``held_out``; of
these, fold ``calibration`` calibrates and the others fit. The statistics are of the text
alone.

Defined results: null and empty texts have the statistics of no words. Without usable labels
every score is 0.5 (``fitted`` is false in the model). Null labels are ignored; repeated labels
count each. Repeated documents are scored each by itself. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import received, remainder, send, table, utf8
from storyloom.shared import materialize

#: Bytes counted on their own, as shares of all bytes.
MARKS = b"!$#%&*|_=<>{}[]()@/\\^~+?.,;:\"'-"


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text's shape; all are finite for any text."""
    import math

    import numpy as np

    raw = utf8(text)
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, spaces = counts[48:58].sum(), counts[32] + counts[9:14].sum()
    other = counts[33:127].sum() - upper - lower - digits
    share = counts[counts > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    odd_end = sum(1 for w in words if w[-1:] in b"!$#%&*|_=<>{}[]()@/\\^~+")
    kinds = {len(x) for x in lines}
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)),
        float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5,
        upper / max(1.0, upper + lower), digits / n, spaces / n, other / n, counts[128:].sum() / n,
        float(-(share * np.log(share)).sum()) if len(raw) else 0.0,
        distinct / m, pairs / m, math.log1p(distinct) / math.log(m + 1.5), odd_end / m,
        len(set(lines)) / len(lines), len(kinds) / len(lines), math.log1p(max(map(len, lines))),
        *(counts[list(MARKS)] / n * 10).tolist(),
    ]


N_STATISTICS = 19 + len(MARKS)


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, stats) of each row."""
    source = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column("text")], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), stats], ["id", "text_hash", "stats"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text_hash long, stats array<float>")


@dataclass
class Model:
    """mean and scale of the statistics, the features' directions and phases, ridge weights,
    and the calibration's knots."""

    mean: list[float]
    scale: list[float]
    features: int
    width: float
    seed: int
    weights: list[float] = field(default_factory=list)
    knots: list[float] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    fitted: bool = False

    def expand(self, stats):
        """Random Fourier features and a constant, for rows of statistics."""
        import numpy as np

        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        directions = rng.normal(size=(d, self.features)) / (self.width * d**0.5)
        phases = rng.uniform(0, 2 * np.pi, self.features)
        x = np.clip((stats - np.array(self.mean)) / np.array(self.scale), -8, 8)
        z = np.cos(x @ directions + phases) * (2 / self.features) ** 0.5
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats):
        import numpy as np

        return self.expand(stats) @ np.array(self.weights)

    def score(self, stats):
        import numpy as np

        if not self.fitted:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(np.interp(raw, self.knots, self.values) if self.knots else raw, 0.0, 1.0)


def matrix(batch, column: str = "stats"):
    import numpy as np

    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def partial_equations(held):
    """Per partition, the rows of Z'[Z y]."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model, total = received(held), None
        for b in batches:
            if b.num_rows:
                z = model.expand(matrix(b))
                y = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                part = z.T @ np.concatenate([z, y[:, None]], axis=1)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"]
            )

    return run


def add_up(table):
    """Sums of one row of the normal equations over partitions."""
    import pyarrow as pa

    total = matrix(table.combine_chunks().to_batches()[0], "sums").sum(axis=0)
    return pa.table([table.column("row")[:1], pa.array([total], pa.list_(pa.float64()))], ["row", "sums"])


def pool_adjacent(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Isotonic fit of (x, weight, sum of labels), sorted by x: knots and values to interpolate."""
    blocks: list[list[float]] = []  # weight, sum, weighted x
    for x, w, s in points:
        blocks.append([w, s, w * x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[2] / b[0] for b in blocks], [b[1] / b[0] for b in blocks]


def fit(
    described: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", folds: int = 4,
    held_out: int = 2, calibration: int = 3, features: int = 256, width: float = 1.0, ridge: float = 1e-3,
    bins: int = 4096, seed: int = 7,
) -> Model:
    """A model of the label from described rows (see describe()) that are not held out."""
    spark = described.sparkSession
    usable = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("label")).where(
        F.col("label").isNotNull() & (remainder(F.col("l_id"), folds) != held_out)
    )
    rows = materialize(
        described.join(usable, F.col("id") == F.col("l_id"))
        .select("stats", "label", remainder(F.col("id"), folds).alias("fold")),
        "labelled",
    )
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("fold") != calibration).cast("long")).alias("n_fit"),
        *(f(F.col("stats")[k].cast("double")).alias(f"{name}{k}") for k in range(N_STATISTICS)
          for name, f in (("m", F.avg), ("s", F.stddev_pop))),
    ).first()
    model = Model(
        [moments[f"m{k}"] or 0.0 for k in range(N_STATISTICS)],
        [max(moments[f"s{k}"] or 0.0, 1e-3) for k in range(N_STATISTICS)], features, width, seed,
    )
    if not moments.n:
        return model
    import numpy as np

    fitting = rows.where(F.col("fold") != calibration) if moments.n_fit else rows
    sums = (
        fitting.mapInArrow(partial_equations(send(spark, model)), "row int, sums array<double>")
        .groupBy("row").applyInArrow(add_up, "row int, sums array<double>").orderBy("row").collect()
    )
    a = np.array([r.sums for r in sums])
    z, y = a[:, :-1], a[:, -1]
    penalty = np.eye(len(z)) * ridge * max(1.0, moments.n_fit or moments.n) / features
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(z + penalty, y).tolist()
    model.fitted = True
    held, low, high = send(spark, model), -0.5, 1.5

    def raw(batches):
        import pyarrow as pa

        own = received(held)
        for b in batches:
            s = own.raw(matrix(b)) if b.num_rows else np.empty(0)
            k = np.clip((s - low) / (high - low) * bins, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), b.column("label")], ["bin", "label"])

    counted = (
        rows.where(F.col("fold") == calibration).mapInArrow(raw, "bin int, label double")
        .groupBy("bin").agg(F.count(F.lit(1)).alias("w"), F.sum("label").alias("s")).orderBy("bin").collect()
    )
    points = [(low + (r.bin + 0.5) * (high - low) / bins, float(r.w), r.s) for r in counted]
    model.knots, model.values = pool_adjacent(points)
    return model


def score(described: DataFrame, model: Model) -> DataFrame:
    """(id, text_hash, score) of described rows."""
    held = send(described.sparkSession, model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = received(held)
        for b in batches:
            s = own.score(matrix(b)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(s)], ["id", "text_hash", "score"])

    return described.mapInArrow(run, f"id {dict(described.dtypes)['id']}, text_hash long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, folds: int = 4, held_out: int = 2, **options,
) -> tuple[DataFrame, Model]:
    """Scores of every row of docs, and the model: id_col, text_hash, held_out, score, predicted."""
    described = materialize(describe(docs, id_col, text_col), "statistics")
    model = fit(described, labels, id_col=id_col, label_col=label_col, folds=folds, held_out=held_out, **options)
    scored = score(described, model).select(
        F.col("id").alias(id_col), "text_hash", (remainder(F.col("id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
    return scored, model


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("text_hash")
