"""Quality classifier by compression.

Two zstandard dictionaries of one size are trained on labelled good and bad text.  A text is cut into blocks, each
block is compressed once with either dictionary, and the difference of the two sums over their total is the text's
feature.  A logistic regression on it and on the log of the compressed share (the smaller sum over the text's bytes),
fitted on the whole texts of other labelled documents, gives the probability of label 1.  The share is there for endless
repeats, which either dictionary compresses to nearly nothing, so that the difference says little of them.

Bounds: at most ``sample`` labelled documents of each class train the dictionaries, each with at most ``windows``
windows of ``window`` characters spread evenly over its whole text; at most ``4 * sample`` others give two numbers each
to the regression.  Scoring covers whole texts.

Defined cases: a null text scores as the empty one; an empty text has difference 0 and the ratio of its prior; labels
that are null are not learnt from; repeated label rows count once each; where the labelled text of a class is missing or
too little to train a dictionary on, every score is the share of label 1 (0.5 without labels); repeated rows are scored
each; an empty table gives an empty result; extra columns of the input stay where they are, but for those that are named
like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import release

ROWS = 256  # texts that are held as strings together
BLOCK = 512
LEAST_BYTES, LEAST_WINDOWS = 2048, 8  # below these zstandard trains no dictionary
LEVEL = 3
PRIOR = 64  # bytes: draws very short texts towards difference 0


@dataclass(frozen=True)
class QualityModel:
    """The two dictionaries' bytes and the calibration: log odds = bias + slope * difference + ratio_slope * log ratio."""

    good: bytes
    bad: bytes
    bias: float
    slope: float
    ratio_slope: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(content) if content else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """For each text the difference, and the log of the smaller size over the text's own."""
    with_good, with_bad = _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        g = sum(len(with_good.compress(b)) for b in blocks)
        b = sum(len(with_bad.compress(b)) for b in blocks)
        out[i] = (b - g) / (b + g + PRIOR), np.log((min(b, g) + PRIOR) / (len(data) + 2 * PRIOR))
    return out


def measured(text: Column, good: bytes, bad: bytes) -> Column:
    @F.arrow_udf("struct<difference:double,ratio:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [features(texts.slice(at, ROWS).to_pylist(), good, bad) for at in range(0, len(texts), ROWS)]
            columns = np.concatenate(found or [np.zeros((0, 2))]).T
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["difference", "ratio"])
            release()

    return run(text)


def dictionaries(good: list[str], bad: list[str], size: int) -> tuple[bytes, bytes] | None:
    """A trained dictionary of either class, both of the length that the class with less text allows; None without."""
    samples = [[w.encode("utf-8", "replace") for w in windows if w] for windows in (good, bad)]
    if min(sum(map(len, s)) for s in samples) < LEAST_BYTES or min(map(len, samples)) < LEAST_WINDOWS:
        return None
    made = [zstandard.train_dictionary(size, s).as_bytes() for s in samples]
    least = min(map(len, made))
    one, two = (d if len(d) == least else zstandard.train_dictionary(least, s).as_bytes() for d, s in zip(made, samples, strict=True))
    return one, two


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and slopes by Newton's method, with a slight ridge on the slopes of the standardised columns."""
    middle, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    design, ridge = np.column_stack([np.ones(len(x)), (x - middle) / scale]), np.diag([1e-6] + [1e-2] * x.shape[1])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return np.concatenate([[w[0] - slopes @ middle], slopes])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, window: int = 2048, windows: int = 8, size: int = 64 * 1024, key: str = "doc_id", label: str = "quality", text: str = "text") -> QualityModel:
    """Learn from the labelled rows given; leave held-out rows out of ``labels``."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    trains = F.pmod(F.xxhash64(F.col("k"), F.lit("half")), 2) == 0
    first = [F.xxhash64(F.col("k"), F.lit("sample")), F.col("k")]
    picked = [known.filter(trains & (F.col("y") == y)).orderBy(*first).limit(sample) for y in (0, 1)]
    picked = [x.withColumn("trains", F.lit(True)) for x in picked] + [known.filter(~trains).orderBy(*first).limit(4 * sample).withColumn("trains", F.lit(False))]
    ids = sorted({r["k"]: r for x in picked for r in x.collect()}.values(), key=lambda r: r["k"])
    if not ids:
        return QualityModel(b"", b"", 0.0, 0.0, 0.0)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "k long, y int, trains boolean"))  # at most 6 * sample rows, by the limits above
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(wanted, "k")
    length = F.length("t")
    n = F.least(F.lit(windows), F.ceil(length / window)).cast("int")
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), F.floor(i * F.greatest(F.lit(0), length - window) / F.greatest(n - 1, F.lit(1))).cast("int") + 1, F.lit(window)))
    rows = found.filter(F.col("trains") & (length > 0)).select("k", "y", spread.alias("parts")).orderBy("k", F.xxhash64("t")).limit(2 * sample).collect()
    made = dictionaries(*([w for r in rows if r["y"] == y for w in r["parts"]] for y in (1, 0)), size)
    if not made:
        share = sum(r["y"] for r in ids) / len(ids)
        return QualityModel(b"", b"", float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0)
    fits = found.filter("NOT trains").select("k", "y", measured(F.col("t"), *made).alias("x")).select("k", "y", "x.*").orderBy("k", "difference").limit(4 * sample).collect()
    if len({r["y"] for r in fits}) < 2:  # too few labels for rows of their own
        x, y = features(["".join(r["parts"]) for r in rows], *made), np.array([r["y"] for r in rows], float)
    else:
        x, y = np.array([(r["difference"], r["ratio"]) for r in fits]), np.array([r["y"] for r in fits], float)
    return QualityModel(*made, *map(float, _logistic(x, y)))


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with ``score`` (probability of label 1) and ``predicted`` (1 from the threshold on)."""
    out = docs.withColumn("score", measured(F.col(text), model.good, model.bad))
    z = F.lit(model.bias) + model.slope * F.col("score.difference") + model.ratio_slope * F.col("score.ratio")
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
