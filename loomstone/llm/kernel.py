"""Quality scores: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE, stored
from loomstone.llm.divergence import BLANK, CLASSES, SYMBOLS, class_counts, repeated_lines, repeated_words
from loomstone.llm.toxicity import labelled_sample

SENTENCE_END = re.compile(rb"[.!?](?:\s|$)")
STATS = [
    "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "repeated_windows", "repeated_lines", "log_lines",
    "line_words", "sentences", "upper_words", "marked_words", "long_words", "log_longest_word", *(f"class_{c}" for c in CLASSES), "top_byte", "byte_entropy",
]


def document_statistics(text: str | None) -> np.ndarray:
    """Figures of one text that do not depend on its id, language label or source. An empty text gives zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    out = np.zeros(len(STATS))
    if not raw:
        return out
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = by_byte[by_byte > 0] / len(raw)
    tail = [by_byte[[i for i in range(256) if i not in SPACE.encode()]].max() / len(raw), float(-(share * np.log2(share)).sum())]
    out[-2:] = tail
    classes = class_counts(raw)
    out[15 : 15 + len(CLASSES)] = classes / classes.sum() if classes.sum() else 0
    out[0] = np.log1p(len(raw))
    if not words:
        return out
    place: dict[bytes, int] = {}
    codes = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64)
    times = np.bincount(codes)
    kinds = list(place)
    sizes = np.array([len(w) for w in kinds])
    n = len(words)
    mean = float((sizes * times).sum() / n)
    upper = np.array([w.isupper() for w in kinds])
    marked = np.array([len(w) != len(w.translate(None, SYMBOLS)) or w.endswith(b"!!") for w in kinds])
    lines = [line for line in raw.split(b"\n") if line.strip(BLANK)]
    out[1:15] = [
        np.log1p(n), mean, float(np.sqrt(((sizes - mean) ** 2 * times).sum() / n)), len(kinds) / n, times.max() / n, repeated_words(codes) / n,
        repeated_lines(raw) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), len(SENTENCE_END.findall(raw)) / n,
        float((upper * times).sum() / n), float((marked * times).sum() / n), float(((sizes > 20) * times).sum() / n), np.log1p(sizes.max()),
    ]
    return out


def _statistics_rows(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([document_statistics(t.as_py()) for t in batch.column("text")], dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float64()))], [*keep, "x"])

    return run


class Features:
    """z(x) = sqrt(2/D) cos(W x + b), W from the seed: their inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, count: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), count))
        self.b = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([wave, z / 8, np.ones((len(x), 1))])


def _normal_sums(features: Features):
    """A task's share of Z'Z and Z'y, a row of the matrix per output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = features(np.stack(batch.column("x").to_pylist()))
            part = z.T @ np.hstack([z, np.asarray(batch.column("y").to_pylist(), dtype=float)[:, None]])
            total = part if total is None else total + part
        n = 0 if total is None else len(total)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([] if total is None else list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def _sum_rows(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = np.sum(np.stack(rows.column("sums").to_pylist()), axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


def ridge(train: DataFrame, features: Features, penalty: float) -> np.ndarray:
    """Weights of (Z'Z + penalty I) w = Z'y; tasks sum their rows, Spark adds the tasks row by row of the matrix."""
    sums = train.mapInArrow(_normal_sums(features), "i int, sums array<double>").groupBy("i").applyInArrow(_sum_rows, "i int, sums array<double>").orderBy("i").collect()
    if not sums:
        return np.zeros(0)
    full = np.array([r["sums"] for r in sums])
    return np.linalg.solve(full[:, :-1] + penalty * np.eye(len(full)), full[:, -1])


def isotonic(values: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates nearest to hits / counts, each block's drawn to the middle by one row."""
    blocks: list[list[float]] = []
    for h, c in zip(hits, counts):
        blocks.append([float(h), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([[(h + 0.5) / (c + 1)] * int(n) for h, c, n in blocks]) if blocks else np.zeros(0)


class Model:
    """Features, ridge weights and calibration; answers 0.5 everywhere if it was given no rows to learn from."""

    def __init__(self, features=None, weights=None, edges=None, rates=None):
        self.features, self.weights, self.edges, self.rates = features, weights, edges, rates

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # Between the middles of the bins the rate is interpolated; a trace of the raw score keeps the order inside a block.
        return np.clip(np.interp(raw, self.edges, self.rates) * 0.999 + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, rows: int = 16000, features: int = 256, width: float = 3.0, penalty: float = 0.1, bins: int = 200, seed: int = 7) -> Model:
    """Fit on at most ``rows`` labelled rows, the bound that keeps the join a broadcast.

    Four fifths of the sample (by hash of the id) give the ridge weights; the
    last fifth gives a histogram of raw scores in ``bins`` quantile bins, on
    which the calibration is fitted (on all where that fifth is empty). An id
    that stands for several rows teaches once, with its smallest text.
    """
    sample = labelled_sample(labels, "quality", may_learn, rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    known = stored(texts.mapInArrow(_statistics_rows(["doc_id", "quality"]), "doc_id long, quality int, x array<double>"), "statistics")
    spread = known.select(*[F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(len(STATS))]).first()
    if spread is None or spread[0][0] is None:
        return Model()
    mean = np.array([s[0] for s in spread])
    scale = np.array([s[1] if s[1] > 1e-9 else 1.0 for s in spread])
    of = Features(mean, scale, features, width * np.sqrt(len(STATS) / 8), seed)
    known = known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5))).withColumn("y", 2.0 * F.col("quality") - 1)
    weights = ridge(known.where("fold <> 0"), of, penalty)
    if not len(weights):
        return Model()
    model = Model(of, weights)

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(model.raw(x))], ["quality", "raw"])

    last = known.where("fold = 0")
    held = stored((known if last.isEmpty() else last).mapInArrow(raw_scores, "quality int, raw double"), "raw")
    cuts = sorted(set(held.approxQuantile("raw", [i / bins for i in range(1, bins)], 0.0005)))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("raw")))
    histogram = held.groupBy(at.alias("bin")).agg(F.avg("raw").alias("middle"), F.sum("quality").alias("hits"), F.count("*").alias("n")).orderBy("bin").collect()
    middles = np.array([r["middle"] for r in histogram])
    model.edges = middles
    model.rates = isotonic(middles, np.array([r["hits"] for r in histogram]), np.array([r["n"] for r in histogram]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text), from the text alone.

    Null and empty texts have zero statistics and get the score of such a text;
    repeated rows score alike; null ids are scored like others.
    """
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([document_statistics(t.as_py()) for t in batch.column("text")], dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
