"""Quality classifier learnt from trusted positives and unlabelled web text.

Positive-unlabelled learning with the non-negative risk estimator: with class
prior p, the risk is p R_P(+) + max(0, R_U(-) - p R_P(-)). Positives are a
bounded sample of labelled documents of quality 1 in the training folds,
unlabelled text a bounded sample of all documents; labels of quality 0 take no
part. The prior is estimated from the two samples' scores, and the net's logistic
output under the unbiased risk is the probability itself. Features are shape
frequencies of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, learn
from .textvec import WORD, Block, blocks, distinct, grams, per_row, repeated

#: Bounds on the samples that the model is fitted to.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
PARTS, HELD = 4, 2
THRESHOLD = 0.7
OUT = "doc_id long, held_out boolean, score double, predicted int"

#: Byte classes: lower, upper, digit, space, line feed, stops, exclamation, symbols, bars, quotes, brackets, other, beyond ASCII.
CLASSES = 14
CLASS = np.full(256, 12, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "#*$%&", "|<>", "\"'`", "()[]{}")):
    CLASS[[ord(_c) for _c in _chars]] = _k
CLASS[128:] = 13
EXTRA = 10
WIDTH = CLASSES * CLASSES + EXTRA


def features(b: Block) -> np.ndarray:
    """Shape features of each row: frequencies of class pairs, repetition, lengths; zeros for an empty text."""
    cls = CLASS[b.buf].astype(np.int64)
    size = np.diff(b.off)
    pair = cls[:-1] * CLASSES + cls[1:]
    row = np.repeat(np.arange(b.n), size)
    inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    x = np.zeros((b.n, WIDTH), np.float32)
    x[:, : CLASSES**2] = np.sqrt(np.bincount(row[:-1][inside] * CLASSES**2 + pair[inside], minlength=b.n * CLASSES**2).reshape(b.n, -1) / np.maximum(size, 1)[:, None]) if len(row) > 1 else 0
    start, end, wrow = b.runs(WORD)
    h = b.hashes(start, end)
    n = np.maximum(per_row(wrow, b.n), 1)
    extra = x[:, CLASSES**2 :]
    extra[:, 0] = np.log1p(per_row(wrow, b.n))
    extra[:, 1] = per_row(wrow, b.n, (end - start).astype(float)) / n
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    extra[:, 2] = per_row(wrow[same], b.n) / n
    for j, k in ((3, 2), (4, 5)):
        g, at = grams(h, wrow, k)
        later, _ = repeated(g, wrow[at])
        extra[:, j] = per_row(wrow[at[later]], b.n) / n
    _, ur = distinct(h, wrow)
    extra[:, 5] = per_row(ur, b.n) / np.sqrt(n)
    ls, le, lr = b.lines()
    later, _ = repeated(b.hashes(ls, le), lr)
    extra[:, 6] = per_row(lr[later], b.n) / np.maximum(per_row(lr, b.n), 1)
    extra[:, 7] = np.log1p(per_row(lr, b.n))
    short = (end - start) <= 3
    extra[:, 8] = per_row(wrow[short], b.n) / n
    extra[:, 9] = (size == 0).astype(np.float32)
    return x


def sampled(docs: DataFrame) -> np.ndarray:
    """Feature rows (with ``mark`` last) of a frame of bounded size, on the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            marks = np.asarray(x.column("mark"))
            for b in blocks(x.column("text")):
                f = np.column_stack([features(b), marks[b.lo : b.lo + b.n]]).astype(np.float32)
                yield frames.batch("doc_id long, x binary", x.column("doc_id").slice(b.lo, b.n), [r.tobytes() for r in f])

    rows = docs.select("doc_id", "text", "mark").mapInArrow(each, "doc_id long, x binary").orderBy("doc_id", "x").collect()
    return np.stack([np.frombuffer(r[1], np.float32) for r in rows]).astype(np.float64) if rows else np.zeros((0, WIDTH + 1))


def estimated_prior(fp: np.ndarray, fu: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from scores of rows that the net has not seen.

    An upper score tail that holds positives alone has this share as the ratio of its parts of both samples; other
    tails have more. So it is the least ratio, over few tails of many rows, as chance minima of small ones lie too low.
    """
    cut = np.quantile(fp, np.linspace(0.05, 0.4, 8))
    p, u = (fp[:, None] >= cut).mean(0), (fu[:, None] >= cut).mean(0)
    return float(np.clip(np.min(u / p), 0.05, 0.98))


def crossed_prior(xp: np.ndarray, xu: np.ndarray, seed: int) -> float:
    """The prior, from nets that score the half of each sample that they were not fitted to."""
    if min(len(xp), len(xu)) < 4:
        return 0.5
    scores, rng = [], np.random.default_rng(seed)
    xp, xu = rng.permutation(xp), rng.permutation(xu)
    for k in (0, 1):
        net, _ = fit(xp[1 - k :: 2], xu[1 - k :: 2], 0.5, 150, seed)
        scores.append((net.forward(xp[k::2])[0], net.forward(xu[k::2])[0]))
    return float(np.mean([estimated_prior(p, u) for p, u in scores]))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int = 400, seed: int = 7) -> tuple[learn.Net, float]:
    """A net that minimises the non-negative unbiased risk with the logistic loss; without a prior, one is estimated first."""
    if prior is None:
        prior = crossed_prior(xp, xu, seed)
    net = learn.Net(xp.shape[1], 12, seed)
    net.standardise(xu)
    opt, rng = learn.Adam(net.params, 0.01), np.random.default_rng(seed)
    # Few rows are seen a few dozen times each, not hundreds.
    for _ in range(min(steps, 150 + len(xu) // 8)):
        p, u = xp[rng.integers(0, len(xp), 512)], xu[rng.integers(0, len(xu), 1024)]
        f, h, z = net.forward(np.vstack([p, u]))
        fp, fu = f[: len(p)], f[len(p) :]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        d_plus = np.concatenate([-prior * learn.sigmoid(-fp) / len(p), np.zeros(len(u))])
        d_minus = np.concatenate([-prior * learn.sigmoid(fp) / len(p), learn.sigmoid(fu) / len(u)])
        # Where the negative part is below 0, its step is undone instead.
        d = d_plus + d_minus if negative >= 0 else -d_minus
        grads = net.backward(d, h, z)
        grads[0] += 3e-3 * net.params[0]
        opt.step(grads)
    return net, prior


def trained(docs: DataFrame, labels: DataFrame) -> tuple[learn.Net, float]:
    """The net and the estimated prior, from trusted positives of the training folds and unlabelled documents.

    Negative labels take no part: neither in the fit nor in the prior.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(frames.fold("doc_id", PARTS) != HELD)
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    positive = learn.rows_of(docs, learn.sample_ids(lab.where("quality = 1"), MAX_POSITIVE, 1)).withColumn("mark", F.lit(1))
    unlabelled = learn.rows_of(docs, learn.sample_ids(docs, MAX_UNLABELLED, 2)).withColumn("mark", F.lit(-1))
    x = sampled(positive.unionByName(unlabelled))
    xp, xu = (x[x[:, -1] == m, :-1] for m in (1, -1))
    if not len(xp) or not len(xu):
        return learn.Net(WIDTH, 1, 0), 0.5
    return fit(xp, xu, None)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: fold mark, score of quality and prediction.

    Null and empty texts are scored by the features of an empty text. A null id
    is in no held-out fold. Repeated rows give repeated rows; conflicting label
    rows of an id count as their largest; without positives every score is 0.5.
    Other columns are ignored.
    """
    own = frames.only(docs, id_col, text_col)
    net, _ = trained(own, labels)
    width = WIDTH

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held = x.column("held_out")
            for b in blocks(x.column("text")):
                s = learn.sigmoid(net.forward(features(b)[:, :width].astype(np.float64))[0])
                yield frames.batch(OUT, x.column("doc_id").slice(b.lo, b.n), held.slice(b.lo, b.n), s, (s >= THRESHOLD).astype(np.int32))

    return own.withColumn("held_out", F.coalesce(frames.fold("doc_id", PARTS) == HELD, F.lit(False))).mapInArrow(score, OUT)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, whose texts are predicted to be of quality; repeated rows share their fate.

    Null and empty texts are judged by the features of an empty text. Without positives every score is 0.5 and no row stays.
    """
    net, _ = trained(frames.only(docs, id_col, text_col), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = [learn.sigmoid(net.forward(features(b).astype(np.float64))[0]) for b in blocks(x.column(text_col))]
            if s:
                yield x.filter(pa.array(np.concatenate(s) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))
