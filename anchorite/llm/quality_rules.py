"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed one- and two-word grams: the
trusted target (documents of label quality 1) and the raw corpus (every
document). A document's ratio is the mean over its grams, and a fixed threshold
on it decides: no sampling, so the same input always gives the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textvec import SPACE, WORD, U, blocks, grams, per_row, repeated

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Mean log ratio a gram below which a document is not kept.
THRESHOLD = -0.15
#: Added to each bucket's count.
SMOOTHING = 1.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"


def base_counts(b) -> dict[str, np.ndarray]:
    """Base counts of each row of a block."""
    start, end, row = b.runs(WORD)
    h = b.hashes(start, end)
    code_points = np.concatenate(([0], np.cumsum((b.buf & 0xC0) != 0x80)))
    chars = code_points[end] - code_points[start]
    ls, le, lrow = b.lines()
    words_before = np.concatenate(([0], np.cumsum(~SPACE[b.buf])))
    full = words_before[le] > words_before[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    later, _ = repeated(b.hashes(ls, le), lrow)
    g, at = grams(h, row, 5)
    _, some = repeated(g, row[at])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[some], 1)
    np.add.at(edge, at[some] + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {
        "h": h,
        "row": row,
        "n_words": per_row(row, b.n),
        "word_chars": per_row(row, b.n, chars),
        "n_symbols": b.sums(SYMBOLS[b.buf]),
        "n_dup_lines": per_row(lrow[later], b.n),
        "n_repeat_words": per_row(row[covered], b.n),
    }


def buckets(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each one- and two-word gram."""
    two, at = grams(h, row, 2)
    shift = U(64 - BUCKET_BITS)
    return np.concatenate((h >> shift, two >> shift)).astype(np.int64), np.concatenate((row, row[at]))


def gram_counts(docs: DataFrame) -> DataFrame:
    """Counts of each bucket over all documents and over trusted ones (column ``trusted``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for x in batches:
            marks = np.asarray(x.column("trusted").fill_null(False))
            for b in blocks(x.column("text")):
                start, end, row = b.runs(WORD)
                bucket, r = buckets(b.hashes(start, end), row)
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[marks[b.lo : b.lo + b.n][r]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield frames.batch("bucket int, raw long, good long", at, raw[at], good[at])

    return docs.select("text", "trusted").mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of target over raw probability for each bucket; at most BUCKETS rows reach the driver. Without trusted grams all are 0."""
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r[0]], good[r[0]] = r[1], r[2]
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + SMOOTHING) / (good + SMOOTHING).sum()) - np.log((raw + SMOOTHING) / (raw + SMOOTHING).sum())


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row, with its base counts and the verdict.

    Null and empty texts have no words: all counts 0, base failed, not kept, log
    ratio 0. Repeated rows give repeated rows; ids may be null. Conflicting label
    rows of an id count as their largest. Without trusted documents every ratio
    is 0, so only the base rules decide. Other columns are ignored.
    """
    own = frames.only(docs, id_col, text_col)
    trusted = frames.with_labels(own, labels, ["quality"]).withColumn("trusted", F.col("quality") == 1)
    weights = log_ratios(gram_counts(trusted))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in blocks(x.column("text")):
                c = base_counts(b)
                bucket, r = buckets(c["h"], c["row"])
                score = per_row(r, b.n, weights[bucket]) / np.maximum(per_row(r, b.n), 1)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                yield frames.batch(OUT, x.column("doc_id").slice(b.lo, b.n), *(c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, ~failed & (score >= threshold), score)

    return own.mapInArrow(judge, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))
