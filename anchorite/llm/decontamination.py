"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of consecutive words. For each pattern
length, a shift table over hashed blocks of two words tells how far a search may
jump; where the shift is 0, the hash of the window's suffix block chooses a
bucket of patterns, and their normalised texts are compared directly. All rows
of a block of text are searched in lockstep, so every jump is one array pass.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textvec import ALNUM, U, Block, blocks, grams, mix, per_row, view

WINDOW = 10
SHIFT_BITS = 16
#: Bytes of benchmark text that one pass over the documents searches for, in about a hundred times that memory; a larger
#: benchmark takes several passes, each with its own tables alone. One item is never divided.
PASS_BYTES = 2 << 20
MARKED = "doc_id long, text string, n_words long, covered binary, items array<string>"
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Patterns:
    """Windows of some items: for each length the shift table, the buckets by suffix hash, and each window's texts and items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        data, off, null = view(column)
        b = Block(data, off, null).lowered()
        start, end, row = b.runs(ALNUM)
        h = b.hashes(start, end)
        found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = defaultdict(dict)
        first = np.searchsorted(row, np.arange(b.n + 1))
        for item in range(b.n):
            lo, hi = first[item], first[item + 1]
            m = min(window, hi - lo)
            for at in range(lo, hi - m + 1 if m else lo):
                text = b" ".join(b.buf[start[j] : end[j]].tobytes() for j in range(at, at + m))
                found[m].setdefault(text, (h[at : at + m], set()))[1].add(item)
        self.groups = {m: Group(m, list(f.items())) for m, f in sorted(found.items())}


class Group:
    """Patterns of m words."""

    def __init__(self, m: int, found: list[tuple[bytes, tuple[np.ndarray, set[int]]]]):
        self.m, self.block = m, min(2, m)
        self.texts = [t for t, _ in found]
        self.items = [np.array(sorted(i), np.int64) for _, (_, i) in found]
        words = np.stack([w for _, (w, _) in found])
        self.shift = np.full(1 << SHIFT_BITS, m - self.block + 1, np.int64)
        for j in range(m - self.block + 1):
            np.minimum.at(self.shift, self.slot(words[:, j : j + self.block]), m - self.block - j)
        suffix = self.hash(words[:, m - self.block :])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.member = suffix[order], order

    def hash(self, w: np.ndarray) -> np.ndarray:
        return mix(w[:, 0]) if self.block == 1 else mix(w[:, 0] * U(0xD6E8FEB86659FD93) + w[:, 1])

    def slot(self, w: np.ndarray) -> np.ndarray:
        return (self.hash(w) >> U(64 - SHIFT_BITS)).astype(np.int64)

    def search(self, b: Block, start, end, block_hash, first) -> list[tuple[int, int]]:
        """(first word, pattern) of each occurrence. ``block_hash[i]`` is the hash of words i.. of one block; ``first`` bounds each row's words."""
        m, k = self.m, self.block
        out = []
        at, last = first[:-1] + m - k, first[1:] - k  # the block that ends a window
        live = at <= last
        at, last = at[live], last[live]
        slots = (block_hash >> U(64 - SHIFT_BITS)).astype(np.int64)
        while len(at):
            jump = self.shift[slots[at]]
            stop = at[jump == 0]
            if len(stop):
                h = block_hash[stop]
                lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
                for i, p, q in zip(stop[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    w = i - m + k
                    text = b" ".join(b.buf[start[j] : end[j]].tobytes() for j in range(w, w + m))
                    out += [(w, g) for g in self.member[p:q] if self.texts[g] == text]
            at = at + np.maximum(jump, 1)
            live = at <= last
            at, last = at[live], last[live]
        return out


def search(b: Block, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], list[set[int]], np.ndarray]:
    """Words of each row, covered words, spans of hits (row, first word, words), and items found in each row."""
    b = b.lowered()
    start, end, row = b.runs(ALNUM)
    first = np.searchsorted(row, np.arange(b.n + 1))
    h = b.hashes(start, end)
    edge = np.zeros(len(h) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(b.n)]
    spans = []
    one = mix(h)
    two = mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else one[:0]
    for m, g in patterns.groups.items():
        for w, p in g.search(b, start, end, one if g.block == 1 else two, first):
            edge[w] += 1
            edge[w + m] -= 1
            items[row[w]].update(g.items[p].tolist())
            spans.append((int(row[w]), int(w - first[row[w]]), m))
    return np.diff(first), per_row(row[np.cumsum(edge)[:-1] > 0], b.n), spans, items, np.cumsum(edge)[:-1] > 0


def parts_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """Items in parts of about PASS_BYTES of text, one after the other: only one is on the driver at a time, and there is one at least."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // PASS_BYTES) + 1
    for k in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def scanned(docs: DataFrame, patterns: Patterns, first: bool, last: bool) -> DataFrame:
    """One pass: documents (doc_id, text) or what the pass before it left, with covered words and items; the last pass gives the result."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in blocks(x.column("text")):
                ids = x.column("doc_id").slice(b.lo, b.n)
                n_words, _, _, items, covered = search(b, patterns)
                names = [{patterns.names[i] for i in found} for found in items]
                at = np.concatenate(([0], np.cumsum(n_words)))
                if not first:
                    covered |= np.unpackbits(np.frombuffer(b"".join(x.column("covered").slice(b.lo, b.n).to_pylist()), np.uint8)).astype(bool)[kept_bits(n_words)]
                    names = [mine | set(before) for mine, before in zip(names, x.column("items").slice(b.lo, b.n).to_pylist(), strict=True)]
                if not last:
                    bits = [np.packbits(covered[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                    yield frames.batch(MARKED, ids, x.column("text").slice(b.lo, b.n), n_words, bits, [sorted(s) for s in names])
                    continue
                total = np.concatenate(([0], np.cumsum(covered)))
                hit = total[at[1:]] - total[at[:-1]]
                digest = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in names]
                yield frames.batch(OUT, ids, n_words, hit, [len(s) for s in names], digest, hit > 0)

    return docs.mapInArrow(scan, OUT if last else MARKED)


def kept_bits(n: np.ndarray) -> np.ndarray:
    """Places of the rows' bits among whole bytes, n bits a row."""
    start = np.cumsum(-(-n // 8)) * 8 - -(-n // 8) * 8
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each input row: words, hit words, items with occurring windows and their digest.

    Null and empty texts have no words and no hits. Items without words, id or
    text have no windows; item rows that share an id count as one item. Repeated
    rows give repeated rows. An empty benchmark hits nothing. The digest of no
    item is that of the empty string. Other columns are ignored. Each pass but the
    last writes the documents with what it found.
    """
    now, before, ahead = frames.only(docs, id_col, text_col), None, None
    for part in parts_of(benchmark, item_col, item_text):
        if ahead is not None:
            now = frames.stored(scanned(now, Patterns(ahead, window), before is None, False), "marked")
            if before is not None:
                frames.release(before)
            before = now
        ahead = part
    return scanned(now, Patterns(ahead, window), before is None, True)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's rows, all columns, whose texts hold no window of the benchmark; null and empty texts stay, repeated rows share their fate.

    Items without words, id or text take nothing away, nor does an empty benchmark.
    """
    frames.ship(docs.sparkSession)

    def clean_of(rows: DataFrame, patterns: Patterns) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                clean = [search(b, patterns)[1] == 0 for b in blocks(x.column(text_col))]
                if clean:
                    yield x.filter(pa.array(np.concatenate(clean)))

        return rows.mapInArrow(keep, rows.schema)

    now, before, ahead = docs, None, None
    for part in parts_of(benchmark, item_col, item_text):
        if ahead is not None:
            now = frames.stored(clean_of(now, Patterns(ahead, window)), "clean")
            if before is not None:
                frames.release(before)
            before = now
        ahead = part
    return clean_of(now, Patterns(ahead, window))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)
), b AS (
  SELECT item_id, ws, len(ws) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0
), pats AS (
  SELECT item_id, least(n, 10) AS m, array_to_string(ws[i + 1 : i + least(n, 10)], ' ') AS pat
  FROM (SELECT *, unnest(range(n - least(n, 10) + 1)) AS i FROM b)
), sizes AS (SELECT DISTINCT m FROM pats
), docs AS (SELECT doc_id, list(word ORDER BY pos) AS ws, count(*) AS n FROM w GROUP BY doc_id
), wins AS (
  SELECT doc_id, m, i, array_to_string(ws[i + 1 : i + m], ' ') AS pat
  FROM (SELECT doc_id, ws, m, unnest(range(n - m + 1)) AS i FROM docs JOIN sizes ON n >= m)
), hits AS (SELECT doc_id, m, i, item_id FROM wins JOIN pats USING (m, pat)
), words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(docs.n, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN docs USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
