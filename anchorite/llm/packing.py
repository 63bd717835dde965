"""Best-fit packing with certified bin counts.

Pieces are dealt to partitions by a hash and packed best-fit decreasing. Lower
bounds from dual feasible functions certify each partition's bin count; the
pieces of partly filled bins of partitions with a gap to their bound are dealt
anew among those partitions and packed again, while that saves bins. At last the
loosest bins of all partitions are pooled and packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .textvec import blocks
from .tokens import Encoder

TOKENIZER, CAPACITY, END = "byte_bpe_50k.json", 2048, 0
#: Pieces packed by one task.
PART_PIECES = 20_000
#: Bins of a partition, the emptiest ones, that the last rounds take up again.
LOOSE = 16
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", uid long, part long, bin long, offset long, room long, bins long, bound long, rank long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document's ids and end id: one for a document that fits, else full ones after a first piece with the rest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for x in batches:
            docs_in = x.column("doc_id")
            for b in blocks(x.column("text")):
                ids, off = encoder.encode(b)
                rows, number, start, length, crc = [], [], [], [], []
                for i in range(b.n):
                    own = np.append(ids[off[i] : off[i + 1]], END).astype("<u4")
                    n = len(own)
                    at = [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (s, e) in enumerate(zip(at, [*at[1:], n], strict=True)):
                        rows.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(own[s:e].tobytes()))
                yield frames.batch(PIECE, docs_in.slice(b.lo, b.n).take(pa.array(rows, pa.int64())), number, start, length, crc)

    return docs.mapInArrow(each, PIECE)


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and room left in each bin, by best-fit decreasing."""
    at, offset, room = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        at[i], offset[i] = k, capacity - r
        room[k] = r - n
        if r > n:
            by_room[r - n].append(k)
            some |= 1 << (r - n)
    return at, offset, np.array(room, np.int64)


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual feasible functions."""
    count = np.bincount(length, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    number, total = np.concatenate((np.cumsum(count[::-1])[::-1], [0])), np.concatenate((np.cumsum((count * x)[::-1])[::-1], [0]))
    for e in range(1, capacity // 2 + 1):  # sizes over capacity - e count as full, those under e as nothing
        full = number[capacity - e + 1]
        best = max(best, int(full) + -(-int(total[e] - total[capacity - e + 1]) // capacity))
    for k in range(1, 101):
        exact = (x * (k + 1)) % capacity == 0
        # In units of capacity * k.
        best = max(best, -(-int((count * np.where(exact, x * k, ((x * (k + 1)) // capacity) * capacity)).sum()) // (capacity * k)))
    return best


def pack_part(t: pa.Table, capacity: int, stage: int) -> pa.Table:
    length = np.asarray(t.column("length"))
    at, offset, room = best_fit(length, capacity)
    bound = lower_bound(length, capacity)
    order = np.argsort(-room, kind="stable")
    rank = np.empty(len(room), np.int64)
    rank[order] = np.arange(len(room))
    base = (stage << 56) + (int(t.column("part")[0].as_py()) << 28)
    n = len(length)
    columns = [t.column(k).combine_chunks() if k in t.column_names else None for k in ("doc_id", "piece", "start", "length", "ids_crc32", "uid", "part")]
    values = [base + at, offset, room[at], np.full(n, len(room)), np.full(n, bound), rank[at]]
    return pa.Table.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in values)], schema=frames.schema(PACKED))


def packed_by(loose: DataFrame, n: int, capacity: int, stage: int) -> DataFrame:
    """Loose pieces dealt to ceil(n / PART_PIECES) partitions by a hash of the stage, each packed by itself."""
    parts = max(1, -(-n // PART_PIECES))
    dealt = loose.select("doc_id", "piece", "start", "length", "ids_crc32", "uid").withColumn("part", F.pmod(F.xxhash64(F.lit(stage), "uid"), F.lit(parts)))
    return frames.stored(dealt.groupBy("part").applyInArrow(lambda t: pack_part(t, capacity, stage), PACKED), "packed")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound.

    bins is the number of sequences of the piece's partition and bound the certified
    least one: where they are equal, no packing of that partition needs fewer.
    Partitions with a gap exchange their documents in rounds until a round saves no
    sequence; then the emptiest sequences of all partitions do so. A null text counts
    as empty: its one piece is the end id. Repeated rows are packed each for itself;
    ids may be null. An empty input gives no rows. Other columns are ignored.
    """
    own = frames.only(docs, id_col, text_col)
    all_pieces = frames.stored(pieces(own, tokenizer, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    one = F.lit(1).cast("long")
    full = all_pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    loose = all_pieces.where(F.col("length") < capacity)
    done, now, stage = [], packed_by(loose, loose.count(), capacity, 0), 0
    for take in (F.col("bins") > F.col("bound"), F.col("rank") < LOOSE):
        saved = 1
        while saved:
            stage += 1
            again = take & (F.col("room") > 0)
            free = now.where(again)
            n, before, where = free.agg(F.count("*"), F.countDistinct("bin"), F.countDistinct("part")).first()
            # The same pieces in one partition would be packed the same way again.
            if n == 0 or (where < 2 and now.where(~again).limit(1).count() == 0):
                break
            packed = packed_by(free, n, capacity, stage)
            saved = before - packed.select("bin").distinct().count()
            if saved > 0:
                done.append(now.where(~again))
                now = packed
            else:
                saved = 0
    out = now
    for d in done:
        out = out.unionByName(d)
    return full.unionByName(out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", "bins", "bound"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(frames.table(spark, sf_dir, "documents"))
