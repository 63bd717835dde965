"""Token ids in files of independently coded blocks.

A block holds a fixed number of ids. Each id is four nibbles; for each nibble,
adaptive distributions of order 0 (the nibbles before it), order 1 (and the id
before) and order 2 (and the two before) are mixed by weights that follow their
success, and the mixture drives a range coder. Models start anew with each block,
and a block carries the checksum of its ids. Spark's rows are coded in the JVM, one
block after the other (TokenBlocks.java); ``write_blocks`` and ``read_blocks`` do the
same, byte for byte, without Spark, side by side: one numpy pass moves all blocks of
a group by one nibble.

Block layout, little-endian: magic ``AMX2``, number of ids u32, number of
documents u32, crc32 of the ids u32, place of the first id in the file u64,
length of the code u32; per document its id i64 (with a mark byte, 0 for a null
id), serial number in the file u64, place of its first id here within it u64, and
ids here u32; then the code.
"""

from __future__ import annotations

import functools
import pkgutil
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from . import frames
from .textvec import blocks
from .tokens import Encoder

TOKENIZER, END = "word_bpe_49k.json", 1
#: Ids of a block, and blocks that a task holds until they are passed on.
BLOCK_IDS, HELD = 4096, 256
MAGIC = b"AMX2"
HEAD, DOC = struct.Struct("<4sIIIQI"), struct.Struct("<BqQQI")
BLOCK = "file int, block int, data binary"
PART = "doc long, doc_id long, start long, part long, n long, crc long"
#: What the JVM's two functions return.
CODER = {"Pack": "binary", "Unpack": f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>"}

_TOTAL, _RATE, _SLOTS, _LEAST = 15, 4, 11, 1024
_NODES = 1 + 16 + 256 + 4096
_BASE = (0, 1, 17, 273)
_TARGET = np.array([[k + 1 if k < s else (1 << _TOTAL) - (15 - k) for k in range(16)] for s in range(16)], np.uint16)
_M32 = np.uint64(0xFFFFFFFF)


class Mixer:
    """Adaptive distributions and weights of some lanes."""

    def __init__(self, lanes: int):
        even = ((np.arange(16) + 1) << (_TOTAL - 4)).astype(np.uint16)
        self.tables = [np.tile(even, (lanes * n, 1)) for n in (_NODES, 1 << _SLOTS, 1 << _SLOTS)]
        self.weights = np.full((4, 3, lanes), 65536 // 3, np.int64)
        self.weights[:, 0] += 65536 - 3 * (65536 // 3)
        self.one = np.zeros(lanes, np.uint64)
        self.two = np.zeros(lanes, np.uint64)

    def context(self, lanes: np.ndarray, j: int, node: np.ndarray) -> list[np.ndarray]:
        n = node.astype(np.uint64) + np.uint64(_BASE[j] + 1)
        h1 = (self.one[: len(lanes)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + n * np.uint64(0xC2B2AE3D27D4EB4F)
        h2 = (h1 ^ (self.two[: len(lanes)] + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
        shift = np.uint64(64 - _SLOTS)
        h1 = (h1 * np.uint64(0xD6E8FEB86659FD93)) >> shift
        return [lanes * _NODES + _BASE[j] + node, (lanes << _SLOTS) + h1.astype(np.int64), (lanes << _SLOTS) + (h2 >> shift).astype(np.int64)]

    def mixed(self, at: list[np.ndarray], j: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cumulative mixture (lanes by 16, of total 2**15) and the parts; it rises by 1 at least at each symbol."""
        w = self.weights[j, :, : len(at[0])].astype(np.uint32)
        parts = [t.take(i, axis=0) for t, i in zip(self.tables, at, strict=True)]
        # Parts are below 2**15 + 1 and the weights of a lane sum to 2**16: the sum fits 32 bits.
        total = np.multiply(parts[0], w[0][:, None], dtype=np.uint32)
        total += np.multiply(parts[1], w[1][:, None], dtype=np.uint32)
        total += np.multiply(parts[2], w[2][:, None], dtype=np.uint32)
        total >>= 16
        return total, parts

    def update(self, at: list[np.ndarray], parts: list[np.ndarray], j: int, symbol: np.ndarray) -> None:
        n, rows = len(symbol), np.arange(len(symbol))
        w = self.weights[j, :, :n]
        seen = np.stack([p[rows, symbol].astype(np.int64) - np.where(symbol > 0, p[rows, symbol - 1], 0) for p in parts])
        credit = w * seen
        # Shares of at least _LEAST keep all weights at or above it.
        share = _LEAST + credit[1:] * (65536 - 3 * _LEAST) // credit.sum(0)
        w[1:] += (share - w[1:]) >> 4
        w[0] = 65536 - w[1] - w[2]
        target = _TARGET[symbol]
        for t, i, p in zip(self.tables, at, parts, strict=True):
            # A difference lies within 16 signed bits.
            p += ((target - p).view(np.int16) >> _RATE).view(np.uint16)
            t[i] = p

    def next_id(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.two[:n] = self.one[:n]
        self.one[:n] = ids


def encode_lanes(lanes: list[np.ndarray]) -> list[bytes]:
    """Codes of blocks of ids, each of its own; the longest come first."""
    size = np.array([len(x) for x in lanes])
    assert (size[:-1] >= size[1:]).all()
    n = len(lanes)
    grid = np.zeros((size[0], n), np.int64)
    for k, x in enumerate(lanes):
        grid[: len(x), k] = x
    mixer = Mixer(n)
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFF, np.uint64)
    out, used = np.zeros((n, 5 * int(size[0]) + 16), np.uint8), np.zeros(n, np.int64)
    for t in range(size[0]):
        live = int(np.searchsorted(-size, -t, "left"))
        lane, ids = np.arange(live), grid[t, :live]
        node = np.zeros(live, np.int64)
        for j in range(4):
            symbol = (ids >> (12 - 4 * j)) & 15
            at = mixer.context(lane, j, node)
            cum, parts = mixer.mixed(at, j)
            start = np.where(symbol > 0, cum[lane, symbol - 1], np.uint32(0))
            mixer_freq = cum[lane, symbol] - start
            mixer.update(at, parts, j, symbol)
            lo, sp = low[:live], span[:live]
            sp >>= np.uint64(_TOTAL)
            lo += start.astype(np.uint64) * sp
            lo &= _M32
            sp *= mixer_freq.astype(np.uint64)
            while True:
                same = ((lo ^ ((lo + sp) & _M32)) < np.uint64(1 << 24)) & (lo + sp <= _M32)
                tight = ~same & (sp < np.uint64(1 << 16))
                move = np.flatnonzero(same | tight)
                if not len(move):
                    break
                k = np.flatnonzero(tight)
                sp[k] = (~lo[k] + np.uint64(1)) & np.uint64(0xFFFF)
                out[move, used[move]] = (lo[move] >> np.uint64(24)).astype(np.uint8)
                used[move] += 1
                lo[move] = (lo[move] << np.uint64(8)) & _M32
                sp[move] = (sp[move] << np.uint64(8)) & _M32
            node = node * 16 + symbol
        mixer.next_id(ids.astype(np.uint64))
    for _ in range(4):
        out[np.arange(n), used] = (low >> np.uint64(24)).astype(np.uint8)
        used += 1
        low = (low << np.uint64(8)) & _M32
    return [out[k, : used[k]].tobytes() for k in range(n)]


def decode_lanes(codes: list[bytes], size: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks from their codes and numbers of ids, the longest first."""
    n = len(codes)
    width = max(map(len, codes)) + 8
    data = np.zeros((n, width), np.uint8)
    for k, c in enumerate(codes):
        data[k, : len(c)] = np.frombuffer(c, np.uint8)
    mixer = Mixer(n)
    low, span, code = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFF, np.uint64), np.zeros(n, np.uint64)
    for k in range(4):
        code = (code << np.uint64(8)) | data[:, k].astype(np.uint64)
    used = np.full(n, 4)
    grid = np.zeros((size[0], n), np.int64)
    for t in range(size[0]):
        live = int(np.searchsorted(-size, -t, "left"))
        lane, node = np.arange(live), np.zeros(live, np.int64)
        for j in range(4):
            at = mixer.context(lane, j, node)
            cum, parts = mixer.mixed(at, j)
            lo, sp, cd = low[:live], span[:live], code[:live]
            sp >>= np.uint64(_TOTAL)
            value = np.minimum(((cd - lo) & _M32) // sp, np.uint64((1 << _TOTAL) - 1)).astype(np.uint32)
            symbol = (cum <= value[:, None]).view(np.uint8).sum(1, dtype=np.int64)
            start = np.where(symbol > 0, cum[lane, symbol - 1], np.uint32(0))
            freq = cum[lane, symbol] - start
            mixer.update(at, parts, j, symbol)
            lo += start.astype(np.uint64) * sp
            lo &= _M32
            sp *= freq.astype(np.uint64)
            while True:
                same = ((lo ^ ((lo + sp) & _M32)) < np.uint64(1 << 24)) & (lo + sp <= _M32)
                tight = ~same & (sp < np.uint64(1 << 16))
                move = np.flatnonzero(same | tight)
                if not len(move):
                    break
                k = np.flatnonzero(tight)
                sp[k] = (~lo[k] + np.uint64(1)) & np.uint64(0xFFFF)
                cd[move] = ((cd[move] << np.uint64(8)) & _M32) | data[move, np.minimum(used[move], width - 1)].astype(np.uint64)
                used[move] += 1
                lo[move] = (lo[move] << np.uint64(8)) & _M32
                sp[move] = (sp[move] << np.uint64(8)) & _M32
            node = node * 16 + symbol
        grid[t, :live] = node
        mixer.next_id(node.astype(np.uint64))
    return [grid[:s, k].astype("<u4") for k, s in enumerate(size)]


def _block(ids: np.ndarray, at: int, docs: list[tuple], code: bytes) -> bytes:
    table = b"".join(DOC.pack(d is not None, d or 0, *rest) for d, *rest in docs)
    return HEAD.pack(MAGIC, len(ids), len(docs), zlib.crc32(ids.astype("<u4").tobytes()), at, len(code)) + table + code


def write_blocks(groups: list[tuple[np.ndarray, int, list[tuple]]]) -> list[bytes]:
    """Blocks of (ids, place in the file, documents), in the given order."""
    order = sorted(range(len(groups)), key=lambda k: -len(groups[k][0]))
    codes = dict(zip(order, encode_lanes([groups[k][0] for k in order]), strict=True))
    return [_block(ids, at, docs, codes[k]) for k, (ids, at, docs) in enumerate(groups)]


def read_blocks(data: list[bytes]) -> list[tuple[np.ndarray, int, list[tuple]]]:
    """(ids, place in the file, documents) of each block; raises ValueError where a checksum, the magic or a length is wrong."""
    heads, codes = [], []
    for x in data:
        magic, n, n_docs, crc, at, length = HEAD.unpack_from(x)
        body = HEAD.size + n_docs * DOC.size
        if magic != MAGIC or len(x) != body + length:
            raise ValueError("not a block of token ids")
        docs = [(d if known else None, *rest) for known, d, *rest in DOC.iter_unpack(x[HEAD.size : body])]
        heads.append((n, crc, at, docs))
        codes.append(x[body:])
    order = sorted(range(len(heads)), key=lambda k: -heads[k][0])
    ids = dict(zip(order, decode_lanes([codes[k] for k in order], np.array([heads[k][0] for k in order])), strict=True))
    for k, (_, crc, _, _) in enumerate(heads):
        if zlib.crc32(ids[k].tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
    return [(ids[k], h[2], h[3]) for k, h in enumerate(heads)]


_CODERS: dict[str, dict] = {}


def coder(spark: SparkSession, name: str, column: str) -> Column:
    """What the JVM's function ``name`` makes of a column of blocks.

    Once for each application the coder is compiled, by the compiler that Spark has
    for its own plans, and sent to the executors.
    """
    if (app := spark.sparkContext.applicationId) not in _CODERS:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__package__, "TokenBlocks.java").decode())
        jar = f"{tempfile.mkdtemp()}/token-blocks.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for path, code in compiler.getBytecodes().items():
                z.writestr(f"{path.replace('.', '/')}.class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)
        _CODERS[app] = {x: compiler.getClassLoader().loadClass(f"anchorite.llm.TokenBlocks${x}").newInstance() for x in CODER}
    session, function = spark._jsparkSession, f"token_blocks_{name.lower()}"
    session.udf().register(function, _CODERS[app][name], session.parseDataType(_parse_datatype_string(CODER[name]).json()))
    return F.call_function(function, column)


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Blocks (file, block, data) of the token ids of all documents in ascending doc_id order, stored in the shared folder.

    Files follow each other by doc_id, so do the blocks of a file; a document may go
    on in the next block of its file. Null ids come first, equal ids by crc32 of the text.
    """
    own = frames.only(docs, id_col, text_col)
    tie = F.crc32(F.coalesce("text", F.lit("")))
    own = own.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = Encoder.of(tokenizer), TaskContext.get().partitionId()
        ids, table, serial, place, number = [], [], 0, 0, 0
        held, groups = 0, []

        def close() -> None:
            nonlocal ids, table, held, place
            groups.append((np.concatenate(ids), place, table))
            place += held
            ids, table, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, groups
            data = [_block(ids, at, docs, ids.astype("<u4").tobytes()) for ids, at, docs in groups]
            numbers = range(number, number + len(data))
            number, groups = number + len(data), []
            return frames.batch(BLOCK, [file] * len(data), numbers, data)

        for x in batches:
            names = x.column("doc_id").to_pylist()
            for b in blocks(x.column("text")):
                flat, off = encoder.encode(b)
                for i in range(b.n):
                    own_ids = np.append(flat[off[i] : off[i + 1]], end)
                    at = 0
                    while at < len(own_ids):
                        take = min(len(own_ids) - at, BLOCK_IDS - held)
                        ids.append(own_ids[at : at + take])
                        table.append((names[b.lo + i], serial, at, take))
                        at, held = at + take, held + take
                        if held == BLOCK_IDS:
                            close()
                    serial += 1
                if len(groups) >= HELD:
                    yield flush()
        if held:
            close()
        if groups:
            yield flush()

    plain = own.select("doc_id", "text").mapInArrow(each, BLOCK)
    return frames.stored(plain.withColumn("data", coder(docs.sparkSession, "Pack", "data")), "token-files")


def _times(m: list[int], v: int) -> int:
    s, i = 0, 0
    while v:
        if v & 1:
            s ^= m[i]
        v >>= 1
        i += 1
    return s


@functools.cache
def _zeros(k: int) -> list[int]:
    """What 2**k zero bytes make of each bit of a crc."""
    if k < 0:
        bit = [0xEDB88320, *(1 << i for i in range(31))]
        power = [_times(bit, x) for x in bit]
        return [_times(power, x) for x in power]
    m = _zeros(k - 1)
    return [_times(m, x) for x in m]


def crc_join(a: int, b: int, n: int) -> int:
    """crc32 of two byte strings joined, from theirs and the second's length: a is moved by n zero bytes."""
    k = 0
    while n >> k:
        if n >> k & 1:
            a = _times(_zeros(k), a)
        k += 1
    return a ^ b


def read(stored: DataFrame) -> DataFrame:
    """One row for each document of the blocks, read back: doc_id, start, n_tokens, ids_crc32."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ddl = "file int, doc_id long, start long, n_tokens long, ids_crc32 long"
        for x in batches:
            crcs = []
            for parts in x.column("parts").to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield frames.batch(ddl, x.column("file"), x.column("doc_id"), x.column("start"), x.column("n_tokens"), crcs)

    parts = frames.stored(stored.select("file", F.inline(coder(stored.sparkSession, "Unpack", "data"))), "token-parts")
    sizes = parts.groupBy("file").agg(F.sum("n").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    docs = parts.groupBy("file", "doc").agg(F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))
    docs = docs.select("file", "doc_id", "start", "n_tokens", "parts").mapInArrow(whole, "file int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # One row for each file: as many as the partitions that wrote them.
    return docs.join(F.broadcast(sizes.select("file", "base")), "file").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each input row, from files written and read back.

    A null text counts as empty: its one id is the end id. Repeated rows are
    written each for itself. An empty input gives no rows. Other columns are ignored.
    """
    return read(write(docs, id_col, text_col, tokenizer))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(frames.table(spark, sf_dir, "documents"))
