"""N-gram Jaccard join with multiple-global-order filtering.

Sets are distinct word shingles. Two sets of Jaccard similarity t or more share
a token in their prefixes under any global order of tokens. The first order is
by frequency class, then hash, so that prefixes hold rare tokens; the second and
third are by independent hashes. Candidates come from the first order's
prefixes and must also share prefix tokens under the other two; sizes of the sets'
parts by hash bound their overlaps from above. Only candidates that pass all of
these filters have their texts fetched and are verified on their whole sets.

Documents of equal sets are one node. Only what decides components is verified:
each node is first held against the node that leads most of its tokens; then
every candidate pair whose nodes are still in different components. Pairs within
a component need no verdict, so large groups of near copies cost a pass, not
their square, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .graph import components
from .textvec import WORD, Block, U, blocks, distinct, grams, mix, per_row

WORDS, PERCENT = 4, 85
SKETCH_BITS = 17
ORDERS = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25))
#: Members of a token's group that one task compares with one another; larger groups are split into pairs of blocks.
GROUP = 512
#: Parts of the hash range whose set sizes bound an overlap from above.
SIGNATURE = 128
#: Size from which a part is held as unbounded.
FULL = 65535
#: Pairs that a task holds, each once, before it hands them on.
HELD_PAIRS = 1_000_000
#: Pairs whose signatures are compared at a time.
COMPARED = 8192
#: Slices that the tokens of one first node are dealt to: a node of many tokens is no single task.
SLICES = 16
#: Rows of two numbers up to which a side is broadcast instead of shuffled.
BROADCAST_NODES = 1_000_000


def shingles(b: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of a block; a row of fewer words has its whole sequence as one."""
    b = b.lowered()
    start, end, row = b.runs(WORD)
    h = b.hashes(start, end)
    g, at = grams(h, row, words)
    n = per_row(row, b.n)
    first = np.cumsum(n) - n
    extra, erow = [], []
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        if len(short):
            w, _ = grams(h[(first[short][:, None] + np.arange(k)).ravel()], np.repeat(short, k), k)
            extra.append(w ^ U(k))
            erow.append(short)
    return np.concatenate([g, *extra]), np.concatenate([row[at], *erow])


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Frequency class of each bucket of shingles. Bounded by the number of buckets.

    0 up to twice the usual spread of counts above their median, then one more for each doubling of the excess. A
    bucket's count is the sum of many rare shingles, so its spread grows with the root of the corpus alone, and a
    passage whose share of documents stays the same stands out more, not less, as the corpus grows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for x in batches:
            for b in blocks(x.column("text")):
                g, _ = shingles(b, words)
                total += np.bincount((g >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield frames.batch("bucket int, n long", at, total[at])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << SKETCH_BITS)
    total[np.asarray(rows.column("bucket"))] = np.asarray(rows.column("n"))
    usual = np.median(total)
    spread = max(1.0, 1.4826 * float(np.median(np.abs(total - usual))))
    return np.clip(np.log2(np.maximum((total - usual) / spread, 1)), 0, 31).astype(np.uint64)


def keys(b: Block, words: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in the first global order (class, hash), their rows, and set sizes."""
    g, row = shingles(b, words)
    g = classes[(g >> U(64 - SKETCH_BITS)).astype(np.int64)] << U(59) | mix(g) >> U(5)
    k, r = distinct(g, row)
    return k, r, per_row(r, b.n)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set's prefix: all but the least overlap, and one."""
    return n - (n * percent + 99) // 100 + 1


def least_size(percent: int) -> int:
    """The size from which a set can link to another one: n / (n + 1) reaches the threshold."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 40


def place(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(len(r)) - (np.cumsum(n) - n)[r]


def other_prefixes(k: np.ndarray, r: np.ndarray, n: np.ndarray, p: np.ndarray) -> list[list[bytes]]:
    """Of each further order, the first p tokens of each row, ascending, as 32-bit numbers."""
    out, first = [], np.concatenate(([0], np.cumsum(p)))
    for salt in ORDERS:
        o = mix(k ^ salt)
        order = np.lexsort((o, r))
        o = (o[order] >> U(32)).astype("<u4")[place(r, n) < p[r]]
        out.append([o[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)])
    return out


def nodes(docs: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, key, n, node (64-bit digest of the set, null without shingles), prefixes and size signature of each row (doc_id, key, text)."""
    ddl = "doc_id long, key long, n long, node long, prefix array<long>, sig binary, second binary, third binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in blocks(x.column("text")):
                k, r, n = keys(b, words, classes)
                first = np.concatenate(([0], np.cumsum(n)))
                node = [int.from_bytes(hashlib.blake2b(k[i:j].tobytes(), digest_size=8).digest(), "little", signed=True) if j > i else None for i, j in zip(first[:-1], first[1:], strict=True)]
                p = np.where(n >= least_size(percent), prefix_size(n, percent), 0)
                inside = place(r, n) < p[r]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(p))), pa.int32()), pa.array(k[inside].view(np.int64)))
                part = np.minimum(np.bincount(r * SIGNATURE + (k % U(SIGNATURE)).astype(np.int64), minlength=b.n * SIGNATURE), FULL).astype("<u2").reshape(b.n, SIGNATURE)
                own = [x.column(c).slice(b.lo, b.n) for c in ("doc_id", "key")]
                yield frames.batch(ddl, *own, n, node, lists, [v.tobytes() for v in part], *other_prefixes(k, r, n, p))

    return docs.mapInArrow(each, ddl)


def shared(ka, ra, kb, rb, n: int) -> np.ndarray:
    """Keys that each row has on both sides (distinct on each)."""
    k, r = np.concatenate((ka, kb)), np.concatenate((ra, rb))
    order = np.lexsort((k, r))
    k, r = k[order], r[order]
    return per_row(r[1:][(k[1:] == k[:-1]) & (r[1:] == r[:-1])], n)


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of each row's two sets, from the sizes of their parts."""
    least = np.minimum(a, b)
    return np.where((least == FULL).any(1), 1 << 40, least.sum(1, dtype=np.int64))


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SIGNATURE)


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a column of prefixes, and the row of each."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4"), np.repeat(np.arange(len(rows)), [len(v) // 4 for v in rows])


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that share prefix tokens under all orders and whose parts' sizes allow the overlap that a link needs.

    sets: node, n, sig, second, third. A token is held by 32 bits here, which lets some
    pairs through that share none; none that shares one is lost.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, len(x), COMPARED):
                y = x.slice(lo, COMPARED)
                most = most_shared(signatures(y.column("sa")), signatures(y.column("sb")))
                ok = (100 + percent) * most >= percent * (np.asarray(y.column("na")) + np.asarray(y.column("nb")))
                for a, b in (("a2", "b2"), ("a3", "b3")):
                    ka, ra = listed(y.column(a))
                    kb, rb = listed(y.column(b))
                    ok &= shared(*distinct32(ka, ra), *distinct32(kb, rb), len(y)) > 0
                keep = pa.array(ok)
                yield frames.batch("a long, b long", y.column("a").filter(keep), y.column("b").filter(keep))

    both = pairs.join(sets.toDF("a", "na", "sa", "a2", "a3"), "a").join(sets.toDF("b", "nb", "sb", "b2", "b3"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb", "a2", "b2", "a3", "b3").mapInArrow(bound, "a long, b long")


def distinct32(k: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens without those that stand beside an equal one: prefixes are ascending within a row."""
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))[: len(k)]
    return k[new], r[new]


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b) that passed the filters: those whose sets are similar."""
    pairs = frames.stored(pairs, "pairs")
    needed = reps.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("node", "rep", "rep_key")
    needed = frames.stored(needed, "needed")
    small = needed.count() <= BROADCAST_NODES
    texts = docs.join(F.broadcast(needed) if small else needed, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("rep_key"))).select("node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size = max(1, len(x))
            step = max(1, min(size, int(size * (1 << 20) / max(1, x.nbytes))))
            for lo in range(0, len(x), step):
                part = x.slice(lo, step)
                n = len(part)
                sides = []
                for name in ("ta", "tb"):
                    k, r, m = zip(*((k, r + b.lo, m) for b in blocks(part.column(name)) for k, r, m in [keys(b, words, classes)]))
                    sides.append((np.concatenate(k), np.concatenate(r), np.concatenate(m)))
                (ka, ra, na), (kb, rb, nb) = sides
                good = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                inter = shared(ka[good[ra]], ra[good[ra]], kb[good[rb]], rb[good[rb]], n)
                ok = good & (100 * inter >= percent * (na + nb - inter))
                yield frames.batch("a long, b long", part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok)))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    out = frames.stored(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links")
    frames.release(pairs, needed)
    return out


def block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of different components within each (token, block pair) of sorted rows, of sizes and part sizes that allow a link."""

    def pairs(g: dict[str, np.ndarray]):
        i, j = np.triu_indices(len(g["node"]), 1)
        ok = g["comp"][i] != g["comp"][j]
        ok &= (g["bi"][i] == g["bj"][i]) | (g["own"][i] != g["own"][j])
        n, m = g["n"][i], g["n"][j]
        ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        # Overlap after the first common token is bounded by what follows it.
        most = np.minimum(n - g["pos"][i], m - g["pos"][j])
        ok &= (100 + percent) * most >= percent * (n + m)
        i, j = i[ok], j[ok]
        fits = [most_shared(g["sig"][i[k : k + COMPARED]], g["sig"][j[k : k + COMPARED]]) for k in range(0, len(i), COMPARED)]
        ok = (100 + percent) * np.concatenate([np.zeros(0, np.int64), *fits]) >= percent * (g["n"][i] + g["n"][j])
        a, b = g["node"][i[ok]], g["node"][j[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    held: dict[str, np.ndarray] | None = None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    names = ("token", "bi", "bj", "node", "comp", "n", "pos", "own")
    for x in batches:
        now = {k: np.asarray(x.column(k)) for k in names} | {"sig": signatures(x.column("sig"))}
        now = {k: np.concatenate((held[k], v)) for k, v in now.items()} if held else now
        new = np.flatnonzero((now["token"][1:] != now["token"][:-1]) | (now["bi"][1:] != now["bi"][:-1]) | (now["bj"][1:] != now["bj"][:-1])) + 1
        edges = [0, *new.tolist()]
        out = [pairs({k: v[s:e] for k, v in now.items()}) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        held = {k: v[edges[-1] :] for k, v in now.items()}
        found += out
        if sum(len(a) for a, _ in found) > HELD_PAIRS:
            found = [distinct_pairs(found)]
            if len(found[0][0]) > HELD_PAIRS // 2:
                yield frames.batch("a long, b long", *found.pop())
    if held:
        found.append(pairs(held))
    if found:
        yield frames.batch("a long, b long", *distinct_pairs(found))


def distinct_pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node) of each row of docs (doc_id, key, text), and (v, c) components of linked nodes."""
    classes = sketch(docs, words)
    wide = frames.stored(nodes(docs, classes, words, percent).withColumn("uid", F.monotonically_increasing_id()), "nodes")
    own = frames.stored(wide.select("doc_id", "key", "n", "node"), "own")
    # One row stands for a node: joined by its own number, so that a node of many copies is no hot key.
    reps = wide.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key", "uid")).alias("r"))
    reps = frames.stored(reps.select("node", F.col("r.doc_id").alias("rep"), F.col("r.key").alias("rep_key"), F.col("r.uid").alias("rep_uid")), "reps")
    one = wide.where(F.col("n") >= least_size(percent)).join(reps.select("rep_uid"), F.col("uid") == F.col("rep_uid"))
    one = frames.stored(one.select("node", "n", "prefix", "sig", "second", "third"), "sets")
    frames.release(wide)
    sets = one.select("node", "n", "sig", "second", "third")
    post = one.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    # Most tokens have one node: what is known of a token is counted after these are gone.
    tokens = post.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("token")
    post = frames.stored(post.join(tokens, "token"), "post")
    rank = F.shiftleft(F.col("pos").cast("long"), 32) + F.shiftrightunsigned("node", 32)
    lead = post.groupBy("token").agg(F.min_by(F.struct("node", "n"), rank).alias("lead")).select("token", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))
    near = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    first = post.join(lead, "token").where((F.col("node") != F.col("lead")) & near).groupBy("node", "lead").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("lead", "k").alias("lead"))
    found = verified(plausible(first.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), sets, percent), docs, reps, classes, words, percent)
    comp = components(found)
    rest = frames.stored(post.join(comp.toDF("node", "c"), "node", "left").select("token", "node", "n", "pos", F.coalesce("c", "node").alias("comp")), "rest")
    frames.release(post)
    mixed = rest.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("first")).where("low <> high").select("token", "first", F.ceil(F.col("size") / GROUP).alias("parts"))
    # Signatures travel with the rows of mixed tokens, not with the pairs, which grow with the square of a token's group.
    rows = rest.join(mixed, "token").join(sets.select("node", "sig"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("first", F.pmod(F.xxhash64("token"), F.lit(SLICES)).alias("slice"), "token", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", "comp", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "own", "sig")
    # Tokens of the same passage mostly have the same first node: together, they give a pair once for each slice.
    deal = ("first", "slice", "bi", "bj")
    second = frames.stored(rows.repartition(*deal).sortWithinPartitions(*deal, "token").mapInArrow(lambda it: block_pairs(it, percent), "a long, b long").distinct(), "second")
    frames.release(rest)
    more = verified(plausible(second, sets, percent), docs, reps, classes, words, percent)
    frames.release(one, second, reps)
    return own, components(found.union(more))


def components_of(own: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, key, n, node and component_id (null without shingles) of each row of own (doc_id, text); key: its text's hash."""
    each, comp = links(own.withColumn("key", F.xxhash64("text")), words, percent)
    ids = each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(comp.toDF("node", "c"), "node", "left").select("node", "least", F.coalesce("c", "node").alias("c"))
    ids = ids.join(ids.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("node", "c", "component_id")
    return each.join(ids, "node", "left")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id.

    A null, empty or blank text has no shingles and is linked with nothing: its
    component is its own id. Repeated rows give repeated rows. A component's id is
    its smallest doc_id; null ids are passed over unless all are null. Sets are
    held as 59-bit hashes and nodes as 64-bit digests of them. Other columns are ignored.
    """
    own = frames.only(docs, id_col, text_col)
    return components_of(own, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows, all columns, that stand for their component: one for each.

    That is the row of the smallest id (a null id is the largest) and, among texts of
    that id, of the smallest text hash; a row repeated in id and text stays once. Rows
    are told apart by id and text together, so an id on two texts loses neither unless
    they are linked. Null, empty and blank texts are linked with nothing and stay. Other
    columns pass through, whatever their names; an empty input gives no rows.
    """
    key = F.xxhash64(F.col(text_col).cast("string"))
    each = frames.stored(components_of(frames.only(docs, id_col, text_col), words, percent), "components")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    stays = each.where("c is not null").groupBy("c").agg(F.min(at).alias("stays"))
    other = (F.col("stays.key") != F.col("key")) | ~F.col("stays.doc_id").eqNullSafe(F.col("doc_id"))
    gone = frames.stored(each.join(stays, "c").where(other).select(F.col("doc_id").alias("__gone_id"), F.col("key").alias("__gone_key")).distinct(), "gone")
    small = gone.count() <= BROADCAST_NODES
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")) & (key == F.col("__gone_key"))
    kept = docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
    # Texts are dealt out only where some row is repeated.
    repeated = each.groupBy("doc_id", "key").agg(F.count("*").alias("times")).where("times > 1").limit(1).count()
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(frames.table(spark, sf_dir, "documents"))
