"""What stands around a mention: counts within windows of characters, row by row of documents.

Words of a text follow one another, so what lies within a number of characters is a
range of them, found by binary search; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Mentions held against their windows at once.
CHUNK = 2048


def words(batch: pa.RecordBatch, surfaces: pa.Array, gap: int) -> dict[str, np.ndarray]:
    """Columns of all words of a batch (doc_id, plain, folded): row, pos, start and end on one axis with a gap between texts, code of the surface, its number among the surfaces or -1."""
    toks, folded = (pc.split_pattern(batch.column(c).cast(pa.large_string()), " ") for c in ("plain", "folded"))
    offsets, flat = np.asarray(toks.offsets), toks.flatten()
    size = np.asarray(pc.utf8_length(flat)).astype(np.int64)
    row = np.repeat(np.arange(len(batch)), np.diff(offsets))
    pos = np.arange(len(size)) - offsets[row] + offsets[0]
    width = np.where(size > 0, size + 1, 0)
    end = np.cumsum(width)
    code = folded.flatten().dictionary_encode()
    number = pc.fill_null(pc.index_in(code.dictionary, value_set=surfaces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(code.dictionary, "").to_numpy(zero_copy_only=False)
    codes = np.asarray(code.indices).astype(np.int64)
    kept = size > 0
    start = (end - width + row * gap)[kept]
    return {"row": row[kept], "pos": pos[kept], "start": start, "end": start + size[kept], "code": codes[kept], "number": number[codes][kept], "filled": ~blank[codes][kept]}


def neighbours(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word before and after with the same code, -1 and the number of words where there is none."""
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    before, after = np.full(len(code), -1), np.full(len(code), len(code))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def around(docs: DataFrame, surfaces: pa.Array, windows: tuple[int, ...]) -> DataFrame:
    """doc_id, pos and, of each word with a known surface: other words with a surface within each window, and how many differ within the widest (the last)."""
    names = [f"n{w}" for w in windows]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch, surfaces, 4 * windows[-1])
            m = np.flatnonzero(w["number"] >= 0)
            below, own, counts = np.concatenate([[0], np.cumsum(w["filled"])]), w["filled"][m], []
            for size in windows:
                lo, hi = np.searchsorted(w["start"], w["start"][m] - size, "left"), np.searchsorted(w["end"], w["end"][m] + size, "right")
                counts.append(below[hi] - below[lo] - own)
            # A word is the first of its kind where the one before lies outside.
            before, after = neighbours(w["code"])
            order = np.argsort(lo - hi, kind="stable")
            lo_, hi_, distinct = lo[order], hi[order], np.zeros(len(m), np.int64)
            widths = hi_ - lo_
            for k in range(int(widths[0]) if len(m) else 0):
                n = int(np.searchsorted(-widths, -k, "left"))
                j = lo_[:n] + k
                distinct[:n] += w["filled"][j] & (before[j] < lo_[:n])
            n_distinct = np.empty(len(m), np.int64)
            n_distinct[order] = distinct
            n_distinct -= own & (before[m] < lo) & (after[m] >= hi)
            some = counts[-1] > 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(w["row"][m][some])), pa.array(w["pos"][m][some]), *(pa.array(c[some].astype(np.int64)) for c in counts), pa.array(n_distinct[some])], names=["doc_id", "pos", *names, "n_distinct"])

    return docs.mapInArrow(each, "doc_id bigint, pos bigint, " + ", ".join(f"{n} bigint" for n in names) + ", n_distinct bigint")


def coherence(docs: DataFrame, surfaces: pa.Array, tops: np.ndarray, offered: tuple[np.ndarray, np.ndarray], titles: pa.Array, pairs: tuple[np.ndarray, ...], reach: int) -> DataFrame:
    """Sums over the first titles of mentions nearer than reach characters, for each offered title of a mention that is near one of them.

    tops: first title of each surface; offered: surface and title, sorted by surface;
    pairs: title, title, in_pmi, in_ngd, weight where titles are near, sorted by both.
    """
    n = len(titles)
    key = pairs[0] * n + pairs[1]

    def values(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, ...]:
        want = (c[:, None] * n + o[None, :]).ravel()
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        hit = (key[at] == want) if len(key) else np.zeros(len(want), bool)
        shape = (len(c), len(o))
        return (hit.reshape(shape), *(np.where(hit, x[at] if len(key) else 0.0, 0.0).reshape(shape) for x in pairs[2:]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch, surfaces, 4 * reach)
            m = np.flatnonzero(w["number"] >= 0)
            start, surface, row, pos = (w[c][m] for c in ("start", "number", "row", "pos"))
            top = tops[surface]
            lo, hi = np.searchsorted(start, start - reach + 1, "left"), np.searchsorted(start, start + reach - 1, "right")
            first, last = np.searchsorted(offered[0], surface, "left"), np.searchsorted(offered[0], surface, "right")
            for a in range(0, len(m), CHUNK):
                b = min(a + CHUNK, len(m))
                i0, i1 = lo[a], hi[b - 1]
                local, at = np.unique(top[i0:i1], return_inverse=True)
                one = np.zeros((i1 - i0 + 1, len(local)), np.int32)
                one[np.arange(1, i1 - i0 + 1), at] = 1
                one = np.cumsum(one, axis=0, dtype=np.int32)
                count = one[hi[a:b] - i0] - one[lo[a:b] - i0]
                mine = at[a - i0 : b - i0]
                same = count[np.arange(b - a), mine].astype(np.int64)
                n_context = hi[a:b] - lo[a:b] - same
                count[np.arange(b - a), mine] -= 1
                times = last[a:b] - first[a:b]
                who = np.repeat(np.arange(b - a), times)
                title = offered[1][np.repeat(first[a:b], times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)]
                kinds, of = np.unique(title, return_inverse=True)
                near, pmi, ngd, both = values(kinds, local)
                seen = count[who]
                live = (seen > 0) & near[of]
                keep = np.flatnonzero(live.any(axis=1))
                seen, live, of_, who_ = seen[keep].astype(np.float64), live[keep], of[keep], who[keep]
                sums = [np.einsum("ij,ij->i", seen, x[of_]) for x in (pmi, both)]
                most = np.where(live, ngd[of_], -np.inf).max(axis=1) if len(keep) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[a:b][who_])), pa.array(pos[a:b][who_]), titles.take(pa.array(title[keep])), pa.array(n_context[who_].astype(np.int64)), pa.array(sums[0]), pa.array(most), pa.array(sums[1])], names=["doc_id", "pos", "title", "n_context", "in_pmi", "in_ngd", "two_way"])

    return docs.mapInArrow(each, "doc_id bigint, pos bigint, title string, n_context bigint, in_pmi double, in_ngd double, two_way double")


def cosines(docs: DataFrame, surfaces: pa.Array, windows: tuple[int, ...], offered: tuple[np.ndarray, np.ndarray], titles: pa.Array, weights: tuple[np.ndarray, np.ndarray], lens: np.ndarray) -> DataFrame:
    """Cosine of each offered title's words and those around a mention within each window, not rounded.

    docs also hold bag, the idf of each of their surfaces; offered: surface and title,
    sorted by surface; weights: number of the offer times the surfaces plus the word,
    sorted, and weight; lens: length of each offer's words, 0 without any.
    """
    n, g = len(windows), max(len(surfaces), 1)
    names = [f"win{k}" for k in range(n)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch, surfaces, 4 * windows[-1])
            bag = batch.column("bag").flatten()
            folded = pc.split_pattern(batch.column("folded").cast(pa.large_string()), " ").flatten().dictionary_encode().dictionary
            idf = pc.fill_null(bag.field("idf").take(pc.index_in(folded, value_set=bag.field("token").cast(pa.large_string()))), 0.0).to_numpy(zero_copy_only=False)
            all_m = np.flatnonzero(w["number"] >= 0)
            wide = np.searchsorted(w["end"], w["end"][all_m] + windows[-1], "right") - np.searchsorted(w["start"], w["start"][all_m] - windows[-1], "left")
            all_m = all_m[np.argsort(wide, kind="stable")]
            for a in range(0, len(all_m), CHUNK):
                m = all_m[a : a + CHUNK]
                lo = [np.searchsorted(w["start"], w["start"][m] - x, "left") for x in windows]
                hi = [np.searchsorted(w["end"], w["end"][m] + x, "right") for x in windows]
                j = lo[-1][:, None] + np.arange((hi[-1] - lo[-1]).max())
                live = (j < hi[-1][:, None]) & (j != m[:, None])
                j = np.minimum(j, len(w["code"]) - 1)
                live &= w["filled"][j]
                # The narrowest window that holds a word; each wider one holds it too.
                kind = n - sum(((j >= x[:, None]) & (j < y[:, None])).astype(np.int64) for x, y in zip(lo, hi, strict=True))
                key = np.sort(np.where(live, w["code"][j] * 8 + kind, np.int64(1) << 60), axis=1)
                code, kind_ = key >> 3, key & 7
                times, square = np.zeros((len(m), n), np.int64), np.zeros((len(m), n))
                for k in range(key.shape[1]):
                    there = key[:, k] < 1 << 60
                    if not there.any():
                        break
                    if k:
                        times[code[:, k] != code[:, k - 1]] = 0
                    more = there[:, None] & (kind_[:, k][:, None] <= np.arange(n))
                    times += more
                    square += more * (2 * times - 1) * (idf[np.where(there, code[:, k], 0)] ** 2)[:, None]
                first, last = np.searchsorted(offered[0], w["number"][m], "left"), np.searchsorted(offered[0], w["number"][m], "right")
                offers = last - first
                begin = np.cumsum(offers) - offers
                who = np.repeat(np.arange(len(m)), offers)
                offer = np.repeat(first, offers) + np.arange(len(who)) - begin[who]
                r, c = np.nonzero(live & (w["number"][j] >= 0))
                at = np.repeat(begin[r], offers[r]) + np.arange(offers[r].sum()) - np.repeat(np.cumsum(offers[r]) - offers[r], offers[r])
                r, c = np.repeat(r, offers[r]), np.repeat(c, offers[r])
                word = j[r, c]
                want = offer[at] * g + w["number"][word]
                hit = np.minimum(np.searchsorted(weights[0], want), max(len(weights[0]) - 1, 0))
                part = np.where(weights[0][hit] == want, weights[1][hit], 0.0) * idf[w["code"][word]] if len(weights[0]) else np.zeros(len(want))
                dot = np.cumsum(np.bincount(at * n + kind[r, c], part, len(who) * n).reshape(-1, n), axis=1)
                under = np.sqrt(square)[who] * lens[offer][:, None]
                value = np.divide(dot, under, out=np.zeros_like(dot), where=under > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(w["row"][m][who])), pa.array(w["pos"][m][who]), titles.take(pa.array(offered[1][offer])), *(pa.array(value[:, k]) for k in range(n))], names=["doc_id", "pos", "title", *names])

    return docs.mapInArrow(each, "doc_id bigint, pos bigint, title string, " + ", ".join(f"{x} double" for x in names))
