"""Language identification by a bidirectional gated recurrent network over bytes.

The gates and the candidate squash by x / (1 + |x|), which costs a fraction of a
tanh. The network is trained in numpy by backpropagation through time on windows
of labelled documents, and labels every byte position; a document's probability of
a language is the mean over its letter positions. Texts are cut into windows
that run in lockstep, so a long text costs what many short ones do. Each window's
states are carried in over the bytes before and after it, and no byte is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames, learn
from .textvec import Block, blocks

#: Bound on labelled documents for each language that the network is fitted to, and windows from each of them.
MAX_DOCS, DRAWS = 300, 64
SLICES = 64
HIDDEN, STEPS, TRAIN_WINDOW, BATCH, RATE = 6, 400, 48, 128, 0.02
#: Bytes of a window whose positions are labelled, and those read on each side of it before, so that no state starts fresh.
WINDOW, WARM, LANES = 160, 16, 2048
PARTS, HELD = 4, 2
UNDETERMINED = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def gates(p: dict, x: np.ndarray, h: np.ndarray):
    """One step: update z, reset r, candidate c and the next state, for lanes x of bytes."""
    k = h.shape[1]
    pre, rec = p["w"][x], h @ p["u"]
    zr = 0.5 + 0.5 * squash(0.5 * (pre[:, : 2 * k] + rec[:, : 2 * k]))
    z, r = zr[:, :k], zr[:, k:]
    c = squash(pre[:, 2 * k :] + r * (rec[:, 2 * k :] + p["d"]))
    return z, r, c, rec[:, 2 * k :] + p["d"], c + z * (h - c)


def run(p: dict, x: np.ndarray, keep: bool = False):
    """States after each position of lanes x (positions by lanes); with ``keep``, what backpropagation needs."""
    h = np.zeros((x.shape[1], p["u"].shape[0]), p["u"].dtype)
    out, tape = np.empty((*x.shape, h.shape[1]), h.dtype), []
    for t in range(len(x)):
        z, r, c, q, after = gates(p, x[t], h)
        if keep:
            tape.append((h, z, r, c, q))
        out[t] = h = after
    return (out, tape) if keep else out


def back(p: dict, x: np.ndarray, tape: list, dout: np.ndarray) -> dict:
    """Gradients through time of one direction, given those of the states."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dh, steps = np.zeros_like(dout[0]), np.empty((*x.shape, p["w"].shape[1]))
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, q = tape[t]
        dh = dh + dout[t]
        dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
        dz = dh * (h - c) * 0.25 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * q * 0.25 * (1 - np.abs(2 * r - 1)) ** 2
        pre = np.concatenate((dz, dr, dc), 1)
        rec = np.concatenate((dz, dr, dc * r), 1)
        steps[t] = pre
        g["u"] += h.T @ rec
        g["d"] += (dc * r).sum(0)
        dh = dh * z + rec @ p["u"].T
    for j in range(steps.shape[2]):
        g["w"][:, j] = np.bincount(x.ravel(), steps[..., j].ravel(), len(g["w"]))
    return g


class Network:
    def __init__(self, langs: list[str], seed: int = 5):
        self.langs, rng, k, n = langs, np.random.default_rng(seed), HIDDEN, len(langs)
        make = lambda: {"w": rng.normal(0, 0.3, (256, 3 * k)), "u": rng.normal(0, k**-0.5, (k, 3 * k)), "d": np.zeros(k)}
        self.f, self.b, self.v, self.o = make(), make(), rng.normal(0, 0.3, (2 * k, n)), np.zeros(n)

    def loss_step(self, opt: learn.Adam, x: np.ndarray, y: np.ndarray) -> float:
        """One step on windows x (positions by lanes) of languages y, each letter position labelled."""
        hf, tf = run(self.f, x, True)
        hb, tb = run(self.b, x[::-1], True)
        h = np.concatenate((hf, hb[::-1]), 2)
        s = h @ self.v + self.o
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        mask = LETTER[x].astype(float)
        mask /= max(mask.sum(), 1)
        loss = -(np.log(np.take_along_axis(s, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0] + 1e-12) * mask).sum()
        s[:, np.arange(len(y)), y] -= 1
        s *= mask[..., None]
        dh = s @ self.v.T
        k = HIDDEN
        gf, gb = back(self.f, x, tf, dh[..., :k]), back(self.b, x[::-1], tb, dh[::-1, :, k:])
        grads = [*gf.values(), *gb.values(), h.reshape(-1, 2 * k).T @ s.reshape(-1, s.shape[2]), s.sum((0, 1))]
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        opt.step([g * min(1.0, 1.0 / max(norm, 1e-9)) for g in grads])
        return float(loss)

    def fit(self, windows: list[bytes], y: np.ndarray, seed: int = 5) -> "Network":
        rng = np.random.default_rng(seed)
        opt = learn.Adam([*self.f.values(), *self.b.values(), self.v, self.o], RATE)
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        for i in range(STEPS):
            lang = rng.integers(0, len(self.langs), BATCH)
            x = np.full((TRAIN_WINDOW, BATCH), 32, np.uint8)
            for j, k in enumerate(lang):
                w = np.frombuffer(windows[of[k][rng.integers(len(of[k]))]], np.uint8)
                x[: len(w), j] = w
            opt.rate = RATE * (1 - i / STEPS) + 0.0005
            self.loss_step(opt, x, lang)
        for p in (self.f, self.b):
            for name in p:
                p[name] = p[name].astype(np.float32)
        self.v, self.o = self.v.astype(np.float32), self.o.astype(np.float32)
        return self

    def compiled(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Weights of both directions with gates first (k by lanes) and the sigmoids' halves folded in, so that each step squashes all gates at once."""
        out, k = [], HIDDEN
        half = np.concatenate((np.full(2 * k, 0.5), np.ones(k)))
        for p in (self.f, self.b):
            u = p["u"] * np.concatenate((np.full(2 * k, 0.5), np.full(k, 0.5)))
            out.append(((p["w"] * half).T.astype(np.float32).copy(), u.T.astype(np.float32).copy(), (0.5 * p["d"])[:, None].astype(np.float32)))
        return out

    def states(self, weights: tuple, x: np.ndarray) -> np.ndarray:
        """What run() gives, for prediction: positions by hidden units by lanes."""
        (w, u, d), k, lanes = weights, HIDDEN, x.shape[1]
        out = np.empty((len(x), k, lanes), np.float32)
        h = np.zeros((k, lanes), np.float32)
        pre, rec, tmp = np.empty((3 * k, lanes), np.float32), np.empty((3 * k, lanes), np.float32), np.empty((k, lanes), np.float32)
        gate = np.empty((2 * k, lanes), np.float32)
        zr, c, q = pre[: 2 * k], pre[2 * k :], rec[2 * k :]
        for t in range(len(x)):
            np.take(w, x[t], axis=1, out=pre, mode="clip")
            np.dot(u, h, out=rec)
            zr += rec[: 2 * k]
            np.abs(zr, out=gate)
            gate += 1
            zr /= gate
            q += d
            np.multiply(pre[k : 2 * k], q, out=tmp)
            tmp += q
            c += tmp
            np.abs(c, out=tmp)
            tmp += 1
            c /= tmp
            z = pre[:k]
            z *= 0.5
            z += 0.5
            h = out[t]
            np.subtract(out[t - 1] if t else 0, c, out=h)
            h *= z
            h += c
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each position of lanes x: positions by languages by lanes."""
        forward, backward = self.compiled()
        v = self.v.T.astype(np.float32).copy()
        s = np.matmul(v[:, :HIDDEN], self.states(forward, x))
        s += np.matmul(v[:, HIDDEN:], self.states(backward, x[::-1]))[::-1]
        s += self.o[:, None]
        np.exp(np.clip(s, -60, 60, out=s), out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def pooled(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities over each row's letter positions, and the number of those."""
        n = len(self.langs)
        total, letters = np.zeros((b.n, n)), b.sums(LETTER[b.buf])
        size = np.diff(b.off)
        count = -(-size // WINDOW)
        row = np.repeat(np.arange(b.n), count)
        start = b.off[:-1][row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(start + WINDOW, b.off[1:][row])
        lo, hi = np.maximum(start - WARM, b.off[:-1][row]), np.minimum(stop + WARM, b.off[1:][row])
        order = np.argsort(lo - hi, kind="stable")  # the longest first
        pad = np.concatenate((b.buf, np.full(WINDOW + 2 * WARM, 32, np.uint8)))
        for i in range(0, len(order), LANES):
            lane = order[i : i + LANES]
            at = lo[lane] + np.arange(int((hi - lo)[lane].max()))[:, None]
            x = np.where(at < hi[lane], pad[at], 32)
            p = self.label(x)
            p *= (LETTER[x] & (at >= start[lane]) & (at < stop[lane]))[:, None, :]
            np.add.at(total, row[lane], p.sum(0).T)
        return total / np.maximum(letters, 1)[:, None], letters


def has_letter(b: Block) -> np.ndarray:
    """Rows with a letter: an ASCII one, or any letter that Python knows where there are only bytes beyond ASCII."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    sure, maybe = b.sums(ascii_letter[b.buf]) > 0, b.sums(b.buf >= 128) > 0
    for i in np.flatnonzero(~sure & maybe):
        sure[i] = any(c.isalpha() for c in b.text(i).decode("utf-8", "replace"))
    return sure


def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DRAWS windows from hashed places of each whole text, joined: (doc_id, lang, windows)."""
    for x in batches:
        out = []
        for text in x.column("text").to_pylist():
            t = text.encode()
            last = max(1, len(t) - TRAIN_WINDOW + 1)
            at = np.random.default_rng(zlib.crc32(t)).integers(0, last, DRAWS)
            out.append(b"".join(t[i : i + TRAIN_WINDOW].ljust(TRAIN_WINDOW) for i in at))
        yield frames.batch("doc_id long, lang string, windows binary", x.column("doc_id"), x.column("lang"), out)


def trained(docs: DataFrame) -> Network | None:
    """The network, from windows of at most MAX_DOCS labelled documents a language of the training folds, the first in a hashed order.

    Every language that has a label there is learnt. An id and language count once, however often their row is repeated.
    """
    own = docs.where("text is not null and lang is not null and doc_id is not null").where(frames.fold("doc_id", PARTS) != HELD).where(F.col("text").rlike("\\p{L}"))
    ids, order = own.select("doc_id", "lang").distinct().withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))), (frames.hashed_order("doc_id", 6), "doc_id")
    # First within slices, so that a language of most documents is no single task.
    for part in (["lang", "slice"], ["lang"]):
        ids = ids.withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("k") <= MAX_DOCS).drop("k")
    ids = ids.drop("slice")
    few = own.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(drawn, "doc_id long, lang string, windows binary")
    rows = sorted(few.groupBy("doc_id", "lang").agg(F.min("windows")).collect())
    if not rows:
        return None
    langs = sorted({r[1] for r in rows})
    windows = [bytes(r[2][i : i + TRAIN_WINDOW]) for r in rows for i in range(0, DRAWS * TRAIN_WINDOW, TRAIN_WINDOW)]
    return Network(langs).fit(windows, np.repeat([langs.index(r[1]) for r in rows], DRAWS))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each input row: fold mark, predicted language, and its pooled probability.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text where no labelled document trains a network. A null id is in no
    held-out fold. Repeated rows give repeated rows. Learning draws
    windows from all of its bounded sample's texts; prediction reads whole texts.
    Other columns are ignored.
    """
    own = frames.only(docs, id_col, text_col)
    net = trained(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held = x.column("held_out")
            for b in blocks(x.column("text")):
                ok = has_letter(b)
                if net is None:
                    lang, score = [UNDETERMINED] * b.n, np.zeros(b.n)
                else:
                    p, _ = net.pooled(b)
                    best = p.argmax(1)
                    lang = [net.langs[k] if o else UNDETERMINED for k, o in zip(best, ok, strict=True)]
                    score = np.where(ok, np.clip(p[np.arange(b.n), best], 0, 1), 0.0)
                yield frames.batch(OUT, x.column("doc_id").slice(b.lo, b.n), held.slice(b.lo, b.n), lang, score)

    return own.withColumn("held_out", F.coalesce(frames.fold("doc_id", PARTS) == HELD, F.lit(False))).mapInArrow(predict, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(frames.table(spark, sf_dir, "documents"))
