"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learnt from labelled documents of the training folds: words far
likelier in toxic ones. Its trie and the automata of edit distance 1 (a swap of
neighbours counts as one edit) are intersected state by state into one
deterministic automaton, which all words of a block run through in lockstep. A
window of words around each hit tells quotation from abuse: a hit between an
opening and a closing mark of one kind, both within its window, is discounted. A logistic model over the hits' weights scores the
document.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, learn
from .textvec import SPACE, Block, blocks, per_row

#: Bound on labelled documents that the lexicon and the model are fitted to.
MAX_LABELLED = 20_000
#: A term is in so many toxic documents at least, so much likelier there, and has two letters or more; one of fewer than
#: five letters matches exactly alone.
MIN_TOXIC, MIN_LOG_ODDS, MIN_LENGTH = 3, 2.0, 2
#: Least log-likelihood ratio of a term: one word in a hundred without bearing reaches it.
MIN_RATIO = 6.63
PARTS, HELD = 3, 1
THRESHOLD = 0.7
WINDOW = 6
#: Weight left to a hit between quotation marks.
QUOTED = 0.25
#: Bytes of an automaton's full table; a larger one (scripts of many letters) is searched by its moves instead.
MAX_TABLE = 32 << 20
OUT = "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_fuzzy long, n_quoted long"
#: Quotation marks by kind: those that open and those that close.
QUOTES = (('"', '"'), ("“„", "“”"), ("«»", "«»"), ("‘‚", "‘’"), ("「", "」"), ("『", "』"))

#: No code point from here on is a letter or has a lower-case form.
TOP = 0x32400
_LOW = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(TOP)], np.int32)
#: str.lower() gives the sigma at a word's end a form of its own; both are one letter here and in the lexicon.
FINAL_SIGMA, SIGMA = "ςσ"
_LOW[ord(FINAL_SIGMA)] = ord(SIGMA)
#: Marks belong to the letters before them.
_LETTER = np.array([chr(c).isalnum() or (c >= 0x250 and unicodedata.category(chr(c))[0] == "M") for c in range(TOP)])
#: White space of every script, and punctuation of those that write without it.
_SPACE = np.array([SPACE[c] if c < 256 else unicodedata.category(chr(c))[0] in ("ZP" if c >= 0x3000 else "Z") for c in range(TOP)])


class Automaton:
    """Union of the terms' edit-distance automata, made deterministic over the trie of the terms."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        for i, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in children[node]:
                    children.append({})
                    children[node][c] = len(children) - 1
                node = children[node][c]
            ends[node] = i
        letters = sorted({c for t in terms for c in t})
        self.letters = np.array([ord(c) for c in letters], np.int32)
        fuzzy_ok = {n for n, i in ends.items() if len(terms[i]) >= 5}

        # A state of the trie and automaton together: (node, edits, letter still to come of a swap).
        def close(states: set) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                node, edits, due = todo.pop()
                if edits == 0 and not due:
                    for child in children[node].values():  # a letter of the term left out
                        if (s := (child, 1, "")) not in seen:
                            seen.add(s)
                            todo.append(s)
            return frozenset(s for s in seen if s[1] == 0 or (s[0], 0, "") not in seen)

        def step(states: frozenset) -> tuple[set, dict[str, set]]:
            """What any letter leads to, and what each named letter adds to it."""
            common, own = set(), defaultdict(set)
            for node, edits, due in states:
                if due:
                    own[due].add((node, 1, ""))
                    continue
                if edits == 0:
                    common.add((node, 1, ""))  # one letter too many
                for first, child in children[node].items():
                    own[first].add((child, edits, ""))
                    if edits == 0:
                        common.add((child, 1, ""))  # another letter; without an edit it is the better state of the two
                        for second, grandchild in children[child].items():
                            if second != first:
                                own[second].add((grandchild, 1, first))  # swapped
            return common, own

        start = close({(0, 0, "")})
        ids, queue, foreign, moves, to = {frozenset(): 0, start: 1}, deque([start]), [0], array("q"), array("i")
        place = {c: k for k, c in enumerate(letters, 1)}
        self.hit, self.edits = [-1], [0]
        while queue:
            states = queue.popleft()
            own = [(e, ends[n]) for n, e, due in states if not due and n in ends and (e == 0 or n in fuzzy_ok)]
            best = min(own, default=None)
            self.hit.append(best[1] if best else -1)
            self.edits.append(best[0] if best else 0)
            common, named = step(states)
            for k in [0, *sorted(place[c] for c in named)]:
                after = close(common | named[letters[k - 1]] if k else common)
                if after not in ids:
                    ids[after] = len(ids)
                    queue.append(after)
                if not k:
                    foreign.append(ids[after])
                elif ids[after] != foreign[-1]:
                    moves.append((len(foreign) - 1) * (len(letters) + 1) + k)
                    to.append(ids[after])
        self.foreign, self.moves, self.to = np.array(foreign, np.int32), np.array(moves, np.int64), np.array(to, np.int32)
        self.table = None
        if len(foreign) * (len(letters) + 1) * 4 <= MAX_TABLE:
            self.table = np.repeat(self.foreign, len(letters) + 1)
            self.table[self.moves] = self.to
        self.hit, self.edits = np.array(self.hit, np.int32), np.array(self.edits, np.int32)

    def classes(self, cp: np.ndarray) -> np.ndarray:
        """Class of each code point: its place among the terms' letters, from 1 on, or 0 if no term has it."""
        if not len(self.letters):
            return np.zeros(len(cp), np.int64)
        at = np.minimum(np.searchsorted(self.letters, cp), len(self.letters) - 1)
        return np.where(self.letters[at] == cp, at + 1, 0)

    def after(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * (len(self.letters) + 1) + cls
        if self.table is not None:
            return self.table[key]
        if not len(self.moves):
            return self.foreign[state]
        at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
        return np.where(self.moves[at] == key, self.to[at], self.foreign[state])

    def run(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term (or -1) and edits of each span of code points."""
        n = len(start)
        term, edits = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        cls = self.classes(cp)
        lane, at, stop, state = np.arange(n), start.copy(), end, np.ones(n, np.int32)
        while len(lane):
            done = at >= stop
            if done.any():
                term[lane[done]], edits[lane[done]] = self.hit[state[done]], self.edits[state[done]]
                keep = ~done
                lane, at, stop, state = lane[keep], at[keep], stop[keep], state[keep]
            state = self.after(state, cls[at])
            at = at + 1
            live = state > 0
            if not live.all():
                lane, at, stop, state = lane[live], at[live], stop[live], state[live]
        return term, edits


def code_points(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of a block and their row bounds; those of three or four bytes keep their value, too."""
    buf = b.buf
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    pad = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int32)
    c = pad[at]
    two, three, four = (c >= 0xC0) & (c < 0xE0), (c >= 0xE0) & (c < 0xF0), c >= 0xF0
    x1, x2, x3 = pad[at + 1] & 0x3F, pad[at + 2] & 0x3F, pad[at + 3] & 0x3F
    c = np.where(two, (c & 0x1F) << 6 | x1, np.where(three, (c & 0x0F) << 12 | x1 << 6 | x2, np.where(four, (c & 7) << 18 | x1 << 12 | x2 << 6 | x3, c)))
    low = c < TOP
    c[low] = _LOW[c[low]]
    return c, np.searchsorted(at, b.off)


def words(b: Block):
    """Code points and the trimmed words of each row: start, end, row; a word is a run without white space, cut to its outer letters and digits."""
    cp, off = code_points(b)
    own = Block(cp, off, b.null)
    known = np.minimum(cp, TOP - 1)
    start, end, row = own.runs(~_SPACE[known])
    letter = _LETTER[known]
    at = np.arange(len(cp))
    ahead = np.minimum.accumulate(np.where(letter, at, len(cp))[::-1])[::-1]
    back = np.maximum.accumulate(np.where(letter, at, -1))
    if not len(start):
        return cp, start, end, row, start, end
    s, e = ahead[start], back[end - 1] + 1
    full = s < e
    return cp, s[full], e[full], row[full], start[full], end[full]


def quotations(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Opening and closing places of quotations: neighbouring marks of one kind in one row, the first of which may open and the second close.

    Equal marks take turns; one between two letters is an apostrophe.
    """
    known = _LETTER[np.minimum(cp, TOP - 1)]
    pad = np.concatenate(([False], known, [False]))
    inner = pad[:-2] & pad[2:]
    opens, closes = [], []
    for first, last in QUOTES:
        at = np.flatnonzero(np.isin(cp, [ord(c) for c in {*first, *last}]) & ~inner)
        if len(at) < 2:
            continue
        row = np.searchsorted(off, at, "right")
        if first == last and len(first) == 1:
            nth = np.arange(len(at)) - np.searchsorted(row, row)
            good = nth[:-1] % 2 == 0
        else:
            good = np.isin(cp[at[:-1]], [ord(c) for c in first]) & np.isin(cp[at[1:]], [ord(c) for c in last]) & ((cp[at[:-1]] != cp[at[1:]]) | (first == last))
            # A mark that closes one quotation opens no other.
            for i in np.flatnonzero(good[1:] & good[:-1]) + 1:
                good[i] = not good[i - 1]
        good &= row[:-1] == row[1:]
        opens.append(at[:-1][good])
        closes.append(at[1:][good])
    o, c = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (opens, closes))
    order = np.argsort(o, kind="stable")
    return o[order], c[order]


def hits(b: Block, automaton: Automaton):
    """Rows, terms, edits and quotation of all hits of a block; words of each row."""
    cp, s, e, row, s0, e0 = words(b)
    term, edits = automaton.run(cp, s, e)
    at = np.flatnonzero(term >= 0)
    first = np.searchsorted(row, np.arange(b.n + 1))
    lo, hi = np.maximum(at - WINDOW, first[row[at]]), np.minimum(at + WINDOW, first[row[at] + 1] - 1)
    quoted = np.zeros(len(at), bool)
    if len(at):
        opens, closes = quotations(cp, np.searchsorted(np.flatnonzero((b.buf & 0xC0) != 0x80), b.off)[1:])
        for i, (start, end, left, right) in enumerate(zip(s[at], e[at], s0[lo], e0[hi], strict=True)):
            near = slice(np.searchsorted(opens, left), np.searchsorted(opens, start))
            quoted[i] = bool(((closes[near] >= end) & (closes[near] < right)).any())
    return row[at], term[at], edits[at], quoted, np.diff(first)


def lexicon(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms and weights from labelled documents (column ``toxic``): words likelier in toxic ones beyond chance, by document counts.

    No count of terms is set: the bounded sample bounds it.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        n = [0, 0]
        for x in batches:
            for text, y in zip(x.column("text").to_pylist(), x.column("toxic").to_pylist(), strict=True):
                n[y] += 1
                for w in set(re.findall(r"[^\W\d_]+", (text or "").lower().replace(FINAL_SIGMA, SIGMA))):
                    if len(w) >= MIN_LENGTH:
                        found[w][y] += 1
        found[""] = n
        yield frames.batch("word string, clean long, toxic long", list(found), [v[0] for v in found.values()], [v[1] for v in found.values()])

    counts = docs.select("text", "toxic").mapInArrow(each, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("word = ''").first()
    clean, toxic = (total[1], total[2]) if total else (0, 0)
    if not clean or not toxic:
        return [], np.zeros(0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    often = counts.where(F.col("word") != "")
    seen, share = F.col("clean") + F.col("toxic"), toxic / (clean + toxic)
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), seen * share) + part(F.col("clean"), seen * (1 - share)))
    rows = often.where(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).where((F.col("odds") >= MIN_LOG_ODDS) & (ratio >= MIN_RATIO)).collect()
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[3] for r in rows])


def features(b: Block, automaton: Automaton, exact: np.ndarray, fuzzy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model inputs of each row, and hits: all, fuzzy, quoted."""
    row, term, edits, quoted, n = hits(b, automaton)
    w = np.where(edits == 0, exact[term], fuzzy[term]) * np.where(quoted, QUOTED, 1.0)
    total = per_row(row, b.n, w)
    most = np.zeros(b.n)
    np.maximum.at(most, row, w)
    pair = np.unique(np.stack([row, term]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    kinds = per_row(pair[0], b.n)
    x = np.stack([np.log1p(np.maximum(total, 0)), most, np.log1p(kinds), np.minimum(total / np.sqrt(n + 1), 8), (most > 0).astype(float)], 1)
    return x, np.stack([per_row(row, b.n), per_row(row[edits > 0], b.n), per_row(row[quoted], b.n)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights (bias last) of a ridge-penalised logistic model, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, eye = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = learn.sigmoid(z @ w)
        w = w - np.clip(np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + eye, z.T @ (p - y) + eye @ w), -3, 3)
    return w


class Model:
    def __init__(self, docs: DataFrame):
        """From a bounded frame of labelled documents with ``toxic`` 0 or 1."""
        terms, self.exact = lexicon(docs)
        self.automaton = automaton = Automaton(terms)
        self.fuzzy, self.weights = self.exact * 0.7, None
        if not terms:
            return

        def near(batches):  # fuzzy hits of each term by label, each once a document
            count: Counter = Counter()
            for x in batches:
                y = np.asarray(x.column("toxic"))
                for b in blocks(x.column("text")):
                    row, term, edits, _, _ = hits(b, automaton)
                    for r, t in set(zip(row[edits > 0].tolist(), term[edits > 0].tolist())):
                        count[t, int(y[b.lo + r])] += 1
            yield frames.batch("term int, y int, n long", [k[0] for k in count], [k[1] for k in count], list(count.values()))

        seen = np.zeros((len(terms), 2))
        for t, y, n in docs.select("text", "toxic").mapInArrow(near, "term int, y int, n long").groupBy("term", "y").agg(F.sum("n")).collect():
            seen[t, y] += n
        # Evidence of clean documents with a near form takes its weight down.
        self.fuzzy = np.clip(self.exact * 0.7 * (seen[:, 1] + 2) / (seen[:, 1] + 2 + 3 * seen[:, 0]), 0, None)
        exact, fuzzy = self.exact, self.fuzzy

        def each(batches):
            for x in batches:
                y = np.asarray(x.column("toxic"))
                for b in blocks(x.column("text")):
                    f, _ = features(b, automaton, exact, fuzzy)
                    yield frames.batch("y int, x binary", y[b.lo : b.lo + b.n], [r.tobytes() for r in f])

        rows = docs.select("text", "toxic").mapInArrow(each, "y int, x binary").collect()
        rows.sort()
        x, y = np.stack([np.frombuffer(r[1]) for r in rows]), np.array([r[0] for r in rows], float)
        if y.min() != y.max():
            self.weights = logistic(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return learn.sigmoid(x @ self.weights[:-1] + self.weights[-1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: fold mark, toxicity score, prediction, and hits (all, misspelt, quoted).

    Null and empty texts have no hits and get the score of a text without hits.
    A null id is in no held-out fold. Repeated rows give repeated rows;
    conflicting label rows of an id count as their largest. Without labels of
    both kinds there is no lexicon and every score is 0. Other columns are ignored.
    """
    own = frames.only(docs, id_col, text_col)
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(frames.fold("doc_id", PARTS) != HELD)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(frames.hashed_order("doc_id", 4), "doc_id").limit(MAX_LABELLED)
    train = frames.stored(learn.rows_of(own, lab), "toxic-train")
    model = Model(train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held = x.column("held_out")
            for b in blocks(x.column("text")):
                f, n = features(b, model.automaton, model.exact, model.fuzzy)
                s = model.score(f)
                yield frames.batch(OUT, x.column("doc_id").slice(b.lo, b.n), held.slice(b.lo, b.n), s, (s >= THRESHOLD).astype(np.int32), n[:, 0], n[:, 1], n[:, 2])

    return own.withColumn("held_out", F.coalesce(frames.fold("doc_id", PARTS) == HELD, F.lit(False))).mapInArrow(score, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))
