"""Joint choice of titles under relations between candidates, exact for each document.

Maximises the scores of the chosen candidates plus the weights of relations whose
both ends are chosen, with at most one candidate a mention. Mentions are taken out
one by one (the one with the fewest neighbours first), which keeps the best value
for each choice of its neighbours: exact, and exponential only in the width of the
relation graph, not in its size. A mention without relations is a plain maximum.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "doc_id long, mention_id long, title string"
#: Documents that Python holds as objects at once.
DOCUMENTS = 64


def choose(scores: dict[int, list[float]], relations: list[tuple[int, int, int, int, float]]) -> dict[int, int | None]:
    """Index of the chosen candidate of each mention, None for no candidate.

    A relation is (mention, candidate, mention, candidate, weight); ties fall to no
    candidate, then to the first one.
    """
    # Tables by number, and by mention the numbers of those that hold it: each step touches its own neighbours only.
    factors = {k: ((m,), np.array([0.0, *s])) for k, (m, s) in enumerate(scores.items())}
    holds = {m: {k} for k, m in enumerate(scores)}
    own = {m: k for k, m in enumerate(scores)}

    def put(names: tuple[int, ...], table: np.ndarray) -> None:
        k = len(factors) + len(gone)
        factors[k] = (names, table)
        for m in names:
            holds[m].add(k)

    gone: set[int] = set()
    paired: dict[tuple[int, int], np.ndarray] = {}
    for m1, c1, m2, c2, w in relations:
        if m1 == m2:
            if c1 == c2:
                factors[own[m1]][1][c1 + 1] += w
            continue
        if (m1, m2) not in paired:
            paired[m1, m2] = np.zeros((len(scores[m1]) + 1, len(scores[m2]) + 1))
            put((m1, m2), paired[m1, m2])
        paired[m1, m2][c1 + 1, c2 + 1] += w
    near = lambda m: {x for k in holds[m] for x in factors[k][0]}
    width = {m: len(near(m)) for m in scores}
    queue = [(n, m) for m, n in width.items()]
    heapq.heapify(queue)
    trace = []
    while queue:
        n, m = heapq.heappop(queue)
        if width.get(m) != n:
            continue
        scope = [*sorted(near(m) - {m}), m]
        total = np.zeros([len(scores[x]) + 1 for x in scope])
        for k in sorted(holds[m]):
            names, table = factors.pop(k)
            gone.add(k)
            for x in names:
                holds[x].discard(k)
            axes = sorted(range(len(names)), key=lambda a: scope.index(names[a]))
            shape = [len(scores[x]) + 1 if x in names else 1 for x in scope]
            total = total + table.transpose(axes).reshape(shape)
        if len(scope) > 1:
            put(tuple(scope[:-1]), total.max(-1))
        trace.append((m, scope[:-1], total.argmax(-1)))
        del width[m]
        for x in scope[:-1]:
            if (now := len(near(x))) != width[x]:
                width[x] = now
                heapq.heappush(queue, (now, x))
    chosen: dict[int, int] = {}
    for m, scope, best in reversed(trace):
        chosen[m] = int(best[tuple(chosen[x] for x in scope)])
    return {m: c - 1 if c else None for m, c in chosen.items()}


def link_jointly(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """One row a mention: doc_id, mention_id, title (null if none is chosen).

    candidates: doc_id, mention_id, title, score; relations: doc_id, m1, t1, m2, t2,
    weight. Relations whose ends are no candidates are ignored, equal ones add up.
    Documents without relations stay out of Python.
    """
    cands = candidates.select("doc_id", "mention_id", "title", "score")
    related = relations.select("doc_id").distinct()
    best = F.max_by("title", F.struct("score", "title"))
    plain = cands.join(related, "doc_id", "left_anti").groupBy("doc_id", "mention_id").agg(F.when(F.max("score") > 0, best).alias("title"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, DOCUMENTS) for k in range(0, len(batch), DOCUMENTS)):
                out = []
                for doc in part.to_pylist():
                    titles, scores, at = defaultdict(list), defaultdict(list), {}
                    ordered = sorted(sorted(doc["c"], key=lambda x: x["title"], reverse=True), key=lambda x: (x["mention_id"], -x["score"]))
                    for x in ordered:
                        m = x["mention_id"]
                        if (m, x["title"]) not in at:
                            at[m, x["title"]] = len(titles[m])
                            titles[m].append(x["title"])
                            scores[m].append(x["score"])
                    known = [(x["m1"], at[x["m1"], x["t1"]], x["m2"], at[x["m2"], x["t2"]], x["weight"]) for x in doc["r"] if (x["m1"], x["t1"]) in at and (x["m2"], x["t2"]) in at]
                    out += [(doc["doc_id"], m, None if i is None else titles[m][i]) for m, i in choose(scores, known).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "mention_id", "title"])

    # A row a document: Python gets many of them at once, not a group each.
    own = cands.groupBy("doc_id").agg(F.collect_list(F.struct("mention_id", "title", "score")).alias("c"))
    joint = own.join(relations.groupBy("doc_id").agg(F.collect_list(F.struct("m1", "t1", "m2", "t2", "weight")).alias("r")), "doc_id").mapInArrow(each, RESULT)
    return plain.select("doc_id", "mention_id", "title").unionByName(joint)
