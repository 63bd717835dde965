"""Resolution of overlapping mentions, document by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claim(spans: pd.DataFrame) -> pd.Series:
    """Whether each span keeps its link: the longest claims its tokens first, then the earliest; ties fall to the lower mention_id.

    A span without a link claims its tokens too.
    """
    order = spans.assign(n=spans.start - spans.end).sort_values(["n", "start", "mention_id"], kind="stable")
    taken, kept = set(), {}
    for i, start, end in zip(order.index, order.start, order.end, strict=True):
        own = range(start, end)
        kept[i] = not any(t in taken for t in own)
        if kept[i]:
            taken.update(own)
    return pd.Series(kept, dtype=bool).reindex(spans.index)


def resolve_overlaps(mentions: DataFrame) -> DataFrame:
    """(doc_id, mention_id, start, end, title) with the title null where a longer mention holds a token of it.

    A row is one document's mentions, bounded by its text; Python gets many rows at once.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            flat = lists.flatten()
            starts, ends, kept, taken = flat.field("start").to_pylist(), flat.field("end").to_pylist(), [], set()
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            for i, new in enumerate(np.diff(row, prepend=-1) != 0):
                if new:
                    taken = set()
                own = range(starts[i], ends[i])
                kept.append(not any(t in taken for t in own))
                if kept[-1]:
                    taken.update(own)
            title = pc.if_else(pa.array(kept, pa.bool_()), flat.field("title"), pa.scalar(None, flat.field("title").type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), flat.field("mention_id"), flat.field("start"), flat.field("end"), title], names=["doc_id", "mention_id", "start", "end", "title"])

    own = mentions.select("doc_id", "mention_id", "start", "end", "title")
    spans = F.sort_array(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("n"), "start", "mention_id", "end", "title"))).alias("spans")
    return own.groupBy("doc_id").agg(spans).mapInArrow(each, own.schema)
