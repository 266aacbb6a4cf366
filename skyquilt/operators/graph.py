"""Connected components by contraction.

Every task unites the links it holds and gives a star for each part it sees: one
row per node with the least node of the part. Nodes that lie in several stars link
the stars' centres; these links are a smaller graph, which is contracted the same
way. A node with any number of links is one row for each task, never a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions import kernels

#: Links that a task unites at once.
STEP = 1_000_000


def _star(held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
    both = pa.chunked_array([a for a, _ in held] + [b for _, b in held]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    nodes = both.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b = place[both.indices.to_numpy()].reshape(2, -1)
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(kernels.merge_labels(len(nodes), a, b)))], ["node", "root"])


def _stars(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array]] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and size + part.num_rows > step:
                    yield _star(held)
                    held, size = [], 0
                held.append((part.column(0), part.column(1)))
                size += part.num_rows
        if held:
            yield _star(held)

    return run


def components(links: DataFrame, step: int = STEP) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)`` (longs or strings, not null): ``root`` is the least node of its component.

    No rows: no rows. A link of a node to itself names the node. Each level is a
    written table. A level's nodes are the centres of the one before, and links that
    fit in one task end it, so levels grow with the logarithm of the links.
    """
    kind = dict(links.dtypes)["a"]
    stars = session.cut(links.select("a", "b").mapInArrow(_stars(step), f"node {kind}, root {kind}"), "stars")
    spread = stars.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    met = stars.join(spread.filter("least <> most").select("node", "least"), "node").filter("root <> least")
    met = session.cut(met.select(F.col("root").alias("a"), F.col("least").alias("b")).distinct(), "met")
    left = met.count()
    if left == 0:
        return stars.distinct()
    up = components(met.repartition(-(-left // step)), step).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stars.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).distinct()
