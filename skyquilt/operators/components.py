"""Connected components of tiled masks, any frame size.

Each tile labels its own pixels. Groups of ``fan`` x ``fan`` tiles unite what
touches across their inner seams and pass on only the pixels on the group's outer
border; groups of groups do the same until a frame is one group. So a task holds
the borders of a few blocks, never a frame, and a component's id is the smallest
``r * width + c`` of its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.functions import kernels
from skyquilt.functions.batches import map_slices

#: Tiles (then groups) along each side of a group.
FAN = 4
_OFFSETS = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def _tile_labels(t, connectivity: int):
    mask = np.frombuffer(t.px, np.uint8).reshape(t.h, t.w) != 0
    lab = kernels.label(mask, connectivity)
    r, c = np.nonzero(mask)
    ids = lab[r, c] - 1
    index = (r + t.r0).astype(np.int64) * t.width + c + t.c0
    first = np.full(lab.max(initial=0), np.iinfo(np.int64).max)
    np.minimum.at(first, ids, index)
    return r, c, ids, first


def local_components(masks: DataFrame, connectivity: int, keys: Sequence[str] = ("aoi", "frame")) -> DataFrame:
    """One row per component of each tile: its sums, box, border pixels (as ``r * width + c``), and the tile's box."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for t in pdf.itertuples(index=False):
                r, c, ids, first = _tile_labels(t, connectivity)
                n = len(first)
                if not n:
                    continue
                edge = np.flatnonzero((r == 0) | (c == 0) | (r == t.h - 1) | (c == t.w - 1))
                edge = edge[np.argsort(ids[edge], kind="stable")]
                cuts = np.searchsorted(ids[edge], np.arange(n + 1))
                r, c = r + t.r0, c + t.c0
                low, high = np.full((2, n), np.iinfo(np.int32).max), np.full((2, n), -1)
                for axis, v in enumerate((r, c)):
                    np.minimum.at(low[axis], ids, v)
                    np.maximum.at(high[axis], ids, v)
                at = r[edge].astype(np.int64) * t.width + c[edge]
                parts.append(pd.DataFrame({
                    **{k: [getattr(t, k)] * n for k in keys}, "ty": t.ty, "tx": t.tx, "lab": first,
                    "area": np.bincount(ids, minlength=n),
                    "sr": np.bincount(ids, r, n).astype(np.int64), "sc": np.bincount(ids, c, n).astype(np.int64),
                    "r0": low[0], "c0": low[1], "r1": high[0] + 1, "c1": high[1] + 1,
                    "border": [at[cuts[i]:cuts[i + 1]] for i in range(n)],
                    "top": t.r0, "left": t.c0, "bottom": t.r0 + t.h, "right": t.c0 + t.w, "width": t.width,
                }))
            if parts:
                yield pd.concat(parts)

    return map_slices(masks.select(*keys, "ty", "tx", "r0", "c0", "h", "w", "width", "px"),
        run, f"{_fields(masks, keys)}, ty int, tx int, lab long, area long, sr long, sc long, "
        "r0 int, c0 int, r1 int, c1 int, border array<long>, top int, left int, bottom int, right int, width int"
    )


def unite(at: np.ndarray, lab: np.ndarray, width: int, connectivity: int) -> np.ndarray:
    """Least label that each pixel's label is joined with through neighbouring pixels of the set."""
    order = np.argsort(at)
    at, names = at[order], lab[order]
    c = at % width
    nodes, node = np.unique(names, return_inverse=True)
    a, b = [], []
    for dr, dc in _OFFSETS[connectivity]:
        inside = np.flatnonzero((c + dc >= 0) & (c + dc < width))
        there = at[inside] + dr * width + dc
        k = np.minimum(np.searchsorted(at, there), len(at) - 1)
        met = at[k] == there
        a.append(node[inside[met]])
        b.append(node[k[met]])
    out = np.empty_like(lab)
    out[order] = nodes[kernels.merge_labels(len(nodes), np.concatenate(a), np.concatenate(b))][node]
    return out


_BLOCK = "by int, bx int, r0 int, c0 int, r1 int, c1 int, width int, at array<long>, lab array<long>, old array<long>, new array<long>"


def _group(keys: list[str], fan: int, connectivity: int):
    """Unite the blocks of one group: what changed its label, and the outer border's pixels for the next level."""
    def run(group: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.asarray(x, np.int64) for x in group.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("at", "lab")]
        at, lab = parts
        width = group.column("width")[0].as_py()
        box = [min(group.column(c).to_pylist()) for c in ("r0", "c0")] + [max(group.column(c).to_pylist()) for c in ("r1", "c1")]
        root = unite(at, lab, width, connectivity) if len(at) else lab
        old, first = np.unique(lab, return_index=True)
        moved = root[first] != old
        r, c = at // max(1, width), at % max(1, width)
        outer = (r == box[0]) | (c == box[1]) | (r == box[2] - 1) | (c == box[3] - 1)
        row = {k: [group.column(k)[0].as_py()] for k in keys}
        row |= {"by": [group.column("by")[0].as_py() // fan], "bx": [group.column("bx")[0].as_py() // fan]}
        row |= {n: [v] for n, v in zip(("r0", "c0", "r1", "c1"), box)} | {"width": [width]}
        row |= {"at": [at[outer]], "lab": [root[outer]], "old": [old[moved]], "new": [root[first][moved]]}
        fields = {k: group.schema.field(k).type for k in keys} | {n: pa.int32() for n in ("by", "bx", "r0", "c0", "r1", "c1", "width")} | {
            n: pa.list_(pa.int64()) for n in ("at", "lab", "old", "new")}
        return pa.table({n: pa.array(v, fields[n]) for n, v in row.items()}, schema=pa.schema(list(fields.items())))

    return run


def merged_roots(local: DataFrame, connectivity: int, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """(keys, lab) -> root for local components that another tile's component turned into a part of its own.

    ``local`` holds the components of ``local_components``. There is one level for
    each power of ``fan`` tiles.
    """
    keys = list(keys)
    place = [*keys, "ty", "tx", "top", "left", "bottom", "right", "width"]
    px = local.select(*place, "lab", F.explode("border").alias("at")).groupBy(*place).agg(F.collect_list(F.struct("at", "lab")).alias("px"))
    blocks = px.select(
        *keys, F.col("ty").cast("int").alias("by"), F.col("tx").cast("int").alias("bx"), F.col("top").alias("r0"), F.col("left").alias("c0"),
        F.col("bottom").alias("r1"), F.col("right").alias("c1"), "width", F.col("px.at").alias("at"), F.col("px.lab").alias("lab"))
    side = local.agg(F.max(F.greatest("ty", "tx"))).first()[0]
    roots = None
    while side:
        side //= fan
        blocks = session.cut(blocks.groupBy(*keys, F.floor(F.col("by") / fan), F.floor(F.col("bx") / fan)).applyInArrow(
            _group(keys, fan, connectivity), f"{_fields(local, keys)}, {_BLOCK}"), "blocks")
        moved = blocks.select(*keys, F.explode(F.arrays_zip("old", "new")).alias("m")).select(*keys, F.col("m.old").alias("lab"), F.col("m.new").alias("root"))
        if roots is not None:  # a root of an earlier level may have become a part now
            again = moved.select(*keys, F.col("lab").alias("root"), F.col("root").alias("top"))
            roots = roots.join(again, [*keys, "root"], "left").select(*keys, "lab", F.coalesce("top", "root").alias("root")).unionByName(moved)
        else:
            roots = moved
        blocks = blocks.drop("old", "new")
    return roots if roots is not None else local.select(*keys, "lab", F.col("lab").alias("root")).limit(0)


def _with_root(df: DataFrame, roots: DataFrame, keys) -> DataFrame:
    d = df.join(roots, [*keys, "lab"], "left")
    return d.withColumn("root", F.coalesce("root", "lab"))


def regions(
    masks: DataFrame, connectivity: int = 4, keys: Sequence[str] = ("aoi", "frame"), fan: int = FAN
) -> DataFrame:
    """Region properties: half-open box, area and centroid per component."""
    keys = list(keys)
    local = session.cut(local_components(masks, connectivity, keys), "local")
    d = _with_root(local.drop("border"), merged_roots(local, connectivity, keys, fan), keys)
    return d.groupBy(*keys, F.col("root").alias("region_id")).agg(
        F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"), F.max("c1").alias("c1"),
        F.sum("area").alias("area"),
        (F.sum("sr") / F.sum("area")).alias("centroid_r"), (F.sum("sc") / F.sum("area")).alias("centroid_c"),
    )


def pixel_labels(
    masks: DataFrame, connectivity: int = 4, keys: Sequence[str] = ("aoi", "frame"), fan: int = FAN
) -> DataFrame:
    """Set pixels with the id of their component: keys, r, c, label."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for t in pdf.itertuples(index=False):
                r, c, ids, first = _tile_labels(t, connectivity)
                out = pd.DataFrame({"r": (r + t.r0).astype(np.int32), "c": (c + t.c0).astype(np.int32), "lab": first[ids]})
                for k in keys:
                    out[k] = getattr(t, k)
                parts.append(out)
            if parts:
                yield pd.concat(parts)

    local = session.cut(local_components(masks, connectivity, keys), "local")
    px = map_slices(masks.select(*keys, "r0", "c0", "h", "w", "width", "px"),
        run, f"r int, c int, lab long, {_fields(masks, keys)}"
    )
    d = _with_root(px, merged_roots(local, connectivity, keys, fan), keys)
    return d.select(*keys, "r", "c", F.col("root").alias("label"))


def large_component_masks(
    masks: DataFrame, connectivity: int, min_area: int, keys: Sequence[str], fan: int = FAN
) -> DataFrame:
    """The same tiles with only the pixels of components larger than ``min_area``."""
    keys = list(keys)
    local = session.cut(local_components(masks, connectivity, keys), "local")
    d = _with_root(local.select(*keys, "ty", "tx", "lab", "area"), merged_roots(local, connectivity, keys, fan), keys)
    big = d.groupBy(*keys, "root").agg(F.sum("area").alias("total")).where(F.col("total") > min_area)
    keep = d.join(big, [*keys, "root"]).groupBy(*keys, "ty", "tx").agg(F.collect_set("lab").alias("keep"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            px = []
            for t in pdf.itertuples(index=False):
                r, c, ids, first = _tile_labels(t, connectivity)
                out = np.zeros((t.h, t.w), np.uint8)
                on = np.isin(first[ids], np.asarray(t.keep))
                out[r[on], c[on]] = 1
                px.append(out.tobytes())
            yield pdf.assign(px=px).drop(columns="keep")

    fed = masks.join(keep, [*keys, "ty", "tx"])
    return map_slices(fed, run, masks.select(*fed.columns[:-1]).schema)
