"""Connected components of images, label repair and hole filling.

Images are cut into square tiles. A tile's components are found inside one task by joining the horizontal runs of its rows; many
small tiles are worked on at once. Only pixels on both sides of a tile border make edges, between components of tiles,
and only components with such an edge take part in the rounds. These follow the published FastSV scheme (Zhang, Azad, Hu
2020: hooking to grandparents and shortcutting) and are written to the shared checkpoint folder one by one. Their number
grows with the logarithm of the tiles that a component winds through, not with its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import anti, merge, semi
from cytoframe.operators.objects import bounding_boxes
from cytoframe.operators.pixels import rectangle
from cytoframe.operators.ranks import _changes
from cytoframe.session import materialise

_SHIFT = 32
TILE = 256


def _node(y, x):
    return F.shiftleft(y.cast("long"), _SHIFT) + x.cast("long")


def first_of_component(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n things the first one that it is joined with, given pairs (a, b): hooking of roots and full shortcutting."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def tile_components(group: np.ndarray, y: np.ndarray, x: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """Node of the first pixel, in row order, of every pixel's component inside its group.

    Pixels are sorted by (group, y, x); ``reach`` is 1 if pixels also join across corners, else 0.
    """
    if not len(x):
        return np.empty(0, dtype=np.int64)
    line = np.concatenate([[0], np.cumsum((np.diff(group) != 0) | (np.diff(y) != 0))])
    step = np.diff(x)
    new = np.concatenate([[True], (np.diff(line) != 0) | (step > 1) | (np.diff(value) != 0)])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    # the next line is the row below only if it is of the same group and one further down
    lines = np.flatnonzero(np.concatenate([[True], np.diff(line) != 0]))
    follows = np.append((group[lines[1:]] == group[lines[:-1]]) & (y[lines[1:]] == y[lines[:-1]] + 1), False)
    left = x.min()
    wide = int(x.max() - left) + 4
    start = line[first] * wide + (x[first] - left) + 1
    end = line[last] * wide + (x[last] - left) + 1
    above = np.flatnonzero(follows[line[first]])
    low = np.searchsorted(end, start[above] + wide - reach)
    high = np.searchsorted(start, end[above] + wide + reach, side="right")
    count = np.maximum(high - low, 0)
    a = np.repeat(above, count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    same = value[first[a]] == value[first[b]]
    root = first_of_component(a[same], b[same], len(first))
    place = first[root][run]
    return (y[place] << _SHIFT) + x[place]


def _in_tiles(fg: DataFrame, keys: list[str], value: str, connectivity: int, tile: int) -> DataFrame:
    """Pixels (keys, y, x, value) with ``__node__`` of their component inside their tile; a tile is read by one task."""
    by = [quoted(k) for k in keys]
    cut = [F.floor(F.col(c) / F.lit(tile)).cast("long").alias(f"__t{c}__") for c in "yx"]
    rows = fg.select(*by, *cut, F.col("y").cast("long").alias("__y__"), F.col("x").cast("long").alias("__x__"), "y", "x", quoted(value))
    parts = [*keys, "__ty__", "__tx__"]
    columns = [quoted(c) for c in parts]
    dealt = rows.repartition(*columns).sortWithinPartitions(*columns, "__y__", "__x__")
    kept = [*keys, "y", "x", value]
    reach = 0 if connectivity == 4 else 1

    def label(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(_changes(table, parts))
        at = [table.column(c).to_numpy() for c in ("__y__", "__x__")]
        code = table.column(value).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        node = tile_components(group, *at, code, reach)
        yield from table.select(kept).append_column("__node__", pa.array(node)).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the tile that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            whole = int(np.flatnonzero(_changes(table, parts))[-1])
            if whole:
                yield from label(table.slice(0, whole).combine_chunks())
            held = table.slice(whole).to_batches()
        if held:
            yield from label(pa.Table.from_batches(held).combine_chunks())

    types = dict(rows.dtypes)
    return dealt.mapInArrow(work, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", __node__ long")


def _border_pairs(tiles: DataFrame, keys: list[str], value: str, connectivity: int, tile: int) -> DataFrame:
    """Pairs of tile components that touch across a border: pixels of the last rows and columns with those beyond."""
    by = [quoted(k) for k in keys]
    steps = {"y": [(1, 0)], "x": [(0, 1)]}
    if connectivity != 4:
        steps = {"y": [(1, -1), (1, 0), (1, 1)], "x": [(-1, 1), (0, 1), (1, 1)]}
    beyond = tiles.where((F.col("y") % tile == 0) | (F.col("x") % tile == 0) | (F.col("y") % tile == tile - 1) | (F.col("x") % tile == tile - 1))
    beyond = beyond.select(*by, "y", "x", quoted(value), F.col("__node__").alias("b"))
    asked = None
    for side, moves in steps.items():
        edge = tiles.where(F.col(side) % tile == tile - 1).withColumn(
            "__move__", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in moves]))
        )
        moved = edge.select(*by, (F.col("y") + F.col("__move__.dy")).alias("y"), (F.col("x") + F.col("__move__.dx")).alias("x"), quoted(value), F.col("__node__").alias("a"))
        asked = moved if asked is None else asked.unionByName(moved)
    return asked.join(beyond, [*keys, "y", "x", value]).where("a <> b").select(*by, "a", "b").distinct()


def connected_components(
    pixels: DataFrame,
    keys: Sequence[str] = ("fov",),
    value: str = "label",
    out: str = "component",
    connectivity: int = 4,
    tile: int = TILE,
) -> DataFrame:
    """Add ``out`` to the non-background pixels: equal for pixels joined by neighbours of
    the same value. The number is that of the component's first pixel in row order, so it
    is unique and ordered within an image. Background (0 or null) pixels are left out.
    """
    keys = list(keys)
    by = [quoted(k) for k in keys]
    fg = pixels.where(F.coalesce(quoted(value), F.lit(0)) != 0)
    tiles = materialise(_in_tiles(fg, keys, value, connectivity, tile))
    pairs = _border_pairs(tiles, keys, value, connectivity, tile)
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    edges = materialise(pairs.select(*by, both).select(*by, "e.u", "e.v"))
    if edges.isEmpty():
        joined = tiles.withColumn("__root__", F.col("__node__"))
    else:
        roots = _label_rounds(edges.select(*by, F.col("u").alias("__node__")).distinct(), edges, keys)
        joined = merge(tiles, roots, [*keys, "__node__"], "left", False).withColumn("__root__", F.coalesce("__root__", "__node__"))
    rest = [c for c in pixels.columns if c not in (*keys, "y", "x", value)]
    found = joined.select(*by, "y", "x", F.col("__root__").alias(out))
    if not rest:
        return joined.select(*by, "y", "x", quoted(value), F.col("__root__").alias(out))
    return merge(fg, found, [*keys, "y", "x"], "inner", False)


def _label_rounds(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    by = [quoted(k) for k in keys]
    state = materialise(
        nodes.select(*by, "__node__", F.col("__node__").alias("f"), F.col("__node__").alias("g"))
    )
    total = None
    while True:
        near = (
            edges.join(state.select(*by, F.col("__node__").alias("v"), "g"), [*keys, "v"])
            .groupBy(*by, "u")
            .agg(F.min("g").alias("m"))
            .withColumnRenamed("u", "__node__")
        )
        seen = state.join(near, [*keys, "__node__"], "left")
        offers = F.explode(
            F.array(
                F.struct(F.col("__node__").alias("n"), F.least("f", "g", "m").alias("l")),
                F.struct(F.col("f").alias("n"), F.least("g", "m").alias("l")),
            )
        ).alias("o")
        parents = (
            seen.select(*by, offers)
            .groupBy(*by, F.col("o.n").alias("__node__"))
            .agg(F.min("o.l").alias("f"))
        )
        grand = parents.select(*by, F.col("__node__").alias("f"), F.col("f").alias("g"))
        state = materialise(parents.join(grand, [*keys, "f"]).select(*by, "__node__", "f", "g"))
        now = state.agg(F.sum(F.col("g").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return state.select(*by, "__node__", F.col("g").alias("__root__"))
        total = now


def component_areas(components: DataFrame, keys: Sequence[str], component: str) -> DataFrame:
    return components.groupBy(*[quoted(k) for k in keys], quoted(component)).agg(
        F.count("*").alias("area")
    )


def drop_small(
    components: DataFrame, keys: Sequence[str], component: str, min_area: int
) -> DataFrame:
    """Pixels of components with more than ``min_area`` pixels."""
    large = component_areas(components, keys, component).where(F.col("area") > min_area)
    return semi(components, large, [*keys, component])


def number_components(
    components: DataFrame, keys: Sequence[str], component: str, out: str
) -> DataFrame:
    """Give the components of an image the numbers 1..k in row order."""
    order = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(quoted(component))
    names = (
        components.select(*[quoted(k) for k in keys], quoted(component))
        .distinct()
        .withColumn(out, F.row_number().over(order))
    )
    return merge(components, names, [*keys, component], "inner", False)


def small_objects_removed(
    pixels: DataFrame, mask: str, min_area: int, fov: str = "fov", out: str = "kept",
    connectivity: int = 8,
) -> DataFrame:
    """Binary image (0 / 255) without components smaller than ``min_area``."""
    fg = connected_components(
        pixels.select(quoted(fov), "y", "x", (quoted(mask) > 0).cast("int").alias("__m__")),
        [fov], "__m__", "__c__", connectivity,
    )
    kept = drop_small(fg, [fov], "__c__", min_area - 1).select(
        quoted(fov), "y", "x", F.lit(255).alias(out)
    )
    return merge(pixels, kept, [fov, "y", "x"], "left", False).fillna(0, [out])


def fill_holes(objects: DataFrame, fov: str = "fov", label: str = "label") -> DataFrame:
    """Object pixels with their enclosed holes. Where two claim a pixel, the higher label wins.

    A hole is a 4-connected part of the rest of the object's box that does not reach the
    box edge; only boxes are looked at, never whole images.
    """
    own = objects.where(quoted(label) > 0).select(quoted(fov), quoted(label), "y", "x")
    boxes = materialise(bounding_boxes(own, fov, label))
    frame = rectangle(boxes, 0, [fov, label])
    gaps = anti(frame, own, [fov, label, "y", "x"]).withColumn("__gap__", F.lit(1))
    parts = connected_components(gaps, [fov, label], "__gap__", "__c__", 4)
    sized = merge(parts, boxes, [fov, label], "inner", False)
    edge = (
        (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))
        | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    )
    open_parts = sized.where(edge).select(quoted(fov), quoted(label), "__c__").distinct()
    holes = anti(parts, open_parts, [fov, label, "__c__"]).select(quoted(fov), quoted(label), "y", "x")
    return (
        own.unionByName(holes)
        .groupBy(quoted(fov), "y", "x")
        .agg(F.max(quoted(label)).alias(label))
    )


def repair_labels(
    pixels: DataFrame, min_area: int = 5000, fov: str = "fov", label: str = "label",
    out: str = "fixed",
) -> DataFrame:
    """Split labels in several pieces, drop pieces up to ``min_area``, renumber, fill holes.

    Returns every pixel with ``out`` (0 = background).
    """
    parts = connected_components(pixels.select(quoted(fov), "y", "x", quoted(label)), [fov], label, "__c__")
    large = drop_small(parts, [fov], "__c__", min_area)
    numbered = number_components(large, [fov], "__c__", out).select(quoted(fov), "y", "x", quoted(out))
    filled = fill_holes(numbered, fov, out)
    return merge(pixels, filled, [fov, "y", "x"], "left", False).fillna(0, [out])


def wrongly_labelled(
    pixels: DataFrame, min_area: int = 5000, fov: str = "fov", label: str = "label"
) -> DataFrame:
    """Images whose number of large objects differs from that of large components."""
    objects = pixels.where(quoted(label) > 0).groupBy(quoted(fov), quoted(label)).agg(
        F.count("*").alias("area")
    )
    objects = objects.where(F.col("area") > min_area).groupBy(quoted(fov)).agg(
        F.count("*").alias("labelled")
    )
    parts = connected_components(pixels.select(quoted(fov), "y", "x", quoted(label)), [fov], label, "__c__")
    found = component_areas(parts, [fov], "__c__").where(F.col("area") > min_area)
    found = found.groupBy(quoted(fov)).agg(F.count("*").alias("found"))
    both = merge(objects, found, [fov], "outer", False).fillna(0, ["labelled", "found"])
    return both.where(F.col("labelled") != F.col("found"))


def background_regions(
    pixels: DataFrame, quiet: str, distance: float, fov: str = "fov", out: str = "background"
) -> DataFrame:
    """Mark quiet components that contain a pixel deeper than ``distance``.

    ``quiet`` is a 0/1 column; depth is the distance to the nearest non-quiet pixel.
    """
    from cytoframe.operators.distance import distance_transform

    flat = pixels.select(quoted(fov), "y", "x", quoted(quiet).cast("int").alias("__q__"))
    fine = connected_components(flat, [fov], "__q__", "__c__", 8)
    depth = distance_transform(flat, [fov], F.col("__q__") == 0, "__depth__")
    deep = merge(fine, depth.select(quoted(fov), "y", "x", "__depth__"), [fov, "y", "x"], "inner", False)
    deep = deep.where(F.col("__depth__") > distance).select(quoted(fov), "__c__").distinct()
    marked = semi(fine, deep, [fov, "__c__"]).select(quoted(fov), "y", "x", F.lit(1).alias(out))
    return merge(pixels, marked, [fov, "y", "x"], "left", False).fillna(0, [out])
