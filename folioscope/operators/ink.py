"""Unread ink: raster cells, connected regions, recovery and confirmations.

A raster is a row with ``page_id``, ``width``, ``height`` and ``data`` (RGBA bytes). Pages are
independent, so rasters never leave their row: a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.cluster import ship
from folioscope.functions import geometry as G
from folioscope.operators.associate import attribute_to_regions, repeated_readings
from folioscope.operators.pages import fold_pages


def _half_up(x: float, digits: int = 0) -> float:
    return floor(x * 10**digits + 0.5) / 10**digits


def cell_grid(width: int, height: int, data: bytes, scale: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Share of ink and of midtones in each cell (AGG12)."""
    side = max(2, int(_half_up(K.INK_CELL_PT * scale)))
    rgba = np.frombuffer(data, np.uint8).reshape(height, width, 4).astype(np.float64)
    lum = (0.299 * rgba[..., 0] + 0.587 * rgba[..., 1] + 0.114 * rgba[..., 2]) / 255
    at = (np.arange(0, height, side), np.arange(0, width, side))
    mean = lambda mask: np.add.reduceat(np.add.reduceat(mask.astype(np.float64), at[0], 0), at[1], 1)
    total = mean(np.ones_like(lum))
    return mean(lum <= K.INK_LUMINANCE) / total, mean((lum > 0.25) & (lum < 0.75)) / total, side


def _components(core: np.ndarray) -> list[np.ndarray]:
    """Core cells by 4-connected component of the core grown by one cell, in raster order (FOLD6)."""
    rows, cols = core.shape
    grown = np.zeros((rows + 2, cols + 2), bool)
    for dr in range(3):
        for dc in range(3):
            grown[dr : dr + rows, dc : dc + cols] |= core
    support = grown[1:-1, 1:-1]
    label = np.where(support, np.arange(rows * cols).reshape(rows, cols), rows * cols)
    while True:  # smallest index spreads through the support
        padded = np.pad(label, 1, constant_values=rows * cols)
        least = np.minimum.reduce([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        least = np.where(support, least, rows * cols)
        if (least == label).all():
            break
        label = least
    flat = np.flatnonzero(core)
    groups: dict[int, list[int]] = {}
    for i in flat:
        groups.setdefault(int(label.flat[i]), []).append(int(i))
    return [np.array(g) for g in sorted(groups.values(), key=lambda g: g[0])]


def unread_regions(width: int, height: int, data: bytes, boxes: list[tuple[float, float, float, float]], scale: float = K.REFERENCE_SCALE) -> list[tuple]:
    """Regions of ink that no reading covers (FOLD8): box, kind, ink density, midtone share."""
    ink, mid, side = cell_grid(width, height, data, scale)
    rows, cols = ink.shape
    read = np.zeros((rows, cols), bool)
    more = K.READ_DILATE_PT * scale
    for x0, y0, x1, y1 in boxes:
        cell = lambda v, most: int(min(most, max(0, floor(v / side))))
        if x1 + more >= 0 and y1 + more >= 0 and x0 - more < cols * side and y0 - more < rows * side:
            read[cell(y0 - more, rows - 1) : cell(y1 + more, rows - 1) + 1, cell(x0 - more, cols - 1) : cell(x1 + more, cols - 1) + 1] = True
    found = []
    for own in _components(~read & (ink >= K.INK_FRACTION)):
        r, c = own // cols, own % cols
        box = (float(c.min() * side), float(r.min() * side), float(min(width, (c.max() + 1) * side)), float(min(height, (r.max() + 1) * side)))
        density, tone = float(ink.flat[own].mean()), float(mid.flat[own].mean())
        found.append([box, "pictorial" if tone >= K.PICTORIAL_MIDTONE else "structured", _half_up(density, 3), _half_up(tone, 3)])
    return [tuple(r) for r in _merged(found, K.MERGE_GAP_PT * scale) if _area(r[0]) >= K.REGION_AREA_PT2 * scale * scale]


def _area(b: tuple) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _merged(regions: list[list], gap: float) -> list[list]:
    """Near regions of one kind become one, again and again in list order (FOLD7)."""
    while True:
        out: list[list] = []
        for r in regions:
            b = r[0]
            k = next((k for k in out if k[1] == r[1] and k[0][0] - gap <= b[2] and b[0] - gap <= k[0][2] and k[0][1] - gap <= b[3] and b[1] - gap <= k[0][3]), None)
            if k is None:
                out.append(list(r))
                continue
            u, v = _area(k[0]), _area(b)
            k[0] = (min(k[0][0], b[0]), min(k[0][1], b[1]), max(k[0][2], b[2]), max(k[0][3], b[3]))
            k[2], k[3] = (_half_up((k[i] * u + r[i] * v) / (u + v), 3) for i in (2, 3))
        if len(out) == len(regions):
            return out
        regions = out


def find_unread_ink(rasters: DataFrame, boxes: DataFrame, *, scale: float = K.REFERENCE_SCALE) -> DataFrame:
    """Regions of every page. ``boxes`` holds what was read. A page that is not in ``rasters`` was
    never analysed and has no row; a clean page has none either, so join with ``rasters`` to
    tell the two apart."""
    ship(rasters.sparkSession)
    read = boxes.groupBy("page_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("read"))
    kind = rasters.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = unread_regions(r["width"], r["height"], r["data"], [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r["read"] or ()], scale)
                rows = [(r["page_id"], i, *box, what, density, tone) for i, (box, what, density, tone) in enumerate(found)]
                cols = list(zip(*rows)) or [()] * 9
                kinds = [batch.schema.field("page_id").type, pa.int32(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "region", "x0", "y0", "x1", "y1", "kind", "density", "midtone"])

    joined = rasters.join(read, "page_id", "left").select("page_id", "width", "height", "data", "read")
    return joined.mapInArrow(run, f"page_id {kind}, region int, x0 double, y0 double, x1 double, y1 double, kind string, density double, midtone double")


def can_be_residue(scale: float = K.REFERENCE_SCALE) -> Column:
    """The narrow side is wide enough for text (FLT7)."""
    return F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= K.RESIDUE_SIDE_PT * scale


def recovered_counts(regions: DataFrame, ocr: DataFrame) -> DataFrame:
    """Recovered readings of each structured region, by largest overlap (JOIN7)."""
    home = attribute_to_regions(ocr.where("recovery_method is not null and trim(text) <> ''"), regions.where("kind = 'structured'"))
    return regions.join(home.groupBy("page_id", "region").agg(F.count("*").alias("recovered")), ["page_id", "region"], "left").withColumn("recovered", F.coalesce("recovered", F.lit(0).cast("long")))


def confirmed_counts(regions: DataFrame, receipts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Valid receipts with the reading that backs each (FOLD10): a receipt belongs to the region it overlaps most,
    repeats a known reading, and each reading backs one receipt. ``receipts`` has page_id,
    region, ord, id, text and a box."""
    valid = receipts.where((G.area(G.box()) > 0) & (F.trim("text") != ""))
    home = attribute_to_regions(valid, regions.where("kind = 'structured'")).select("page_id", "id", F.col("region").alias("home"))
    own = valid.join(home, ["page_id", "id"]).where("home = region")
    k = evidence.select("page_id", F.col("ord").alias("k_ord"), F.col("id").alias("known"))
    pairs = repeated_readings(own, evidence).join(k, ["page_id", "k_ord"])

    def run(rows: list[dict]) -> list[tuple]:
        used: set = set()
        seen: set = set()
        out = []
        for r in rows:
            if r["id"] not in seen and r["known"] not in used:
                seen.add(r["id"]), used.add(r["known"])
                out.append((r["page_id"], r["region"], r["id"], r["known"]))
        return out

    kind = receipts.schema["page_id"].dataType.simpleString()
    backed = fold_pages(pairs.join(own.select("page_id", "id", "region", "ord"), ["page_id", "id"]), ["page_id"], ["region", "ord", "k_ord"], run, f"page_id {kind}, region int, id string, known string")
    return backed


def residue(regions: DataFrame, ocr: DataFrame, confirmed: DataFrame | None = None, *, scale: float = K.REFERENCE_SCALE) -> DataFrame:
    """Structured regions with ``unread``: nothing recovered, nothing confirmed (AGG8)."""
    df = recovered_counts(regions.where("kind = 'structured'"), ocr)
    ok = confirmed.groupBy("page_id", "region").agg(F.count("*").alias("confirmed")) if confirmed is not None else None
    df = df.join(ok, ["page_id", "region"], "left") if ok is not None else df.withColumn("confirmed", F.lit(None).cast("long"))
    return df.withColumn("unread", can_be_residue(scale) & (F.col("recovered") == 0) & F.col("confirmed").isNull())


def tiles(regions: DataFrame, *, scale: float = K.REFERENCE_SCALE) -> DataFrame:
    """Crop windows over structured regions for a second pass (JOIN10): a region with a margin,
    cut into tiles of at most 900 pixels, without tiles that leave the page."""
    m = K.REGION_MARGIN_PT * scale
    x0, y0 = F.greatest(F.lit(0.0), F.col("x0") - m), F.greatest(F.lit(0.0), F.col("y0") - m)
    x1, y1 = F.col("x1") + m, F.col("y1") + m
    step = F.lit(float(K.TILE_PX))
    cut = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((hi - lo) / step).cast("int") - 1)), lambda i: lo + i * step)
    df = regions.where("kind = 'structured'").withColumns({"_xs": cut(x0, x1), "_ys": cut(y0, y1), "_x1": x1, "_y1": y1})
    df = df.withColumn("tx0", F.explode("_xs")).withColumn("ty0", F.explode("_ys"))
    return df.select("page_id", "region", "tx0", "ty0", F.least(F.col("tx0") + step, F.col("_x1")).alias("tx1"), F.least(F.col("ty0") + step, F.col("_y1")).alias("ty1"))
