"""Box geometry over columns. A box is four columns (or fields) x0, y0, x1, y1; y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns ``<prefix>x0`` … ``<prefix>y1``."""
    return tuple(F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1"))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Rounds halves toward positive infinity, unlike ``round`` (GEO2)."""
    unit = float(10**digits)
    return F.floor(c * unit + 0.5) / unit


def is_valid(b: Box) -> Column:
    """Finite and ordered with positive area (GEO1, GEO25)."""
    ok = (b[2] > b[0]) & (b[3] > b[1])
    for c in b:
        ok = ok & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(ok, F.lit(False))


def is_within(b: Box, width: Column, height: Column, tolerance: float = 0.0) -> Column:
    """Valid and inside a page (GEO10)."""
    return is_valid(b) & (b[0] >= -tolerance) & (b[1] >= -tolerance) & (b[2] <= width + tolerance) & (b[3] <= height + tolerance)


def area(b: Box) -> Column:
    """Never negative (GEO4)."""
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    """Shared area (GEO4)."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def overlap_over_smaller(a: Box, b: Box) -> Column:
    """Shared area over the smaller box's, 0 if that is empty (GEO5)."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 without area (GEO13, GEO26)."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def centre_distance(a: Box, b: Box) -> Column:
    """Distance of the centres (GEO14)."""
    return F.sqrt(F.pow((a[0] + a[2] - b[0] - b[2]) / 2, F.lit(2.0)) + F.pow((a[1] + a[3] - b[1] - b[3]) / 2, F.lit(2.0)))


def transform_point(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """A point through a six-value affine (GEO6)."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def is_conformal(m: Column, tolerance: float = 1e-6) -> Column:
    """Uniform scale, no shear, invertible (part of GEO8)."""
    a, b, c, d = m[0], m[1], m[2], m[3]
    first, second = F.sqrt(a * a + b * b), F.sqrt(c * c + d * d)
    return (first > 0) & (second > 0) & (F.abs(first - second) <= tolerance * F.greatest(first, second)) & (F.abs(a * c + b * d) <= tolerance * first * second)


def point_bounds(bounds: Column, point_width: Column, point_height: Column) -> Column:
    """Declared bounds, else those of a page of the declared size, else null (GEO7): an array x0, y0, x1, y1."""
    sized = (point_width != 0) & (point_height != 0)
    return F.coalesce(bounds, F.when(sized, F.array(F.lit(0.0), F.lit(0.0), point_width.cast("double"), point_height.cast("double"))))


def pixels_per_point(m: Column, width: Column, bounds: Column, rotation: Column) -> Column:
    """From the matrix, else the width over that of the bounds (over their height if the page is turned
    by anything but a half circle), else 1.6 (GEO9)."""
    from folioscope.constants import REFERENCE_SCALE

    by_matrix = F.sqrt(m[0] * m[0] + m[1] * m[1])
    usable = (by_matrix > 0) & (by_matrix < float("inf")) & ~F.isnan(by_matrix)
    upright = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(180)) == 0
    by_bounds = width / F.when(upright, bounds[2] - bounds[0]).otherwise(bounds[3] - bounds[1])
    return F.coalesce(F.when(usable, by_matrix), by_bounds, F.lit(REFERENCE_SCALE))


def fits_page(m: Column, bounds: Column, width: Column, height: Column, tolerance: float = 1.01) -> Column:
    """The matrix is finite, conformal and invertible and takes the bounds to the rendered page (GEO8);
    renderers round sizes up, so an edge may be off by a pixel. Without a matrix there is nothing to fit."""
    finite = F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x0, y0, x1, y1 = render_box((bounds[0], bounds[1], bounds[2], bounds[3]), m)
    near = (F.abs(x0) <= tolerance) & (F.abs(y0) <= tolerance) & (F.abs(x1 - width) <= tolerance) & (F.abs(y1 - height) <= tolerance)
    invertible = F.abs(m[0] * m[3] - m[1] * m[2]) >= 1e-12
    return F.when(m.isNull(), True).otherwise(F.coalesce(bounds.isNotNull() & finite & is_conformal(m) & invertible & near, F.lit(False)))


def merge_geometry(native: dict[str, Column], rendered: dict[str, Column]) -> dict[str, Column]:
    """Field by field what the renderer says, else what the native reader says (GEO23); the size is the renderer's."""
    out = {k: F.coalesce(rendered[k], native[k]) if k in native and k in rendered else rendered.get(k, native.get(k)) for k in [*native, *[k for k in rendered if k not in native]]}
    return {**out, "width": rendered["width"], "height": rendered["height"]}


def box_of_polygon(points: Column) -> tuple[Column, Column, Column, Column]:
    """Envelope of a reading's polygon, an array of ``struct(x, y)`` (GEO21)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def render_box(b: Box, m: Column) -> Box:
    """A point box in rendered pixels: the envelope of its four corners (GEO11)."""
    corners = [transform_point(x, y, m) for x in (b[0], b[2]) for y in (b[1], b[3])]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def from_crop(b: Box, origin: tuple[Column, Column], zoom: Column) -> Box:
    """Crop pixels back to first-render pixels (GEO12)."""
    return b[0] / zoom + origin[0], b[1] / zoom + origin[1], b[2] / zoom + origin[0], b[3] / zoom + origin[1]


def crop_window(b: Box, scale: Column, dpi: float, margin_pt: float | None = None) -> tuple[Column, Column, Column, Column]:
    """x, y, width, height of a rendered box's crop in whole pixels at ``dpi``, with a margin; the origin
    stays on the page, the size does not shrink for it (GEO17)."""
    from folioscope.constants import REGION_MARGIN_PT

    at = lambda v: F.floor(v / scale * dpi / 72 + 0.5).cast("long")
    margin = at((REGION_MARGIN_PT if margin_pt is None else margin_pt) * scale)
    zero = F.lit(0).cast("long")
    return F.greatest(zero, at(b[0]) - margin), F.greatest(zero, at(b[1]) - margin), at(b[2]) - at(b[0]) + 2 * margin, at(b[3]) - at(b[1]) + 2 * margin


def to_normalized(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """ymin, xmin, ymax, xmax in thousandths of the page (GEO16); a box beyond the page keeps its place."""
    at = lambda v, full: F.floor(v / full * 1000 + 0.5).cast("long")
    return at(b[1], height), at(b[0], width), at(b[3], height), at(b[2], width)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of ``struct(x, y)`` (GEO19)."""
    n = F.size(points)
    cross = lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(i))) / 2


def polygon_fits(points: Column, b: Box, tolerance: float = 0.01) -> Column:
    """Envelope equals the box within a tolerance and the area is positive (GEO19, GEO24)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    near = lambda u, v: F.abs(u - v) <= tolerance
    return near(F.array_min(xs), b[0]) & near(F.array_min(ys), b[1]) & near(F.array_max(xs), b[2]) & near(F.array_max(ys), b[3]) & (polygon_area(points) > 0)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """0 to 1 (GEO20)."""
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def box_key(b: Box) -> Column:
    """Rounded box as text, whole numbers without a fraction (GEO22)."""
    return F.concat_ws(",", *[F.regexp_replace(F.call_function("format_number", round_half_up(c), F.lit("0.##")), ",", "") for c in b])


def reading_key(b: Box, bucket: float = 12.0) -> list[Column]:
    """Sort columns: nearest 12-pixel row, then x (GEO18)."""
    return [F.floor((b[1] + b[3]) / 2 / bucket + 0.5), (b[0] + b[2]) / 2]
