"""Column functions over boxes and other rectangles, without images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = ("", "none", "null", "nan")
MIN_SIDE = 8
NUMBER = r"-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,15})?"
#: Four numbers as JSON writes them, without an exponent.
PLAIN = rf"^\[ ?{NUMBER}(, ?{NUMBER}){{3}} ?\]$"
_INF = float("inf")


def is_empty(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*EMPTY)


def numbers(text: Column) -> Column:
    """The list in JSON text as doubles; an element that is no number is null; null if it is no list."""
    return F.transform(F.from_json(text, "array<string>"), lambda x: F.replace(x, F.lit('"'), F.lit("")).try_cast("double"))


def parsed(text: Column) -> Column:
    """error and box of a box text, each text parsed once.

    error: empty, not_a_list, size, not_a_number, not_finite, degenerate or ok; box: [x1, y1, x2, y2] if ok, else null.
    """

    def judged(v: Column, t: Column) -> Column:
        x1, y1, x2, y2 = (F.get(v, F.lit(i)) for i in range(4))
        error = (
            F.when(is_empty(t), "empty")
            .when(~F.trim(t).startswith("[") | v.isNull(), "not_a_list")
            .when(F.size(v) != 4, "size")
            .when(x1.isNull() | y1.isNull() | x2.isNull() | y2.isNull(), "not_a_number")
            .when(~(F.abs(x1) < _INF) | ~(F.abs(y1) < _INF) | ~(F.abs(x2) < _INF) | ~(F.abs(y2) < _INF), "not_finite")
            .when((x2 <= x1) | (y2 <= y1), "degenerate")
            .otherwise("ok")
        )
        return F.struct(error.alias("error"), F.when(error == "ok", v).alias("box"))

    # a one-element transform binds the parsed list to a name, so that the branches don't parse it again
    bound = F.transform(F.array(F.struct(numbers(text).alias("v"), text.alias("t"))), lambda s: judged(s["v"], s["t"]))
    # most texts are four plain numbers: those need no JSON parser
    v = F.split(F.substring(text, 2, 1_000), ",")
    x1, y1, x2 = (F.get(v, F.lit(i)).cast("double") for i in range(3))
    y2 = F.regexp_replace(F.get(v, F.lit(3)), "]", "").cast("double")
    good = (x2 > x1) & (y2 > y1)
    quick = F.struct(F.when(good, "ok").otherwise("degenerate").alias("error"), F.when(good, F.array(x1, y1, x2, y2)).alias("box"))
    return F.when(text.rlike(PLAIN), quick).otherwise(F.get(bound, F.lit(0)))


def error_class(text: Column) -> Column:
    """empty, not_a_list, size, not_a_number, not_finite, degenerate or ok."""
    return parsed(text)["error"]


def box(text: Column) -> Column:
    """[x1, y1, x2, y2] of a good box text, else null."""
    return parsed(text)["box"]


def sides(b: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.get(b, F.lit(i)) for i in range(4))


def area(b: Column) -> Column:
    x1, y1, x2, y2 = sides(b)
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    a1, a2, a3, a4 = sides(a)
    b1, b2, b3, b4 = sides(b)
    return F.greatest(F.lit(0.0), F.least(a3, b3) - F.greatest(a1, b1)) * F.greatest(F.lit(0.0), F.least(a4, b4) - F.greatest(a2, b2))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The box out to whole pixels and inside the frame; null when nothing is left."""
    x1, y1, x2, y2 = sides(b)
    out = F.array(F.greatest(F.lit(0.0), F.floor(x1).cast("double")), F.greatest(F.lit(0.0), F.floor(y1).cast("double")), F.least(width.cast("double"), F.ceil(x2).cast("double")), F.least(height.cast("double"), F.ceil(y2).cast("double")))
    return F.when((F.get(out, F.lit(2)) > F.get(out, F.lit(0))) & (F.get(out, F.lit(3)) > F.get(out, F.lit(1))), out)


def sorted_clip(b: Column, width: Column, height: Column, min_side: int = MIN_SIDE) -> Column:
    """Corners in order, whole numbers by truncation, inside the frame; null with a side under min_side."""
    x1, y1, x2, y2 = sides(b)
    lo = lambda a, c: F.greatest(F.lit(0), F.least(a, c).cast("int"))
    hi = lambda a, c, m: F.least(m.cast("int"), F.greatest(a, c).cast("int"))
    out = F.array(lo(x1, x2), lo(y1, y2), hi(x1, x2, width), hi(y1, y2, height))
    return F.when((F.get(out, F.lit(2)) - F.get(out, F.lit(0)) >= min_side) & (F.get(out, F.lit(3)) - F.get(out, F.lit(1)) >= min_side), out)


def expanded(b: Column, percent: float, width: Column, height: Column) -> Column:
    """The box grown on each side by percent of its size, then clipped."""
    x1, y1, x2, y2 = sides(b)
    mx, my = (x2 - x1) * percent / 100.0, (y2 - y1) * percent / 100.0
    return clipped(F.array(x1 - mx, y1 - my, x2 + mx, y2 + my), width, height)


def interior(b: Column, share: float) -> Column:
    """The box less a band of share of its size on each side."""
    x1, y1, x2, y2 = sides(b)
    mx, my = (x2 - x1) * share, (y2 - y1) * share
    return F.array(x1 + mx, y1 + my, x2 - mx, y2 - my)


def quad_box(xs: list[Column], ys: list[Column], width: Column, height: Column, min_side: int = MIN_SIDE) -> Column:
    """The upright box around a quad's corners, inside the frame, half-even; null with a side under min_side."""
    out = F.array(F.bround(F.greatest(F.lit(0.0), F.least(*xs)), 0), F.bround(F.greatest(F.lit(0.0), F.least(*ys)), 0), F.bround(F.least(width, F.greatest(*xs)), 0), F.bround(F.least(height, F.greatest(*ys)), 0))
    return F.when((F.get(out, F.lit(2)) - F.get(out, F.lit(0)) >= min_side) & (F.get(out, F.lit(3)) - F.get(out, F.lit(1)) >= min_side), out)


def box_list(text: Column) -> Column:
    """Boxes of a JSON list; a single bare box counts as a list of one; boxes without area are dropped."""
    many = F.coalesce(F.from_json(text, "array<array<double>>"), F.array(F.from_json(text, "array<double>")))
    return F.filter(many, lambda b: (F.size(b) == 4) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))))


def worst_overlap(patch: Column, boxes: Column) -> Column:
    """The largest share of the patch that one of the boxes covers; 0 without boxes."""
    return F.coalesce(F.array_max(F.transform(boxes, lambda b: intersection(patch, b) / area(patch))), F.lit(0.0))


def zone(patch: Column, document: Column, least_edge: float = 0.1) -> Column:
    """interior (at least 0.999 inside), exterior (nothing inside), edge (a share between), or null."""
    share = intersection(patch, document) / area(patch)
    return F.when(share >= 0.999, "interior").when(share == 0, "exterior").when((share >= least_edge) & (share <= 1 - least_edge), "edge")


def export_scale(long_side: Column, size: float) -> Column:
    """At most 1: exports only shrink."""
    return F.least(F.lit(1.0), F.lit(float(size)) / long_side)


def scaled_side(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1.0), F.bround(side * scale, 0)).cast("int")


def scaled_box(b: Column, scale: Column) -> Column:
    return F.transform(b, lambda x: F.bround(x * scale, 2))


def legible_px(b: Column, scale: Column, share: float) -> Column:
    """Size in pixels, after export, of what takes a share of the document's short side (text 0.04, face 0.35)."""
    x1, y1, x2, y2 = sides(b)
    return share * F.least(x2 - x1, y2 - y1) * scale


def fills_frame(b: Column, width: Column, height: Column, slack: float = 0.02) -> Column:
    x1, y1, x2, y2 = sides(b)
    return (x1 <= slack * width) & (y1 <= slack * height) & (x2 >= (1 - slack) * width) & (y2 >= (1 - slack) * height)


def frame_share(b: Column, width: Column, height: Column) -> Column:
    """The document's share of the frame on its tighter axis."""
    x1, y1, x2, y2 = sides(b)
    return F.greatest((F.least(x2, width) - F.greatest(x1, F.lit(0.0))) / width, (F.least(y2, height) - F.greatest(y1, F.lit(0.0))) / height)


def letterbox(width: Column, height: Column, size: int) -> Column:
    """width, height, left, top of a frame shrunk into a square of size and centred."""
    scale = F.least(F.lit(1.0), F.lit(float(size)) / F.greatest(width, height))
    w, h = scaled_side(width, scale), scaled_side(height, scale)
    return F.struct(w.alias("w"), h.alias("h"), F.floor((size - w) / 2).cast("int").alias("left"), F.floor((size - h) / 2).cast("int").alias("top"))


def least_peak(peaks: list[Column]) -> Column:
    """The weakest of the corners' peaks; null unless all are there."""
    missing = peaks[0].isNull()
    for p in peaks[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.least(*peaks))
