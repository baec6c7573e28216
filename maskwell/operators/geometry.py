"""Boxes of spans, spans of boxes, and the carrying of spans between sources of a page.

Words are rows with the text unit, idx, bbox, block, line, start_off, end_off.
Spans that meet no word give no box; null bounds take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.functions.boxes import overlap_fraction

PAGE = ["document_id", "page"]
SOURCE = [*PAGE, "text_source_id"]


def span_words(spans: DataFrame, ident: str, words: DataFrame, key: list[str] = SOURCE) -> DataFrame:
    """(ident, key..., span_start, span_end, word columns): the words a span meets."""
    s = spans.select(ident, *key, F.col("start_off").alias("span_start"), F.col("end_off").alias("span_end")).filter("span_start < span_end").distinct()
    return s.join(words, key).filter("start_off < span_end AND span_start < end_off")


def span_boxes(spans: DataFrame, ident: str, words: DataFrame, whole: bool = True, key: list[str] = SOURCE) -> DataFrame:
    """(ident, key..., block, line, x0, y0, x1, y1): one box a line.

    With ``whole`` false a word that is met in part counts with that part of its width.
    """
    met = span_words(spans, ident, words, key)
    b = F.col("bbox")
    size = F.greatest(F.col("end_off") - F.col("start_off"), F.lit(1))
    width = b["x1"] - b["x0"]
    left = b["x0"] if whole else b["x0"] + width * F.greatest(F.lit(0), F.col("span_start") - F.col("start_off")) / size
    right = b["x1"] if whole else b["x1"] - width * F.greatest(F.lit(0), F.col("end_off") - F.col("span_end")) / size
    return met.groupBy(ident, *key, "block", "line").agg(F.min(left).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(right).alias("x1"), F.max(b["y1"]).alias("y1"))


def projected(boxes: DataFrame, ident: str, words: DataFrame, least: float = 0.5) -> DataFrame:
    """(ident, page..., text_source_id, start_off, end_off): where the boxes of a span lie in each source of the page.

    A word belongs to a box that covers ``least`` of its area.
    """
    box = boxes.select(ident, *PAGE, F.struct("x0", "y0", "x1", "y1").alias("_box"))
    near = box.join(words, PAGE).filter(overlap_fraction(F.col("bbox"), F.col("_box")) >= least)
    return near.groupBy(ident, *SOURCE).agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"))


def median_width(words: DataFrame, key: list[str], default: float = 5.0) -> DataFrame:
    """(key..., char_width): the median width of a character of each page."""
    w = (F.col("bbox")["x1"] - F.col("bbox")["x0"]) / F.length("text")
    return words.groupBy(*key).agg(F.coalesce(F.median(F.when(F.length("text") > 0, w)), F.lit(default)).alias("char_width"))


def width_cells(words: DataFrame, key: list[str], factor: float) -> DataFrame:
    """(key..., block, line, cell, first_idx, last_idx): runs of a line without a gap wider than ``factor`` characters."""
    w = Window.partitionBy(*key, "block", "line").orderBy("idx")
    one = words.join(median_width(words, key), key)
    far = F.coalesce(F.col("bbox")["x0"] - F.lag(F.col("bbox")["x1"]).over(w) > factor * F.col("char_width"), F.lit(True))
    marked = one.withColumn("_new", far.cast("int")).withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "block", "line", "cell").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def nearest_line_boxes(spans: DataFrame, ident: str, words: DataFrame, key: list[str] = SOURCE) -> DataFrame:
    """Fail-closed boxes: of spans that meet no word, the whole line of the word nearest to them."""
    s = spans.select(ident, *key, "start_off", "end_off").filter("start_off < end_off").distinct()
    lost = s.join(span_words(spans, ident, words, key).select(ident).distinct(), ident, "left_anti")
    w = words.select(*key, "block", "line", F.col("start_off").alias("_a"), F.col("end_off").alias("_b"))
    gap = F.greatest(F.col("_a") - F.col("end_off"), F.col("start_off") - F.col("_b"), F.lit(0))
    line = lost.join(w, key).groupBy(ident, *key).agg(F.min_by(F.struct("block", "line"), F.struct(gap, "_a")).alias("l")).select(ident, *key, "l.*")
    b = F.col("bbox")
    return line.join(words, [*key, "block", "line"]).groupBy(ident, *key, "block", "line").agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def visual_lines(words: DataFrame, key: list[str], least: float = 0.5, reach: int = 3) -> DataFrame:
    """``words`` with ``row``: words join one of the last ``reach`` lines they overlap by ``least`` of the lower height.

    The words of a page are folded in order in one array; a page is never a wider group.
    """
    item = F.struct("bbox.y0", "bbox.x0", "idx", F.col("bbox.y1").alias("y1"))
    per = words.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("w"))
    none = F.array().cast("array<struct<y0:double,y1:double,no:int>>")
    done = F.array().cast("array<struct<idx:int,row:int>>")

    def fits(x: Column):
        return lambda l: (F.least(l["y1"], x["y1"]) - F.greatest(l["y0"], x["y0"])) >= least * F.least(l["y1"] - l["y0"], x["y1"] - x["y0"])

    def step(acc: Column, x: Column) -> Column:
        hit = F.get(F.filter(acc["open"], fits(x)), F.lit(0))
        no = F.coalesce(hit["no"], acc["next"])
        new = F.struct(F.least(F.coalesce(hit["y0"], x["y0"]), x["y0"]).alias("y0"), F.greatest(F.coalesce(hit["y1"], x["y1"]), x["y1"]).alias("y1"), no.alias("no"))
        rest = F.slice(F.filter(acc["open"], lambda l: l["no"] != no), 1, reach - 1)
        return F.struct(F.concat(F.array(new), rest).alias("open"), F.greatest(acc["next"], no + 1).alias("next"), F.array_append(acc["out"], F.struct(x["idx"].alias("idx"), no.alias("row"))).alias("out"))

    start = F.struct(none.alias("open"), F.lit(0).alias("next"), done.alias("out"))
    rows = per.select(*key, F.explode(F.aggregate("w", start, step)["out"]).alias("r")).select(*key, "r.idx", "r.row")
    return words.join(rows, [*key, "idx"])


def corners_to_display(x0: Column, y0: Column, x1: Column, y1: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A box of user space in display space: the smallest that holds its four turned corners."""
    from maskwell.functions.boxes import make, to_display

    pts = [to_display(x, y, rotation, width, height) for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
    xs, ys = [p["x"] for p in pts], [p["y"] for p in pts]
    return make(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def to_user(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> Column:
    """Display space back to user space."""
    ux = F.when(rotation == 0, x).when(rotation == 90, y).when(rotation == 180, width - x).when(rotation == 270, width - y)
    uy = F.when(rotation == 0, height - y).when(rotation == 90, x).when(rotation == 180, y).when(rotation == 270, height - x)
    return F.struct(ux.alias("x"), uy.alias("y"))


def pixel_box(box: Column, dpi: float, offset_x: Column | None = None, offset_y: Column | None = None) -> Column:
    """The outward whole-pixel box of a box in points, within a crop that begins at the offset."""
    k = dpi / 72.0
    ox, oy = (offset_x if offset_x is not None else F.lit(0.0)), (offset_y if offset_y is not None else F.lit(0.0))
    return F.struct(
        F.floor((box["x0"] - ox) * k).cast("int").alias("x0"), F.floor((box["y0"] - oy) * k).cast("int").alias("y0"), F.ceil((box["x1"] - ox) * k).cast("int").alias("x1"), F.ceil((box["y1"] - oy) * k).cast("int").alias("y1")
    )


def point_box(box: Column, dpi: float, offset_x: Column | None = None, offset_y: Column | None = None) -> Column:
    """A pixel box of a crop in points of the page."""
    from maskwell.functions.boxes import make

    k = 72.0 / dpi
    ox, oy = (offset_x if offset_x is not None else F.lit(0.0)), (offset_y if offset_y is not None else F.lit(0.0))
    return make(box["x0"] * k + ox, box["y0"] * k + oy, box["x1"] * k + ox, box["y1"] * k + oy)


def unrotated(box: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A box of a picture turned by 0, 90 or 270 degrees on the upright page; other turns fail."""
    from maskwell.functions.boxes import make

    wrong = F.raise_error(F.concat(F.lit("no such turn: "), rotation.cast("string"))).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    return (
        F.when(rotation == 0, make(box["x0"], box["y0"], box["x1"], box["y1"]))
        .when(rotation == 90, make(box["y0"], height - box["x1"], box["y1"], height - box["x0"]))
        .when(rotation == 270, make(width - box["y1"], box["x0"], width - box["y0"], box["x1"]))
        .otherwise(wrong)
    )


def inside_regions(boxes: DataFrame, ident: str, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """(ident, ignored): whether every box of a span lies by ``least`` inside one region of its page; without boxes false."""
    b = boxes.select(ident, *PAGE, F.struct("x0", "y0", "x1", "y1").alias("_b")).withColumn("_n", F.monotonically_increasing_id())
    r = regions.select(*PAGE, F.struct("x0", "y0", "x1", "y1").alias("_r"))
    hit = b.join(r, PAGE, "left").groupBy(ident, "_n").agg(F.max(F.coalesce(overlap_fraction(F.col("_b"), F.col("_r")) >= least, F.lit(False))).alias("_in"))
    return hit.groupBy(ident).agg(F.min("_in").alias("ignored"))
