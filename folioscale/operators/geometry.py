"""Scanned-page detection and target sizes.

Page sizes are 32-bit floats in the domain, so every step is cast back to
FLOAT: Spark divides floats as doubles, and the extra digits would move some
results across a rounding edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscale.constants import (
    MAX_SCALE,
    RASTER_MAX_SIDE,
    SCAN_WIDTH,
    TARGET_WIDTH,
    WEBP_MAX_SIDE,
)


def scan_detection(objects: DataFrame) -> DataFrame:
    """Per page: object counts and whether it looks scanned, that is, has
    images but no text. Counts combine before the shuffle."""
    texts = F.count_if(F.col("object_type") == "Text")
    images = F.count_if(F.col("object_type") == "Image")
    return (
        objects.groupBy("doc_id", "page_num")
        .agg(texts.alias("text_objects"), images.alias("image_objects"))
        .withColumn("is_scan", (F.col("text_objects") == 0) & (F.col("image_objects") > 0))
    )


def side_limit(fmt: Column, limit_mode: str = "encoded") -> Column:
    """Largest side allowed: webp is tighter, except for raw bitmaps."""
    if limit_mode == "raw":
        return F.lit(RASTER_MAX_SIDE)
    if limit_mode != "encoded":
        raise ValueError(f"limit_mode must be 'encoded' or 'raw', not {limit_mode!r}")
    return F.when(fmt == "webp", WEBP_MAX_SIDE).otherwise(RASTER_MAX_SIDE)


def _as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _f32(value: Column) -> Column:
    return value.cast("float")


def _pixels(points: Column, scale: Column) -> Column:
    return F.round(_f32(points * scale)).cast("bigint")


def plan_page_size(
    pages: DataFrame,
    limit: Column,
    target_width: Column | int = TARGET_WIDTH,
    scan_width: Column | int = SCAN_WIDTH,
    max_scale: Column | float = MAX_SCALE,
    width_pt: str = "width_pt",
    height_pt: str = "height_pt",
    is_scan: str = "is_scan",
) -> DataFrame:
    """Add INT ``width`` and ``height`` in pixels.

    The width is scaled to the target, by ``max_scale`` at most. If a side is
    then over ``limit``, the scale shrinks by the worse of the two excesses.
    Kept as successive projections so that no step is evaluated twice.
    """
    target = F.when(F.col(is_scan), scan_width).otherwise(target_width)
    by_width = _f32(F.try_divide(_f32(target), F.col("_w")))
    sized = (
        pages.withColumns(
            {"_w": _f32(F.col(width_pt)), "_h": _f32(F.col(height_pt)), "_limit": limit.cast("bigint")}
        )
        .withColumn("_scale", F.least(by_width, _f32(_as_column(max_scale))))
        .withColumns({"_pw": _pixels(F.col("_w"), F.col("_scale")), "_ph": _pixels(F.col("_h"), F.col("_scale"))})
    )

    def excess(side: Column) -> Column:
        shrink = _f32(_f32(F.col("_limit")) / _f32(side))
        return F.when(side > F.col("_limit"), shrink).otherwise(_f32(F.lit(1.0)))

    shrunk = sized.withColumn("_shrink", F.least(excess(F.col("_pw")), excess(F.col("_ph"))))
    over = (F.col("_pw") > F.col("_limit")) | (F.col("_ph") > F.col("_limit"))
    scale = _f32(F.col("_scale") * F.col("_shrink"))
    return shrunk.withColumns(
        {
            "width": F.when(over, _pixels(F.col("_w"), scale)).otherwise(F.col("_pw")).cast("int"),
            "height": F.when(over, _pixels(F.col("_h"), scale)).otherwise(F.col("_ph")).cast("int"),
        }
    ).drop("_w", "_h", "_limit", "_scale", "_pw", "_ph", "_shrink")
