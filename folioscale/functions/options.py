"""Conversion options: three ways of filling in what a user left out.

``convert`` skips 0 as well as NULL for qualities, ``merged`` and ``native``
skip only NULL; their defaults differ too. Each returns a STRUCT.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.constants import (
    DEFAULT_FORMAT,
    JPEG_QUALITY,
    LEGACY_JPEG_QUALITY,
    MAX_SCALE,
    PNG_LEVEL,
    SCAN_WIDTH,
    TARGET_WIDTH,
    WEBP_METHOD,
    WEBP_QUALITY,
)
from folioscale.functions._util import col, null_if_empty, null_if_zero
from folioscale.functions.formats import lenient_format, normalize_format, png_effort

SINK_FIELDS = ("secret_id", "secret_key", "bucket", "region")


def _or(name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def convert_options() -> Column:
    """Library path. Format is NULL when unsupported; scan width and maximum
    scale cannot be set here and take their defaults."""
    def quality(name: str, default: int) -> Column:
        return F.coalesce(null_if_zero(F.col(name)), null_if_zero(F.col("quality")), F.lit(default))

    return F.struct(
        normalize_format("format").alias("format"),
        _or("target_width", TARGET_WIDTH).alias("target_width"),
        F.lit(SCAN_WIDTH).alias("scan_width"),
        F.lit(MAX_SCALE).cast("float").alias("max_scale"),
        _or("detect_scan", False).alias("detect_scan"),
        quality("webp_quality", WEBP_QUALITY).alias("webp_quality"),
        _or("webp_method", WEBP_METHOD).alias("webp_method"),
        quality("jpeg_quality", JPEG_QUALITY).alias("jpeg_quality"),
        _or("png_compression", PNG_LEVEL).alias("png_compression"),
    )


def _null_only_options(
    fmt: Column, jpeg_default: int, scan_width: Column | None, max_scale: Column | None
) -> list[Column]:
    scan_width = F.coalesce(*[c for c in (scan_width, F.lit(SCAN_WIDTH)) if c is not None])
    max_scale = F.coalesce(*[c for c in (max_scale, F.lit(MAX_SCALE)) if c is not None])
    return [
        fmt.alias("format"),
        _or("target_width", TARGET_WIDTH).alias("target_width"),
        scan_width.alias("scan_width"),
        max_scale.cast("float").alias("max_scale"),
        _or("detect_scan", True).alias("detect_scan"),
        F.coalesce("webp_quality", "quality", F.lit(WEBP_QUALITY)).alias("webp_quality"),
        _or("webp_method", WEBP_METHOD).alias("webp_method"),
        F.coalesce("jpeg_quality", "quality", F.lit(jpeg_default)).alias("jpeg_quality"),
        _or("png_compression", PNG_LEVEL).alias("png_compression"),
    ]


def merged_options(scan_width: Column | None = None, max_scale: Column | None = None) -> Column:
    """Configuration-merge path: the format passes through unchecked."""
    return F.struct(
        *_null_only_options(_or("format", DEFAULT_FORMAT), JPEG_QUALITY, scan_width, max_scale)
    )


def native_options(scan_width: Column | None = None, max_scale: Column | None = None) -> Column:
    """Renderer path: unknown formats mean webp, PNG level becomes an effort."""
    return F.struct(
        *_null_only_options(lenient_format("format"), LEGACY_JPEG_QUALITY, scan_width, max_scale),
        png_effort(_or("png_compression", PNG_LEVEL)).alias("png_effort"),
    )


# Documented ranges of the numeric options.
_RANGES = {
    "quality": (0, 100),
    "webp_quality": (0, 100),
    "webp_method": (0, 6),
    "jpeg_quality": (0, 100),
    "png_compression": (0, 9),
}


def out_of_range_options(**ranges: tuple[int, int]) -> Column:
    """Names of the numeric options outside their documented range (or the one
    given here); narrowing such a value would silently wrap it around, so it is
    reported instead."""
    bad = [
        F.when(~F.col(name).between(low, high), F.lit(name))
        for name, (low, high) in {**_RANGES, **ranges}.items()
    ]
    return F.array_compact(F.array(*bad))


def missing_sink_fields(fallback: dict[str, Column] | None = None) -> Column:
    """Required sink settings that are NULL or empty, after the fallback."""
    fallback = fallback or {}
    missing = []
    for name in SINK_FIELDS:
        value = null_if_empty(col(name))
        if name in fallback:
            value = F.coalesce(value, null_if_empty(fallback[name]))
        missing.append(F.when(value.isNull(), F.lit(name)))
    return F.array_compact(F.array(*missing))
