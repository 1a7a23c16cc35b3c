"""Input kinds and output formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.constants import DEFAULT_FORMAT, MEDIA_TYPES, SUPPORTED_FORMATS, UNSUPPORTED_FORMAT
from folioscale.functions._util import ColumnOrName, col


def classify_input(value: ColumnOrName) -> Column:
    """``url`` or ``file``. The scheme test is case-sensitive on purpose."""
    value = col(value)
    is_url = value.startswith("http://") | value.startswith("https://")
    return F.when(value.isNull(), F.lit(None)).when(is_url, "url").otherwise("file")


def normalize_format(fmt: ColumnOrName) -> Column:
    """Lower-cased format, ``webp`` when unset, NULL when unsupported."""
    lowered = F.lower(F.coalesce(col(fmt), F.lit(DEFAULT_FORMAT)))
    return F.when(lowered.isin(*SUPPORTED_FORMATS), lowered)


def format_error(fmt: ColumnOrName) -> Column:
    """Error text for an unsupported format, else NULL."""
    message = F.concat(
        F.lit(UNSUPPORTED_FORMAT[0]),
        col(fmt),
        F.lit(UNSUPPORTED_FORMAT[1] + ", ".join(SUPPORTED_FORMATS)),
    )
    return F.when(normalize_format(fmt).isNull(), message)


def lenient_format(fmt: ColumnOrName) -> Column:
    """Any unknown or missing format means ``webp``."""
    lowered = F.lower(col(fmt))
    return (
        F.when(lowered == "png", "png")
        .when(lowered.isin("jpg", "jpeg"), "jpg")
        .otherwise(DEFAULT_FORMAT)
    )


def format_extension(fmt: ColumnOrName) -> Column:
    fmt = col(fmt)
    return F.when(fmt == "jpeg", "jpg").otherwise(fmt)


def format_mime(fmt: ColumnOrName) -> Column:
    """Media type of an already lower-cased format; ``image/webp`` otherwise."""
    fmt = col(fmt)
    result = F.lit(MEDIA_TYPES[DEFAULT_FORMAT])
    for name, media_type in MEDIA_TYPES.items():
        result = F.when(fmt == name, media_type).otherwise(result)
    return result


def png_effort(level: ColumnOrName) -> Column:
    """Compression level 0-3, 4-6 or higher as fast / default / best."""
    level = col(level)
    return F.when(level.between(0, 3), "fast").when(level.between(4, 6), "default").otherwise("best")
