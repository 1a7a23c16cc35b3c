"""Outcome of HTTP exchanges recorded in access logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.constants import DOWNLOAD_FAILED, NO_CONTENT_LENGTH, SIZE_PROBE_FAILED
from folioscale.functions._util import ColumnOrName, col


def http_ok(status: ColumnOrName, ranged: bool = False) -> Column:
    """2xx is accepted. A range request needs 206: a server that ignores the
    range and sends the whole file must not pass for one block of it."""
    status = col(status)
    return status == 206 if ranged else status.between(200, 299)


def http_error(
    status: ColumnOrName, reason: ColumnOrName, content_length: ColumnOrName | None = None
) -> Column:
    """Error text of a size probe (``content_length`` given) or a download,
    NULL when it succeeded."""
    detail = F.concat(col(status).cast("string"), F.lit(" "), F.coalesce(col(reason), F.lit("")))
    if content_length is None:
        return F.when(~http_ok(status), F.concat(F.lit(DOWNLOAD_FAILED), detail))
    return F.when(~http_ok(status), F.concat(F.lit(SIZE_PROBE_FAILED), detail)).when(
        col(content_length).isNull(), F.lit(NO_CONTENT_LENGTH)
    )


def range_response(
    found: ColumnOrName, method: ColumnOrName, range_header: ColumnOrName, file_size: ColumnOrName
) -> Column:
    """What a range-capable file server answers, as STRUCT<status, range_start,
    range_end, content_length>. Range fields are NULL unless status is 206."""
    found, method, header = col(found), col(method), col(range_header)
    size = col(file_size).cast("bigint")

    ranged = found & (method != "HEAD") & F.coalesce(header != "", F.lit(False))
    start = F.regexp_extract(header, "^(?:bytes=)?([0-9]+)", 1).try_cast("bigint")
    last = F.regexp_extract(header, "^(?:bytes=)?[^-]*-([0-9]+)", 1).try_cast("bigint")
    end = F.coalesce(last, size - 1)

    return F.struct(
        F.when(~found, 404).when(ranged, 206).otherwise(200).alias("status"),
        F.when(ranged, start).alias("range_start"),
        F.when(ranged, end).alias("range_end"),
        F.when(ranged, end - start + 1).when(found, size).alias("content_length"),
    )
