"""File names, output paths and object keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscale.functions._util import ColumnOrName, col
from folioscale.functions.formats import format_extension


def sink_path(directory: ColumnOrName, prefix: ColumnOrName, page: ColumnOrName, fmt: ColumnOrName) -> Column:
    """``directory/prefix_N.ext``."""
    name = F.concat(
        col(prefix), F.lit("_"), col(page).cast("string"), F.lit("."), format_extension(fmt)
    )
    return F.concat_ws("/", col(directory), name)


def sink_key(key_prefix: ColumnOrName, page: ColumnOrName, fmt: ColumnOrName) -> Column:
    """``key_prefix/page_N.ext``; a file-name prefix plays no part in keys."""
    return sink_path(key_prefix, F.lit("page"), page, fmt)


def strip_pdf(name: ColumnOrName) -> Column:
    """Remove the first ``.pdf`` (case-sensitive), wherever it stands."""
    name = col(name)
    at = F.locate(".pdf", name)
    rest = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 4, F.length(name)))
    return F.when(at == 0, name).otherwise(rest)


def base_name(path: ColumnOrName) -> Column:
    """Last path segment, ignoring trailing slashes."""
    return F.regexp_extract(col(path), "([^/]*)/*$", 1)


def short_name(name: ColumnOrName) -> Column:
    """Names over 20 characters keep 17 and end in ``...``."""
    name = col(name)
    return F.when(F.length(name) > 20, F.concat(F.substring(name, 1, 17), F.lit("..."))).otherwise(name)


# What form encoding escapes but URI component encoding does not,
# and the space.
_FORM_TO_COMPONENT = (
    ("+", "%20"),
    ("%21", "!"),
    ("%27", "'"),
    ("%28", "("),
    ("%29", ")"),
    ("%7E", "~"),
)


def encode_component(text: ColumnOrName) -> Column:
    """Percent-encode as a URI component."""
    encoded = F.url_encode(col(text))
    for escaped, literal in _FORM_TO_COMPONENT:
        encoded = F.replace(encoded, F.lit(escaped), F.lit(literal))
    return encoded


def decode_component(text: ColumnOrName) -> Column:
    """Inverse of ``encode_component``: ``+`` stays, bad escapes give NULL."""
    return F.try_url_decode(F.replace(col(text), F.lit("+"), F.lit("%2B")))
