from folioscale.functions.blocks import (
    block_fetch_size,
    block_offset,
    block_range_header,
    first_block,
    last_block,
    request_id_pack,
    request_seq,
    request_task,
)
from folioscale.functions.display import (
    format_bytes,
    format_duration,
    format_size,
    format_time,
    size_in_mb,
)
from folioscale.functions.formats import (
    classify_input,
    format_error,
    format_extension,
    format_mime,
    lenient_format,
    normalize_format,
    png_effort,
)
from folioscale.functions.http import http_error, http_ok, range_response
from folioscale.functions.names import (
    base_name,
    decode_component,
    encode_component,
    short_name,
    sink_key,
    sink_path,
    strip_pdf,
)
from folioscale.functions.options import (
    convert_options,
    merged_options,
    missing_sink_fields,
    native_options,
    out_of_range_options,
)
from folioscale.functions.page_list import parse_page_list

__all__ = [
    "base_name",
    "block_fetch_size",
    "block_offset",
    "block_range_header",
    "classify_input",
    "convert_options",
    "decode_component",
    "encode_component",
    "first_block",
    "format_bytes",
    "format_duration",
    "format_error",
    "format_extension",
    "format_mime",
    "format_size",
    "format_time",
    "http_error",
    "http_ok",
    "last_block",
    "lenient_format",
    "merged_options",
    "missing_sink_fields",
    "native_options",
    "normalize_format",
    "out_of_range_options",
    "parse_page_list",
    "png_effort",
    "range_response",
    "request_id_pack",
    "request_seq",
    "request_task",
    "short_name",
    "sink_key",
    "sink_path",
    "size_in_mb",
    "strip_pdf",
]
