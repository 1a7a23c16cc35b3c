"""Workloads over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscale.constants import ERROR_PREFIXES
from folioscale.functions import (
    base_name,
    block_fetch_size,
    block_offset,
    block_range_header,
    classify_input,
    convert_options,
    decode_component,
    encode_component,
    format_bytes,
    format_duration,
    format_error,
    format_extension,
    format_mime,
    format_size,
    format_time,
    http_error,
    http_ok,
    lenient_format,
    merged_options,
    missing_sink_fields,
    native_options,
    normalize_format,
    out_of_range_options,
    parse_page_list,
    range_response,
    request_id_pack,
    request_seq,
    request_task,
    short_name,
    sink_key,
    sink_path,
    strip_pdf,
)
from folioscale.functions.options import SINK_FIELDS
from workloads.registry import part, workload


@workload(
    "classify_input",
    """select doc_id, case when starts_with(input, 'http://') or starts_with(input, 'https://')
              then 'url' else 'file' end as input_type from fx_documents""",
    ("fx_documents",),
)
def _(t):
    return t.fx_documents.select("doc_id", classify_input("input").alias("input_type"))


@workload(
    "validate_format",
    """select doc_id, case when lower(format_raw) in ('webp', 'png', 'jpg', 'jpeg') then lower(format_raw) end as format,
              case when lower(format_raw) not in ('webp', 'png', 'jpg', 'jpeg')
                   then 'Unsupported format: ' || format_raw || '. Supported formats: webp, png, jpg, jpeg' end as error
       from fx_documents""",
    ("fx_documents",),
)
def _(t):
    return t.fx_documents.select(
        "doc_id", normalize_format("format_raw").alias("format"), format_error("format_raw").alias("error")
    )


@workload(
    "lenient_format",
    """select doc_id, case lower(format_raw) when 'png' then 'png' when 'jpg' then 'jpg' when 'jpeg' then 'jpg'
              else 'webp' end as format from fx_documents""",
    ("fx_documents",),
)
def _(t):
    return t.fx_documents.select("doc_id", lenient_format("format_raw").alias("format"))


@workload(
    "format_extension",
    "select doc_id, replace(lower(format_raw), 'jpeg', 'jpg') as extension from fx_documents",
    ("fx_documents",),
)
def _(t):
    return t.fx_documents.select("doc_id", format_extension(F.lower("format_raw")).alias("extension"))


@workload(
    "format_mime",
    """select doc_id, case when lower(format_raw) = 'png' then 'image/png'
              when lower(format_raw) in ('jpg', 'jpeg') then 'image/jpeg' else 'image/webp' end as mime
       from fx_documents""",
    ("fx_documents",),
)
def _(t):
    return t.fx_documents.select("doc_id", format_mime(F.lower("format_raw")).alias("mime"))


@workload(
    "missing_sink_fields",
    """select job_id, concat_ws(',', case when coalesce(secret_id, '') = '' then 'secret_id' end,
              case when coalesce(secret_key, '') = '' then 'secret_key' end,
              case when coalesce(bucket, '') = '' then 'bucket' end,
              case when coalesce(region, '') = '' then 'region' end) as missing
       from fx_sink_configs""",
    ("fx_sink_configs",),
)
def _(t):
    missing = missing_sink_fields({name: F.lit(None).cast("string") for name in SINK_FIELDS})
    return t.fx_sink_configs.select("job_id", F.array_join(missing, ",").alias("missing"))


@workload(
    "range_response",
    """select page_id, status, case when status = 206 then range_start end as range_start,
              case when status = 206 then range_end end as range_end,
              case status when 206 then range_end - range_start + 1 when 200 then file_size end as content_length
       from x_range""",
    ("x_range",),
)
def _(t):
    answer = range_response("found", "method", "range_header", "file_size")
    return t.fx_range_requests.select("page_id", answer.alias("answer")).select("page_id", "answer.*")


part(
    "x_range",
    """select page_id, file_size,
              cast(case when not found then 404 when method = 'HEAD' then 200
                        when coalesce(range_header, '') <> '' then 206 else 200 end as int) as status,
              try_cast(split_part(replace(range_header, 'bytes=', ''), '-', 1) as bigint) as range_start,
              coalesce(try_cast(nullif(split_part(range_header, '-', 2), '') as bigint), file_size - 1) as range_end
       from fx_range_requests""",
    ("fx_range_requests",),
)


@workload(
    "http_ok",
    """select page_id, status between 200 and 299 as accepted, status = 206 as accepted_as_range,
              case when status = 404 then 'Failed to download file: 404 Not Found' end as download_error,
              case when status = 404 then 'Failed to get file size: 404 Not Found'
                   when page_id % 2 = 0 then 'Server did not return Content-Length header' end as probe_error
       from x_range""",
    ("x_range",),
)
def _(t):
    status = range_response("found", "method", "range_header", "file_size")["status"]
    log = t.fx_range_requests.select("page_id", status.alias("status"), "file_size").withColumns(
        {
            "reason": F.when(F.col("status") == 404, "Not Found").otherwise("OK"),
            "length": F.when(F.col("page_id") % 2 == 1, F.col("file_size")),
        }
    )
    return log.select(
        "page_id",
        http_ok("status").alias("accepted"),
        http_ok("status", ranged=True).alias("accepted_as_range"),
        http_error("status", "reason").alias("download_error"),
        http_error("status", "reason", "length").alias("probe_error"),
    )


@workload(
    "resolve_options",
    """select job_id,
          case when lower(coalesce(format, 'webp')) in ('webp', 'png', 'jpg', 'jpeg')
               then lower(coalesce(format, 'webp')) end as convert_format,
          coalesce(target_width, 1280) as convert_target_width,
          coalesce(detect_scan, false) as convert_detect_scan,
          coalesce(nullif(webp_quality, 0), nullif(quality, 0), 80) as convert_webp_quality,
          coalesce(webp_method, 4) as convert_webp_method,
          coalesce(nullif(jpeg_quality, 0), nullif(quality, 0), 85) as convert_jpeg_quality,
          coalesce(png_compression, 6) as convert_png_compression,
          coalesce(format, 'webp') as merged_format,
          coalesce(target_width, 1280) as merged_target_width,
          coalesce(detect_scan, true) as merged_detect_scan,
          coalesce(webp_quality, quality, 80) as merged_webp_quality,
          coalesce(jpeg_quality, quality, 85) as merged_jpeg_quality,
          case lower(format) when 'png' then 'png' when 'jpg' then 'jpg' when 'jpeg' then 'jpg'
               else 'webp' end as native_format,
          coalesce(detect_scan, true) as native_detect_scan,
          coalesce(webp_quality, quality, 80) as native_webp_quality,
          coalesce(jpeg_quality, quality, 80) as native_jpeg_quality,
          cast(1024 as int) as native_scan_width,
          case when coalesce(png_compression, 6) <= 3 then 'fast' when coalesce(png_compression, 6) <= 6 then 'default'
               else 'best' end as native_png_effort,
          concat_ws(',', case when webp_quality > 70 then 'webp_quality' end,
                    case when png_compression > 9 then 'png_compression' end) as over_limit
       from (select * from fx_job_options)""",
    ("fx_job_options",),
)
def _(t):
    resolved = t.fx_job_options.select(
        "job_id",
        convert_options().alias("convert"),
        merged_options().alias("merged"),
        native_options().alias("native"),
        out_of_range_options(webp_quality=(0, 70)).alias("over_limit"),
    )
    wanted = {
        "convert": ["format", "target_width", "detect_scan", "webp_quality", "webp_method", "jpeg_quality", "png_compression"],
        "merged": ["format", "target_width", "detect_scan", "webp_quality", "jpeg_quality"],
        "native": ["format", "detect_scan", "webp_quality", "jpeg_quality", "scan_width", "png_effort"],
    }
    columns = [F.col(f"{path}.{name}").alias(f"{path}_{name}") for path, names in wanted.items() for name in names]
    return resolved.select("job_id", *columns, F.array_join("over_limit", ",").alias("over_limit"))


@workload(
    "png_effort",
    """select job_id, case when png_compression <= 3 then 'fast' when png_compression <= 6 then 'default' else 'best' end
              as effort from (select job_id, coalesce(png_compression, 6) as png_compression from fx_job_options)""",
    ("fx_job_options",),
)
def _(t):
    return t.fx_job_options.select("job_id", native_options()["png_effort"].alias("effort"))


@workload(
    "parse_page_list",
    """select job_id, cast(row_number() over (partition by job_id order by nth) - 1 as int) as idx, page
       from (select job_id, nth, try_cast(regexp_extract(item, '^\\s*([+-]?[0-9]+)', 1) as bigint) as page
             from (select job_id, unnest(string_split(pages, ',')) as item,
                          generate_subscripts(string_split(pages, ','), 1) as nth from fx_page_lists))
       where page > 0""",
    ("fx_page_lists",),
)
def _(t):
    return t.fx_page_lists.select("job_id", F.posexplode(parse_page_list("pages")).alias("idx", "page"))


def _units(size: str, digits: int) -> str:
    """Oracle text for sizes: half-up in wide integers, zeros trimmed or not."""
    def text(unit: str, name: str) -> str:
        scaled = f"((cast({size} as hugeint) * {10 ** digits} + {unit} // 2) // {unit})"
        number = f"printf('%d.%0{digits}d', cast({scaled} // {10 ** digits} as bigint), cast({scaled} % {10 ** digits} as bigint))"
        return f"{number} || ' {name}'" if digits == 1 else f"rtrim(rtrim({number}, '0'), '.') || ' {name}'"

    top = f"when {size} >= 1073741824 then {text('1073741824', 'GB')} " if digits == 2 else ""
    return (
        f"case when {size} < 1024 then cast({size} as varchar) || ' B' {top}"
        f"when {size} >= 1048576 then {text('1048576', 'MB')} else {text('1024', 'KB')} end"
    )


@workload(
    "format_bytes",
    f"select doc_id, {_units('a', 2)} as small, {_units('b', 2)} as medium, {_units('c', 2)} as large from x_sizes",
    ("x_sizes",),
)
def _(t):
    return _sizes(t).select("doc_id", *[format_bytes(c).alias(n) for c, n in _SIZES.items()])


@workload(
    "format_size",
    f"select doc_id, {_units('a', 1)} as small, {_units('b', 1)} as medium, {_units('c', 1)} as large from x_sizes",
    ("x_sizes",),
)
def _(t):
    return _sizes(t).select("doc_id", *[format_size(c).alias(n) for c, n in _SIZES.items()])


_SIZES = {"a": "small", "b": "medium", "c": "large"}
part(
    "x_sizes",
    "select doc_id, size_bytes % 2048 * 8 as a, size_bytes as b, size_bytes * 977 as c from fx_documents",
    ("fx_documents",),
)


def _sizes(t):
    size = F.col("size_bytes")
    return t.fx_documents.select("doc_id", (size % 2048 * 8).alias("a"), size.alias("b"), (size * 977).alias("c"))


def _times(gap: str) -> str:
    return (
        f"case when ms < 1000 then cast(ms as varchar) || '{gap}ms' else "
        f"printf('%.2f', cast(ms + case when ms % 250 = 125 then 1 else 0 end as double) / 1000) || '{gap}s' end"
    )


part("x_times", "select file, format, total_ms % 30000 as ms from fx_bench_runs", ("fx_bench_runs",))


@workload("format_time", f"select file, format, {_times(' ')} as text from x_times", ("x_times",))
def _(t):
    return t.fx_bench_runs.select("file", "format", format_time(F.col("total_ms") % 30000).alias("text"))


@workload("format_duration", f"select file, format, {_times('')} as text from x_times", ("x_times",))
def _(t):
    return t.fx_bench_runs.select("file", "format", format_duration(F.col("total_ms") % 30000).alias("text"))


@workload(
    "sink_path",
    """select r.doc_id, page_num, 'out/' || r.doc_id || '/page_' || page_num || '.' ||
              replace(lower(format_raw), 'jpeg', 'jpg') as path
       from fx_page_requests r join fx_documents d on r.doc_id = d.doc_id""",
    ("fx_page_requests", "fx_documents"),
)
def _(t):
    folder = F.concat(F.lit("out/"), F.col("doc_id").cast("string"))
    pages = t.fx_page_requests.join(t.fx_documents, "doc_id")
    return pages.select(
        "doc_id", "page_num", sink_path(folder, F.lit("page"), "page_num", F.lower("format_raw")).alias("path")
    )


@workload(
    "sink_key",
    """select doc_id, page_num, 'docs/' || doc_id || '/page_' || page_num || '.webp' as sink_key
       from fx_page_requests""",
    ("fx_page_requests",),
)
def _(t):
    prefix = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    return t.fx_page_requests.select("doc_id", "page_num", sink_key(prefix, "page_num", F.lit("webp")).alias("sink_key"))


@workload(
    "strip_pdf",
    """select doc_id, regexp_replace(file_name, '\\.pdf', '') as name,
              regexp_replace(file_name || '.pdf', '\\.pdf', '') as doubled from fx_documents""",
    ("fx_documents",),
)
def _(t):
    doubled = F.concat("file_name", F.lit(".pdf"))
    return t.fx_documents.select("doc_id", strip_pdf("file_name").alias("name"), strip_pdf(doubled).alias("doubled"))


@workload(
    "base_name",
    """select doc_id, string_split(input, '/')[-1] as name, string_split(input, '/')[-1] as with_slash
       from fx_documents""",
    ("fx_documents",),
)
def _(t):
    slashed = F.concat("input", F.lit("/"))
    return t.fx_documents.select("doc_id", base_name("input").alias("name"), base_name(slashed).alias("with_slash"))


@workload(
    "short_name",
    """select doc_id, case when length(input) > 20 then left(input, 17) || '...' else input end as name
       from fx_documents""",
    ("fx_documents",),
)
def _(t):
    return t.fx_documents.select("doc_id", short_name("input").alias("name"))


def _component(text: str) -> str:
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        text = f"replace({text}, '{code}', '{char}')"
    return text


@workload(
    "encode_component",
    f"select doc_id, length(encoded) as size, md5(encoded) as digest "
    f"from (select doc_id, {_component('url_encode(text)')} as encoded from documents)",
)
def _(t):
    encoded = t.documents.select("doc_id", encode_component("text").alias("encoded"))
    return encoded.select("doc_id", F.length("encoded").cast("bigint").alias("size"), F.md5("encoded").alias("digest"))


@workload(
    "decode_component",
    "select doc_id, md5(text) as digest, md5(url_decode(replace(source, '+', '%2B'))) as source_digest from documents",
)
def _(t):
    return t.documents.select(
        "doc_id",
        F.md5(decode_component(encode_component("text"))).alias("digest"),
        F.md5(decode_component("source")).alias("source_digest"),
    )


@workload(
    "block_offset",
    "select task_id, seq, pos // 262144 * 262144 as block_offset from fx_block_reads",
    ("fx_block_reads",),
)
def _(t):
    return t.fx_block_reads.select("task_id", "seq", block_offset("pos").alias("block_offset"))


@workload(
    "block_fetch_size",
    """select task_id, seq, case when size > 0 then size end as fetch_size
       from (select task_id, seq, least(262144, file_size - 1000 - pos // 262144 * 262144) as size
             from fx_block_reads)""",
    ("fx_block_reads",),
)
def _(t):
    return t.fx_block_reads.select(
        "task_id", "seq", block_fetch_size("pos", F.col("file_size") - 1000).alias("fetch_size")
    )


@workload(
    "block_range_header",
    "select task_id, seq, 'bytes=' || pos || '-' || (pos + len - 1) as range_header from fx_block_reads",
    ("fx_block_reads",),
)
def _(t):
    return t.fx_block_reads.select("task_id", "seq", block_range_header("pos", "len").alias("range_header"))


@workload(
    "request_id_pack",
    "select task_id, seq, task_id % 65536 * 65536 + seq * 31 % 65536 as request_id from fx_block_reads",
    ("fx_block_reads",),
)
def _(t):
    return t.fx_block_reads.select("task_id", "seq", request_id_pack("task_id", F.col("seq") * 31).alias("request_id"))


@workload(
    "request_id_unpack",
    "select request_id, sent_ms, request_id // 65536 as task_id, request_id % 65536 as seq from fx_requests",
    ("fx_requests",),
)
def _(t):
    return t.fx_requests.select(
        "request_id", "sent_ms", request_task("request_id").alias("task_id"), request_seq("request_id").alias("seq")
    )


def error_class_sql(column: str) -> str:
    whens = " ".join(
        "when " + " or ".join(f"starts_with({column}, '{prefix}')" for prefix in prefixes) + f" then '{name}'"
        for name, prefixes in ERROR_PREFIXES
    )
    return f"case {whens} else 'other' end"
