"""Workloads over operators and composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscale.operators.bench import bench_pivot, bench_rollup
from folioscale.operators.cache import block_first_touch, blocks_of_read, cache_attribution, stream_stats
from folioscale.operators.correlate import correlate_requests, request_stats, unmatched_responses
from folioscale.operators.geometry import plan_page_size, scan_detection, side_limit
from folioscale.operators.numbering import numbered
from folioscale.operators.pages import (
    attach_options,
    expand_pages,
    first_n_existing,
    first_n_pages,
    format_matrix,
    invalid_page_audit,
    order_pages,
    valid_pages,
)
from folioscale.operators.render import (
    InspectedPage,
    RenderedPage,
    inspect_documents,
    inspected_documents,
    inspected_objects,
    inspected_pages,
    map_pages,
)
from folioscale.operators.results import (
    collect_pages,
    doc_rollup,
    error_rollup,
    job_summary,
    output_size_rollup,
    page_arrays,
    page_status_rows,
    result_arrays,
    success_averages,
)
from folioscale.plans.conversion import conversion_plan, conversion_report, page_plan, rejected_documents
from folioscale.plans.reports import bench_report, trace_report
from folioscale.sources.corpus import corpus_listing, doc_info, scan_buffers
from workloads.column_queries import _times, _units, error_class_sql
from workloads.registry import part, workload

# --- sources and sinks -------------------------------------------------------


def _with_place(ordered):
    """Number the rows as they come, so that SQL can check their order."""
    return numbered(ordered.withColumn("at", F.monotonically_increasing_id()), [], ["at"], "place").drop("at")


@workload(
    "corpus_listing",
    "select doc_id, file_name, size_bytes, row_number() over (order by size_bytes, doc_id) - 1 as place from fx_documents",
    ("fx_documents",),
)
def _(t):
    return _with_place(corpus_listing(t.fx_documents.select("doc_id", "file_name", "size_bytes")))


@workload(
    "doc_info",
    """select doc_id, string_split(input, '/')[-1] as base_name,
              printf('%d.%02d', cast(h // 100 as bigint), cast(h % 100 as bigint)) || ' MB' as size, num_pages
       from (select *, (size_bytes * 100 + 524288) // 1048576 as h from fx_documents)""",
    ("fx_documents",),
)
def _(t):
    return doc_info(t.fx_documents)


@workload(
    "scan_buffers",
    """select doc_id, 'buffer' as input_type, octet_length(encode(text)) as size_bytes, md5(text) as digest
       from documents""",
)
def _(t):
    buffers = scan_buffers(t.documents, "doc_id", F.encode("text", "utf-8"))
    return buffers.withColumn("digest", F.md5("content")).drop("content")


@workload(
    "collect_pages",
    """select doc_id, page_num, width, height, success, case when success then size_bytes end as size_bytes, error,
              row_number() over (order by doc_id, page_num) - 1 as place
       from fx_page_results""",
    ("fx_page_results",),
)
def _(t):
    return _with_place(collect_pages(t.fx_page_results, "size_bytes"))


@workload(
    "output_size_rollup",
    """select r.doc_id, lower(format_raw) as format, cast(sum(r.size_bytes) as bigint) as output_bytes,
              count(r.size_bytes) as files
       from fx_page_results r join fx_documents d on r.doc_id = d.doc_id group by r.doc_id, lower(format_raw)""",
    ("fx_page_results", "fx_documents"),
)
def _(t):
    formats = t.fx_documents.select("doc_id", F.lower("format_raw").alias("format"))
    return output_size_rollup(t.fx_page_results.join(formats, "doc_id"))


# --- page selection ----------------------------------------------------------

part(
    "x_expanded",
    """select doc_id, cast(unnest(range(1, num_pages + 1)) as int) as page_num from fx_documents d
       where not exists (select 1 from fx_page_requests r where r.doc_id = d.doc_id)
       union all
       select r.doc_id, r.page_num from fx_page_requests r join fx_documents d on r.doc_id = d.doc_id
       where r.page_num >= 1 and r.page_num <= d.num_pages""",
    ("fx_documents", "fx_page_requests"),
)


@workload("expand_pages", "select doc_id, page_num from x_expanded", ("x_expanded",))
def _(t):
    docs = t.fx_documents.select("doc_id", "num_pages")
    return expand_pages(docs, t.fx_page_requests).select("doc_id", "page_num")


@workload(
    "valid_pages",
    """select r.doc_id, r.page_num from fx_page_requests r join fx_documents d on r.doc_id = d.doc_id
       where r.page_num between 1 and d.num_pages""",
    ("fx_page_requests", "fx_documents"),
)
def _(t):
    requested = t.fx_page_requests.join(t.fx_documents.select("doc_id", "num_pages"), "doc_id")
    return valid_pages(requested).select("doc_id", "page_num")


@workload(
    "order_pages",
    "select doc_id, page_num, success, row_number() over (order by doc_id, page_num) - 1 as place from fx_page_results",
    ("fx_page_results",),
)
def _(t):
    return _with_place(order_pages(t.fx_page_results.select("doc_id", "page_num", "success")))


@workload(
    "invalid_page_audit",
    """select r.doc_id, r.page_num, coalesce(num_pages, 0) as num_pages,
              r.page_num >= 1 and r.page_num <= coalesce(num_pages, 0) as valid,
              case when r.page_num < 1 or r.page_num > coalesce(num_pages, 0) then
                   'Invalid page number: ' || r.page_num || ' (total: ' || coalesce(num_pages, 0) || ')' end as error
       from fx_page_requests r left join fx_documents d on r.doc_id = d.doc_id""",
    ("fx_page_requests", "fx_documents"),
)
def _(t):
    return invalid_page_audit(t.fx_documents, t.fx_page_requests)


@workload(
    "attach_options",
    """select doc_id, d.job_id, target_width, quality, webp_quality, detect_scan
       from fx_documents d left join fx_job_options o on d.job_id = o.job_id""",
    ("fx_documents", "fx_job_options"),
)
def _(t):
    options = t.fx_job_options.select("job_id", "target_width", "quality", "webp_quality", "detect_scan")
    return attach_options(t.fx_documents.select("doc_id", "job_id"), options)


@workload(
    "format_matrix",
    """select doc_id, file_name, format from fx_documents, (values ('webp'), ('png'), ('jpg')) f(format)""",
    ("fx_documents",),
)
def _(t):
    return format_matrix(t.fx_documents.select("doc_id", "file_name"))


@workload(
    "first_n_pages",
    """select doc_id, cast(unnest(range(1, least(num_pages, 5) + 1)) as int) as page_num from fx_documents""",
    ("fx_documents",),
)
def _(t):
    return first_n_pages(t.fx_documents, 5).select("doc_id", "page_num")


@workload(
    "first_n_existing_pages",
    """select doc_id, page_num, width_pt from (select doc_id, page_num, cast(width_pt as double) as width_pt,
              row_number() over (partition by doc_id order by page_num) as rn from fx_page_geometry) where rn <= 3""",
    ("fx_page_geometry",),
)
def _(t):
    pages = t.fx_page_geometry.select("doc_id", "page_num", F.col("width_pt").cast("double").alias("width_pt"))
    return first_n_existing(pages, 3)


# --- sizes -------------------------------------------------------------------

part(
    "x_scans",
    """select doc_id, page_num, count(*) filter (object_type = 'Text') as text_objects,
              count(*) filter (object_type = 'Image') as image_objects
       from fx_page_objects group by doc_id, page_num""",
    ("fx_page_objects",),
)


@workload(
    "scan_detection",
    """select doc_id, page_num, text_objects, image_objects, text_objects = 0 and image_objects > 0 as is_scan
       from x_scans""",
    ("x_scans",),
)
def _(t):
    return scan_detection(t.fx_page_objects)


def _sized(source: str) -> str:
    """Oracle text: add width and height to rows with w, h, target and lim."""
    scaled = f"select *, least(cast(cast(target as float) / w as float), cast(4 as float)) as scale from ({source})"
    first = (
        f"select *, cast(round(cast(w * scale as float)) as bigint) as pw, "
        f"cast(round(cast(h * scale as float)) as bigint) as ph from ({scaled})"
    )
    excess = "case when {0} > lim then cast(cast(lim as float) / cast({0} as float) as float) else cast(1 as float) end"
    shrunk = f"select *, cast(scale * least({excess.format('pw')}, {excess.format('ph')}) as float) as final from ({first})"
    return (
        f"select *, case when greatest(pw, ph) > lim then cast(round(cast(w * final as float)) as int) "
        f"else cast(pw as int) end as width, case when greatest(pw, ph) > lim "
        f"then cast(round(cast(h * final as float)) as int) else cast(ph as int) end as height from ({shrunk})"
    )


def _size_source(limit: str) -> str:
    return (
        "select g.doc_id, g.page_num, width_pt as w, height_pt as h, "
        "case when text_objects = 0 and image_objects > 0 then 1024 else 1280 end as target, "
        f"{limit} as lim from fx_page_geometry g join x_scans s on g.doc_id = s.doc_id and g.page_num = s.page_num"
    )


part("x_webp_sizes", _sized(_size_source("16383")), ("fx_page_geometry", "x_scans"))
part("x_raw_sizes", _sized(_size_source("32767")), ("fx_page_geometry", "x_scans"))


@workload(
    "plan_page_size",
    """select e.doc_id, e.page_num, e.width, e.height, r.width as raw_width, r.height as raw_height
       from x_webp_sizes e join x_raw_sizes r on e.doc_id = r.doc_id and e.page_num = r.page_num""",
    ("x_webp_sizes", "x_raw_sizes"),
)
def _(t):
    pages = t.fx_page_geometry.join(scan_detection(t.fx_page_objects), ["doc_id", "page_num"])
    webp = F.lit("webp")
    encoded = plan_page_size(pages, side_limit(webp, "encoded"))
    both = plan_page_size(
        encoded.withColumnsRenamed({"width": "encoded_width", "height": "encoded_height"}), side_limit(webp, "raw")
    )
    return both.select(
        "doc_id",
        "page_num",
        F.col("encoded_width").alias("width"),
        F.col("encoded_height").alias("height"),
        F.col("width").alias("raw_width"),
        F.col("height").alias("raw_height"),
    )


# --- results -----------------------------------------------------------------


@workload(
    "page_status_rows",
    """select doc_id, page_num, ok as success, case when ok then null else coalesce(error, 'Render failed') end as error,
              case when ok then 1280 else 0 end as width, case when ok then height + 7 else 0 end as height,
              case when ok then size_bytes end as size_bytes, coalesce(render_ms, 0) as render_ms,
              case when ok then coalesce(encode_ms, 0) else 0 end as encode_ms
       from (select *, success and page_num % 4 <> 0 as ok from fx_page_results)""",
    ("fx_page_results",),
)
def _(t):
    raw = t.fx_page_results.withColumns(
        {
            "success": F.col("success") & (F.col("page_num") % 4 != 0),
            "width": F.lit(1280),
            "height": F.col("height") + 7,
        }
    )
    return page_status_rows(raw)


part(
    "x_rollup",
    """select doc_id, count(*) as pages, count(*) filter (success) as rendered_pages,
              cast(sum(coalesce(size_bytes, 0)) as bigint) as output_bytes,
              cast(sum(coalesce(render_ms, 0)) as bigint) as render_ms,
              cast(sum(coalesce(encode_ms, 0)) as bigint) as encode_ms
       from fx_page_results group by doc_id""",
    ("fx_page_results",),
)


@workload(
    "doc_rollup",
    "select *, true as success, rendered_pages = pages as all_pages_ok from x_rollup",
    ("x_rollup",),
)
def _(t):
    return doc_rollup(t.fx_page_results)


@workload(
    "page_arrays",
    """select doc_id, page_num // 3 as part, count(*) as entries, min(page_num) as first_page, max(page_num) as last_page,
              string_agg(page_num || ':' || coalesce(size_bytes, -1), ',' order by page_num) as pages
       from (select doc_id, page_num - 1 as page_num, size_bytes from fx_page_results) group by doc_id, page_num // 3""",
    ("fx_page_results",),
)
def _(t):
    def shown(page):
        return F.concat((page["page_num"] - 1).cast("string"), F.lit(":"), F.coalesce(page["size_bytes"], F.lit(-1)).cast("string"))

    number = F.transform("pages", lambda page: page["page_num"] - 1)
    return page_arrays(t.fx_page_results, 3).select(
        "doc_id",
        "part",
        F.size("pages").cast("bigint").alias("entries"),
        F.array_min(number).alias("first_page"),
        F.array_max(number).alias("last_page"),
        F.array_join(F.transform("pages", shown), ",").alias("pages"),
    )


_RESULT = "page_num, success, error, width, height, size_bytes, render_ms, encode_ms"


@workload(
    "result_arrays",
    f"""select doc_id, position // 7 as part, count(*) as entries,
              string_agg(page_num || ':' || coalesce(size_bytes, -1) || '*' || copies, ',' order by position) as pages
       from (select *, row_number() over (partition by doc_id order by {', '.join(f'{name} nulls first' for name in _RESULT.split(', '))}) - 1 as position
             from (select doc_id % 50 as doc_id, {_RESULT}, count(*) as copies from fx_page_results group by all))
       group by doc_id, position // 7""",
    ("fx_page_results",),
)
def _(t):
    def shown(page):
        size = F.coalesce(page["size_bytes"], F.lit(-1)).cast("string")
        return F.concat(page["page_num"].cast("string"), F.lit(":"), size, F.lit("*"), page["copies"].cast("string"))

    # Documents of very many pages with very many results each.
    results = t.fx_page_results.withColumn("doc_id", F.col("doc_id") % 50)
    return result_arrays(results, 7).select(
        "doc_id",
        "part",
        F.size("pages").cast("bigint").alias("entries"),
        F.array_join(F.transform("pages", shown), ",").alias("pages"),
    )


@workload(
    "job_summary",
    """select format, documents, complete_documents, pages, rendered_pages, output_bytes, total_ms,
              case when rendered_pages > 0 then (2 * total_ms + rendered_pages) // (2 * rendered_pages) end as avg_ms_per_page
       from (select lower(format_raw) as format, count(*) as documents,
                    count(*) filter (rendered_pages = pages) as complete_documents,
                    cast(sum(pages) as bigint) as pages, cast(sum(rendered_pages) as bigint) as rendered_pages,
                    cast(sum(output_bytes) as bigint) as output_bytes,
                    cast(sum(render_ms + encode_ms) as bigint) as total_ms
             from x_rollup r join fx_documents d on r.doc_id = d.doc_id group by lower(format_raw))""",
    ("x_rollup", "fx_documents"),
)
def _(t):
    formats = t.fx_documents.select("doc_id", F.lower("format_raw").alias("format"))
    return job_summary(doc_rollup(t.fx_page_results).join(formats, "doc_id"), ["format"])


@workload(
    "success_averages",
    """select page_num, count(*) filter (success) as rendered_pages,
              avg(coalesce(render_ms, 0)) filter (success) as avg_render_ms,
              avg(coalesce(encode_ms, 0)) filter (success) as avg_encode_ms
       from fx_page_results group by page_num""",
    ("fx_page_results",),
)
def _(t):
    return success_averages(t.fx_page_results, ["page_num"])


@workload(
    "error_rollup",
    f"""select {error_class_sql('error')} as error_class, count(*) as failures
        from fx_page_results where not success group by 1""",
    ("fx_page_results",),
)
def _(t):
    return error_rollup(t.fx_page_results)


# Failures of every kind, by document and page.
_FAILURES = """case (doc_id + page_num) % 14
         when 0 then 'Failed to load PDF: FormatError' when 1 then 'File not found or not readable: /a.pdf'
         when 2 then 'Invalid page number: 9 (total: 3)' when 3 then 'Failed to get page 3: Unknown'
         when 4 then 'Failed to render page: Unknown' when 5 then 'PNG encoding failed: memory'
         when 6 then 'WebP encoding failed: memory' when 7 then 'File save failed: disk is full'
         when 8 then 'Upload failed: timeout' when 9 then 'PDFium library not available'
         when 10 then 'Native renderer not available in worker thread' when 11 then 'upload failed: other case'
         when 12 then '' end"""


@workload(
    "error_classes",
    f"""select case when starts_with(error, 'Failed to load PDF') or starts_with(error, 'File not found or not readable') then 'load'
                   when starts_with(error, 'Invalid page number') then 'page-range'
                   when starts_with(error, 'Failed to get page') then 'page-fetch'
                   when starts_with(error, 'Failed to render page') then 'render'
                   when starts_with(error, 'PNG encoding failed') or starts_with(error, 'WebP encoding failed') then 'encode'
                   when starts_with(error, 'File save failed') then 'save'
                   when starts_with(error, 'Upload failed') then 'upload'
                   when starts_with(error, 'PDFium library not available') or starts_with(error, 'Native renderer not available') then 'unavailable'
                   else 'other' end as error_class, count(*) as failures
        from (select {_FAILURES} as error from fx_page_requests) group by 1""",
    ("fx_page_requests",),
)
def _(t):
    return error_rollup(t.fx_page_requests.select(F.lit(False).alias("success"), F.expr(_FAILURES).alias("error")))


# --- timing tables -----------------------------------------------------------


@workload(
    "bench_rollup",
    """select file, format, max(file_size) as file_size, cast(sum(total_ms) as bigint) as total_ms,
              cast(sum(output_bytes) as bigint) as output_bytes, cast(sum(pages) as bigint) as pages,
              cast(sum(total_ms) as double) / nullif(sum(pages), 0) as ms_per_page
       from fx_bench_runs group by file, format""",
    ("fx_bench_runs",),
)
def _(t):
    return bench_rollup(t.fx_bench_runs)


def _pivot_column(name: str) -> str:
    return f"coalesce((select {_times(' ')} from (select total_{name} as ms) where ms is not null), '-') as {name}"


part(
    "x_pivot",
    """select file, max(file_size) as file_size, cast(max(pages) as int) as pages,
              cast(sum(total_ms) filter (format = 'webp') as bigint) as total_webp,
              cast(sum(total_ms) filter (format = 'png') as bigint) as total_png,
              cast(sum(total_ms) filter (format = 'jpg') as bigint) as total_jpg
       from fx_bench_runs group by file""",
    ("fx_bench_runs",),
)
_PIVOT_TEXTS = ", ".join(_pivot_column(name) for name in ("webp", "png", "jpg"))


@workload("bench_pivot", f"select file, file_size, pages, {_PIVOT_TEXTS} from x_pivot", ("x_pivot",))
def _(t):
    return bench_pivot(t.fx_bench_runs)


@workload(
    "bench_report",
    f"""select case when length(file) > 20 then left(file, 17) || '...' else file end as file,
               {_units('file_size', 1)} as size, pages, {_PIVOT_TEXTS} from x_pivot""",
    ("x_pivot",),
)
def _(t):
    return bench_report(t.fx_bench_runs)


# --- byte-range reads --------------------------------------------------------

part(
    "x_touches",
    """select task_id, seq, block * 262144 as block_offset, least(262144, file_size - block * 262144) as fetch_size
       from (select task_id, seq, file_size,
                    unnest(range(pos // 262144, (least(pos + len, file_size) - 1) // 262144 + 1)) as block
             from fx_block_reads where pos < file_size and len > 0)""",
    ("fx_block_reads",),
)


@workload("blocks_of_read", "select task_id, seq, block_offset, fetch_size from x_touches", ("x_touches",))
def _(t):
    return blocks_of_read(t.fx_block_reads)


@workload(
    "block_first_touch",
    """select task_id, block_offset, seq as first_seq from (select *, row_number() over
              (partition by task_id, block_offset order by seq) as rn from x_touches) where rn = 1""",
    ("x_touches",),
)
def _(t):
    return block_first_touch(t.fx_block_reads)


part(
    "x_numbered",
    "select *, row_number() over (partition by task_id order by seq, block_offset) as rn from x_touches",
    ("x_touches",),
)
part(
    "x_linked",
    """select *, lag(rn) over (partition by task_id, block_offset order by rn) as prev,
              coalesce(lead(rn) over (partition by task_id, block_offset order by rn), 9223372036854775807) as next
       from x_numbered""",
    ("x_numbered",),
)
part(
    "x_attributed",
    """select i.task_id, i.seq, i.block_offset, i.prev is not null and count(j.rn) < 64 as hit, i.fetch_size
       from x_linked i left join x_linked j
         on j.task_id = i.task_id and j.rn > i.prev and j.rn < i.rn and j.next > i.rn
       group by i.task_id, i.seq, i.block_offset, i.prev, i.fetch_size""",
    ("x_linked",),
)


@workload(
    "cache_attribution",
    """select task_id, seq, block_offset, hit, case when hit then 0 else fetch_size end as fetched_bytes
       from x_attributed""",
    ("x_attributed",),
)
def _(t):
    return cache_attribution(t.fx_block_reads)


part(
    "x_stats",
    """select task_id, count(*) filter (not hit) as total_requests, count(*) filter (hit) as cache_hits,
              count(*) filter (not hit) as cache_misses,
              cast(sum(case when hit then 0 else fetch_size end) as bigint) as total_bytes_fetched
       from x_attributed group by task_id""",
    ("x_attributed",),
)


@workload("stream_stats", "select * from x_stats", ("x_stats",))
def _(t):
    return stream_stats(cache_attribution(t.fx_block_reads))


@workload(
    "trace_report",
    f"""select *, cast(cache_hits as double) / nullif(cache_hits + cache_misses, 0) as hit_rate,
               {_units('total_bytes_fetched', 2)} as fetched from x_stats""",
    ("x_stats",),
)
def _(t):
    return trace_report(t.fx_block_reads)


# --- request logs ------------------------------------------------------------

part(
    "x_matched",
    """select q.request_id, q.sent_ms, r.recv_ms, r.ok, r.bytes,
              row_number() over (partition by q.request_id, q.sent_ms
                                 order by r.recv_ms, not r.ok, coalesce(r.bytes, -1) desc) as rn
       from (select request_id, sent_ms, lead(sent_ms) over (partition by request_id order by sent_ms) as next_ms
             from (select distinct request_id, sent_ms from fx_requests) once) q
       left join (select request_id, recv_ms, coalesce(ok, false) as ok, bytes from fx_responses) r
         on r.request_id = q.request_id and r.recv_ms between q.sent_ms and q.sent_ms + 30000
            and (q.next_ms is null or r.recv_ms < q.next_ms)""",
    ("fx_requests", "fx_responses"),
)


@workload(
    "correlate_requests",
    """select request_id, sent_ms, recv_ms, bytes,
              case when ok is null then 'timeout' when ok then 'ok' else 'error' end as status
       from x_matched where rn = 1""",
    ("x_matched",),
)
def _(t):
    return correlate_requests(t.fx_requests, t.fx_responses)


@workload(
    "unmatched_responses",
    """select request_id, recv_ms, coalesce(ok, false) as ok, bytes from fx_responses except all
       select distinct request_id, recv_ms, ok, bytes from x_matched where rn = 1 and recv_ms is not null""",
    ("x_matched",),
)
def _(t):
    return unmatched_responses(t.fx_requests, t.fx_responses)


@workload(
    "request_stats",
    """select request_id // 65536 as task_id, count(*) as requests, count(*) filter (ok) as ok,
              count(*) filter (not ok) as errors, count(*) filter (ok is null) as timeouts,
              cast(coalesce(sum(bytes) filter (ok), 0) as bigint) as bytes
       from x_matched where rn = 1 group by request_id // 65536""",
    ("x_matched",),
)
def _(t):
    return request_stats(correlate_requests(t.fx_requests, t.fx_responses))


# --- conversion --------------------------------------------------------------

part(
    "x_settings",
    """select d.doc_id, d.input, lower(d.format_raw) as format, coalesce(o.target_width, 1280) as target_width,
              coalesce(o.detect_scan, false) as detect_scan, coalesce(o.webp_method, 4) as webp_method,
              case lower(d.format_raw) when 'webp' then coalesce(nullif(o.webp_quality, 0), nullif(o.quality, 0), 80)
                   when 'png' then coalesce(o.png_compression, 6)
                   else coalesce(nullif(o.jpeg_quality, 0), nullif(o.quality, 0), 85) end as quality
       from fx_documents d left join fx_job_options o on d.job_id = o.job_id
       where lower(d.format_raw) in ('webp', 'png', 'jpg', 'jpeg')""",
    ("fx_documents", "fx_job_options"),
)
part(
    "x_plan",
    _sized(
        """select e.doc_id, e.page_num, s.input, s.format, s.quality, s.webp_method,
                  s.detect_scan and coalesce(c.text_objects = 0 and c.image_objects > 0, false) as as_scan,
                  case when s.detect_scan and coalesce(c.text_objects = 0 and c.image_objects > 0, false)
                       then 1024 else s.target_width end as target,
                  coalesce(g.width_pt, cast(612 as float)) as w, coalesce(g.height_pt, cast(792 as float)) as h,
                  case when s.format = 'webp' then 16383 else 32767 end as lim
           from x_expanded e join x_settings s on e.doc_id = s.doc_id
           left join x_scans c on c.doc_id = e.doc_id and c.page_num = e.page_num
           left join fx_page_geometry g on g.doc_id = e.doc_id and g.page_num = e.page_num"""
    ),
    ("x_expanded", "x_settings", "x_scans", "fx_page_geometry"),
)


def _inputs(t):
    return t.fx_documents, t.fx_page_requests, t.fx_page_objects, t.fx_page_geometry, t.fx_job_options


_PLAN_COLUMNS = """input, case when starts_with(input, 'http://') or starts_with(input, 'https://')
              then 'url' else 'file' end as input_type, format, as_scan, width, height, quality, webp_method,
              'pages/' || doc_id || '/page_' || page_num || '.' || replace(format, 'jpeg', 'jpg') as sink_key"""


@workload(
    "page_plan",
    f"""select doc_id, page_num, copies, {_PLAN_COLUMNS}
        from (select doc_id, page_num, input, format, as_scan, width, height, quality, webp_method, count(*) as copies
              from x_plan group by all)""",
    ("x_plan",),
)
def _(t):
    return page_plan(*_inputs(t))


@workload("conversion_plan", f"select doc_id, page_num, {_PLAN_COLUMNS} from x_plan", ("x_plan",))
def _(t):
    return conversion_plan(*_inputs(t))


@workload(
    "rejected_documents",
    """select doc_id, format_raw, 'Unsupported format: ' || format_raw || '. Supported formats: webp, png, jpg, jpeg' as error
       from fx_documents where lower(format_raw) not in ('webp', 'png', 'jpg', 'jpeg')""",
    ("fx_documents",),
)
def _(t):
    return rejected_documents(t.fx_documents)


@workload(
    "conversion_report",
    f"""select doc_id, planned_pages, planned_pixels, rendered_pages, rendered_pages = planned_pages as all_pages_ok,
               output_bytes, {_units('output_bytes', 2)} as output_size, total_ms,
               case when rendered_pages > 0 then (2 * total_ms + rendered_pages) // (2 * rendered_pages) end as avg_ms_per_page
        from (select p.doc_id, count(*) as planned_pages, cast(sum(cast(p.width as bigint) * p.height) as bigint) as planned_pixels,
                     count(*) filter (r.success) as rendered_pages,
                     cast(sum(coalesce(r.size_bytes, 0)) as bigint) as output_bytes,
                     cast(sum(coalesce(r.render_ms, 0) + coalesce(r.encode_ms, 0)) as bigint) as total_ms
              from x_plan p left join fx_page_results r on r.doc_id = p.doc_id and r.page_num = p.page_num
              group by p.doc_id)""",
    ("x_plan", "fx_page_results"),
)
def _(t):
    return conversion_report(*_inputs(t), t.fx_page_results)


class StubRenderer:
    """Stands in for a PDF renderer: sizes follow from the plan, some pages
    and documents fail, so that every outcome occurs."""

    def open(self, source):
        if source.endswith("3.pdf"):
            raise ValueError("FormatError")
        return source

    def render(self, document, page):
        if page["page_num"] % 5 == 0:
            raise RuntimeError("Failed to render page: stub")
        size = (page["width"] * 31 + page["height"]) % 997 + 1
        return RenderedPage(b"\0" * size, page["width"], page["height"], render_ms=page["page_num"])

    def close(self, document):
        pass


@workload(
    "map_pages",
    """select doc_id, page_num, format, count(*) as copies, error is null as success, error,
              case when error is null then width else 0 end as width,
              case when error is null then height else 0 end as height,
              case when error is null then cast((width * 31 + height) % 997 + 1 as bigint) end as size_bytes,
              case when error is null then cast(page_num as bigint) else 0 end as render_ms,
              cast(0 as bigint) as encode_ms
       from (select *, case when ends_with(input, '3.pdf') then 'Failed to load PDF: FormatError'
                            when page_num % 5 = 0 then 'Failed to render page: stub' end as error from x_plan)
       group by doc_id, page_num, format, width, height, error""",
    ("x_plan",),
)
def _(t):
    return map_pages(page_plan(*_inputs(t)), StubRenderer).drop("image")


def stub_inspect(content):
    """Stands in for a PDF parser: a page per 2,000 bytes, text on all pages,
    an image on even ones; some contents are rejected."""
    if len(content) % 17 == 0:
        raise ValueError("FormatError")
    return [
        InspectedPage(612.0, 792.0 + number, ("Text", "Image") if number % 2 == 0 else ("Text",))
        for number in range(1, (len(content) + 1999) // 2000 + 1)
    ]


part(
    "x_inspected",
    """select doc_id, size % 17 = 0 as broken, cast((size + 1999) // 2000 as int) as num_pages
       from (select doc_id, octet_length(encode(text)) as size from documents)""",
)


@workload(
    "inspect_documents",
    """select doc_id, num_pages, page_num, cast(612 as double) as width_pt, cast(792 + page_num as double) as height_pt,
              case when page_num % 2 = 0 then 'Text,Image' else 'Text' end as object_types, null as error
       from (select doc_id, num_pages, cast(unnest(range(1, num_pages + 1)) as int) as page_num
             from x_inspected where not broken)
       union all
       select doc_id, null, null, null, null, null, 'Failed to load PDF: FormatError' from x_inspected where broken
       union all
       select doc_id, 0, null, null, null, null, null from x_inspected where not broken and num_pages = 0""",
    ("x_inspected",),
)
def _(t):
    found = inspect_documents(scan_buffers(t.documents, "doc_id", F.encode("text", "utf-8")), stub_inspect)
    return found.select(
        "doc_id",
        "num_pages",
        "page_num",
        F.col("width_pt").cast("double").alias("width_pt"),
        F.col("height_pt").cast("double").alias("height_pt"),
        F.array_join("object_types", ",").alias("object_types"),
        "error",
    )


@workload(
    "inspected_documents",
    """select doc_id, case when not broken then num_pages end as num_pages,
              case when broken then 'Failed to load PDF: FormatError' end as error from x_inspected""",
    ("x_inspected",),
)
def _(t):
    return inspected_documents(inspect_documents(scan_buffers(t.documents, "doc_id", F.encode("text", "utf-8")), stub_inspect))


@workload(
    "inspected_scan_sizes",
    """select doc_id, page_num, cast(1280 as int) as width, cast(round(cast((792 + page_num) * cast(
              cast(1280 as float) / cast(612 as float) as float) as float)) as int) as height
       from (select doc_id, cast(unnest(range(1, num_pages + 1)) as int) as page_num from x_inspected where not broken)""",
    ("x_inspected",),
)
def _(t):
    found = inspect_documents(scan_buffers(t.documents, "doc_id", F.encode("text", "utf-8")), stub_inspect)
    scans = scan_detection(inspected_objects(found)).select("doc_id", "page_num", "is_scan")
    pages = inspected_pages(found).join(scans, ["doc_id", "page_num"], "left")
    return plan_page_size(pages, side_limit(F.lit("webp"))).select("doc_id", "page_num", "width", "height")


def stub_inspect_scans(content):
    """A page per 1,500 bytes; every third page holds images only."""
    return [
        InspectedPage(500.0 + number, 700.0, ("Image", "Image") if number % 3 == 0 else ("Text", "Image"))
        for number in range(1, len(content) // 1500 + 2)
    ]


@workload(
    "inspected_scans",
    """select doc_id, page_num, as_scan, width, height, text_objects, image_objects
       from x_inspected_scans""",
    ("x_inspected_scans",),
)
def _(t):
    found = inspect_documents(scan_buffers(t.documents, "doc_id", F.encode("text", "utf-8")), stub_inspect_scans)
    scans = scan_detection(inspected_objects(found))
    pages = inspected_pages(found).join(scans, ["doc_id", "page_num"])
    sized = plan_page_size(pages, side_limit(F.lit("png")))
    return sized.select("doc_id", "page_num", F.col("is_scan").alias("as_scan"), "width", "height", "text_objects", "image_objects")


part(
    "x_inspected_scans",
    "select *, target = 1024 as as_scan from ("
    + _sized(
        """select doc_id, page_num, cast(500 + page_num as float) as w, cast(700 as float) as h, 32767 as lim,
                  case when page_num % 3 = 0 then 1024 else 1280 end as target,
                  case when page_num % 3 = 0 then 0 else 1 end as text_objects, case when page_num % 3 = 0 then 2 else 1 end as image_objects
           from (select doc_id, cast(unnest(range(1, strlen(text) // 1500 + 2)) as int) as page_num from documents)"""
    )
    + ")",
)


@workload(
    "requested_by_list",
    """select doc_id, page_num from (
         select d.doc_id, cast(l.page as int) as page_num from x_lists l join fx_documents d on l.doc_id = d.doc_id
         where l.page between 1 and d.num_pages
         union all
         select doc_id, cast(unnest(range(1, num_pages + 1)) as int) from fx_documents d
         where not exists (select 1 from x_lists l where l.doc_id = d.doc_id))""",
    ("x_lists",),
)
def _(t):
    from folioscale.functions import parse_page_list

    listed = t.fx_page_lists.select(F.col("job_id").alias("doc_id"), F.explode(parse_page_list("pages")).alias("page_num"))
    return expand_pages(t.fx_documents.select("doc_id", "num_pages"), listed).select("doc_id", "page_num")


part(
    "x_lists",
    """select job_id as doc_id, page from (
         select job_id, try_cast(regexp_extract(unnest(string_split(pages, ',')), '^\\s*([+-]?[0-9]+)', 1) as bigint) as page
         from fx_page_lists) where page > 0""",
    ("fx_page_lists", "fx_documents"),
)
