"""Input tables of the workloads, derived from the driver tables.

Each text is in the common subset of Spark SQL and DuckDB SQL; a name in braces
stands for a driver table. See FIXTURES.md for what each table covers.
"""

FIXTURES: dict[str, str] = {
    "fx_documents": """
        select o_orderkey as doc_id,
               case when o_orderkey % 4 = 0 then concat('https://h.example.com/d/', cast(o_orderkey as varchar(20)), '.pdf')
                    when o_orderkey % 4 = 1 then concat('http://h.example.com/d/', cast(o_orderkey as varchar(20)), '.pdf')
                    when o_orderkey % 4 = 2 then concat('HTTP://h.example.com/d/', cast(o_orderkey as varchar(20)), '.pdf')
                    else concat('/corpus/', cast(o_orderkey as varchar(20)), '.pdf') end as input,
               concat('doc_', cast(o_orderkey as varchar(20)), case when o_orderkey % 3 = 0 then '.PDF' else '.pdf' end) as file_name,
               cast(round(o_totalprice * 100) as bigint) as size_bytes,
               cast(o_orderkey % 9 as int) as num_pages,
               case o_orderpriority when '1-URGENT' then 'webp' when '2-HIGH' then 'PNG' when '3-MEDIUM' then 'jpg'
                    when '4-NOT SPECIFIED' then 'Jpeg' else 'tiff' end as format_raw,
               o_custkey as job_id
        from {orders}
    """,
    "fx_page_requests": """
        select l_orderkey as doc_id, cast(l_linenumber as int) as page_num from {lineitem}
    """,
    "fx_page_objects": """
        select l_orderkey as doc_id, cast(l_linenumber as int) as page_num,
               case l_returnflag when 'A' then 'Text' when 'N' then 'Image' else 'Path' end as object_type
        from {lineitem}
    """,
    "fx_page_geometry": """
        select l_orderkey as doc_id, cast(l_linenumber as int) as page_num,
               cast(36 + min(l_extendedprice) / 7 as float) as width_pt,
               cast(36 + max(l_extendedprice) / 3 as float) as height_pt
        from {lineitem} group by l_orderkey, l_linenumber
    """,
    "fx_page_results": """
        select l_orderkey as doc_id, cast(l_linenumber as int) as page_num,
               min(l_suppkey) % 11 <> 0 as success,
               case when min(l_suppkey) % 11 <> 0 then null
                    when min(l_partkey) % 4 = 0 then concat('Invalid page number: ', cast(l_linenumber as varchar(20)), ' (total: 3)')
                    when min(l_partkey) % 4 = 1 then 'Failed to load PDF: FormatError'
                    when min(l_partkey) % 4 = 2 then 'Failed to render page: Unknown'
                    else 'Upload failed: timeout' end as error,
               cast(case when min(l_suppkey) % 11 <> 0 then 1280 else 0 end as int) as width,
               cast(case when min(l_suppkey) % 11 <> 0 then 600 + min(l_partkey) % 1200 else 0 end as int) as height,
               case when min(l_suppkey) % 11 <> 0 then cast(round(min(l_extendedprice) * 10) as bigint) end as size_bytes,
               case when min(l_partkey) % 13 <> 0 then cast(round(min(l_quantity) * 3) as int) end as render_ms,
               case when min(l_suppkey) % 11 <> 0 then cast(round(min(l_discount) * 1000) as int) end as encode_ms
        from {lineitem} group by l_orderkey, l_linenumber
    """,
    "fx_bench_runs": """
        select concat('f', cast(o_custkey % 600 as varchar(20)), '.pdf') as file,
               (o_custkey % 600) * 1049 + 37 as file_size,
               case case when o_custkey % 600 < 300 then o_orderkey % 3 else o_orderkey % 2 end
                    when 0 then 'webp' when 1 then 'png' else 'jpg' end as format,
               max(cast(round(o_totalprice) as bigint)) as total_ms,
               cast(sum(cast(round(o_totalprice) as bigint)) * 3 as bigint) as output_bytes,
               cast(count(*) as int) as pages
        from {orders}
        group by o_custkey % 600, case when o_custkey % 600 < 300 then o_orderkey % 3 else o_orderkey % 2 end
    """,
    "fx_block_reads": """
        select user_id as task_id, event_id as seq, (event_id * 3246599) % 50331648 as pos,
               1 + (event_id * 7919) % 600000 as len, cast(50331648 as bigint) as file_size
        from {events}
    """,
    # Some ids are asked again before an answer, some after; responses lack ids, verdicts and sizes.
    "fx_requests": """
        select user_id * 65536 + event_id % 65536 as request_id, event_id * 1000 as sent_ms from {events}
        union all
        select user_id * 65536 + event_id % 65536, event_id * 1000 + event_id % 9 * 400 from {events} where event_id % 11 = 0
    """,
    "fx_responses": """
        select case when event_id % 23 = 0 then null else user_id * 65536 + event_id % 65536 end as request_id,
               event_id * 1000 + cast(round(value * 100) as bigint) as recv_ms,
               case when event_id % 13 = 0 then null else event_type <> 'click' or event_id % 7 <> 0 end as ok,
               case when event_id % 19 = 0 then null else cast(262144 as bigint) end as bytes
        from {events} where event_id % 17 <> 0
        union all
        select user_id * 65536 + event_id % 65536, event_id * 1000 + cast(round(value * 100) as bigint) + 500 * (event_id % 2), false, cast(0 as bigint)
        from {events} where event_id % 5 = 0
    """,
    "fx_job_options": """
        select p_partkey as job_id,
               case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then 'WEBP' when p_partkey % 5 = 2 then 'png' when p_partkey % 5 = 3 then 'jpeg' else 'bmp' end as format,
               cast(case when p_size % 4 = 0 then null else 640 + p_size * 16 end as int) as target_width,
               cast(case when p_size % 3 = 0 then null else p_size % 5 * 20 end as int) as quality,
               cast(case when p_partkey % 3 = 0 then null else p_partkey % 4 * 25 end as int) as webp_quality,
               cast(case when p_partkey % 4 = 0 then null else p_partkey % 7 end as int) as webp_method,
               cast(case when p_partkey % 3 = 1 then null else p_partkey % 5 * 20 end as int) as jpeg_quality,
               cast(case when p_partkey % 7 = 0 then null else p_partkey % 10 end as int) as png_compression,
               case when p_partkey % 6 = 0 then null else p_partkey % 2 = 0 end as detect_scan
        from {part}
    """,
    "fx_page_lists": """
        select o_orderkey as job_id,
               case when o_orderkey % 10 = 0 then 'abc' when o_orderkey % 10 = 1 then ''
                    else concat(cast(o_orderkey % 5 as varchar(20)), ', ', cast(o_custkey % 7 as varchar(20)), 'abc,-', cast(o_orderkey % 3 as varchar(20)), ',x, +2-4,99999999999') end as pages
        from {orders}
    """,
    "fx_sink_configs": """
        select c_custkey as job_id,
               case when c_custkey % 5 = 0 then null else 'id' end as secret_id,
               case when c_custkey % 7 = 0 then '' else 'key' end as secret_key,
               case when c_custkey % 3 = 0 then null else 'bucket' end as bucket,
               case when c_custkey % 11 = 0 then '' else 'ap-x' end as region
        from {customer}
    """,
    "fx_range_requests": """
        select page_id, case when page_id % 5 = 0 then 'HEAD' else 'GET' end as method,
               page_id % 7 <> 0 as found,
               case when page_id % 3 = 0 then null
                    when page_id % 3 = 1 then concat('bytes=', cast(page_id * 1000 as varchar(20)), '-', cast(page_id * 1000 + 262143 as varchar(20)))
                    else concat('bytes=', cast(page_id * 1000 as varchar(20)), '-') end as range_header,
               cast(10000000 + page_id as bigint) as file_size
        from {pages}
    """,
}
