"""Workloads over files: documents are written to the shared folder, scanned,
inspected, rendered from their bytes, and written as images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscale.operators.numbering import numbered
from folioscale.operators.render import RenderedPage, inspect_documents, inspected_documents, inspected_objects, inspected_pages, map_contents
from folioscale.operators.results import collect_pages, doc_rollup, job_summary, output_size_rollup
from folioscale.plans.conversion import convert_to_files, convert_to_objects, page_plan, resume_conversion
from folioscale.session import stored, work_folder
from folioscale.sinks.files import put_file
from folioscale.sinks.images import latest_outcomes, list_outputs, write_manifest, write_page_files, write_page_objects
from folioscale.sources.corpus import read_corpus, scan_corpus
from folioscale.sources.store import open_store
from workloads.operator_queries import stub_inspect
from workloads.registry import part, workload

_FORMAT = "case doc_id % 4 when 0 then 'webp' when 1 then 'PNG' when 2 then 'jpeg' else 'tiff' end"


def _file_name(text: str) -> str:
    return f"concat({text} % 16, '/', {text}, case when {text} % 3 = 0 then '.PDF' when {text} % 7 = 0 then '.txt' else '.pdf' end)"


def _corpus(t) -> str:
    """Every document as a file, some with another suffix; returns the folder."""
    folder = work_folder(t.spark, "corpus")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(*batch.columns):  # one file's bytes are copied at a time
                put_file(store, f"{base}/{name}", content.as_py(), "application/pdf", made)
            yield batch.select(["name"])

    files = t.documents.select(F.expr(_file_name("doc_id")).alias("name"), F.encode("text", "utf-8").alias("content"))
    files.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


part(
    "x_files",
    f"""select *, string_split(place, '/')[2] as file_name
        from (select {_file_name('doc_id')} as place, strlen(text) as size_bytes, md5(text) as content_md5 from documents)
        where not ends_with(place, '.txt')""",
)


@workload(
    "scan_corpus",
    "select file_name, size_bytes, row_number() over (order by size_bytes, place) - 1 as position from x_files",
    ("x_files",),
)
def _(t):
    found = scan_corpus(t.spark, _corpus(t), recursive=True)
    # Numbers by the order in which the rows come.
    listed = found.select("file_name", "size_bytes", F.monotonically_increasing_id().alias("at"))
    return numbered(listed, [], ["at"]).drop("at")


@workload("read_corpus", "select file_name, size_bytes, content_md5 from x_files", ("x_files",))
def _(t):
    found = read_corpus(t.spark, f"{_corpus(t)}/*")
    return found.select("file_name", "size_bytes", F.md5("content").alias("content_md5"))


# --- from bytes to images ------------------------------------------------------


class ContentRenderer:
    """Stands in for a renderer of bytes: a page's image is its own 2,000
    bytes; every fifth page fails."""

    def open(self, source):
        return source

    def render(self, document, page):
        if page["page_num"] % 5 == 0:
            raise RuntimeError("Failed to render page: stub")
        start = (page["page_num"] - 1) * 2000
        return RenderedPage(document[start : start + 2000], page["width"], page["height"], render_ms=page["page_num"])

    def close(self, document):
        pass


class PatientRenderer(ContentRenderer):
    """The same without failures."""

    def render(self, document, page):
        start = (page["page_num"] - 1) * 2000
        return RenderedPage(document[start : start + 2000], page["width"], page["height"], render_ms=page["page_num"])


def _contents(t) -> DataFrame:
    return t.documents.select("doc_id", F.encode("text", "utf-8").alias("content"))


def _content_plan(t) -> DataFrame:
    """Inspected documents in the formats above, all pages, no job options."""
    found = stored(inspect_documents(_contents(t), stub_inspect), "inspected")  # once, not per use of it
    known = inspected_documents(found).where("error is null")
    docs = known.select(
        "doc_id",
        F.concat(F.lit("bytes:"), "doc_id").alias("input"),
        "num_pages",
        F.expr(_FORMAT).alias("format_raw"),
        F.lit(None).cast("bigint").alias("job_id"),
    )
    nothing = t.spark.createDataFrame([], "doc_id bigint, page_num int")
    return page_plan(docs, nothing, inspected_objects(found), inspected_pages(found), t.fx_job_options)


def _rendered(t) -> DataFrame:
    return map_contents(_content_plan(t), _contents(t), ContentRenderer)


part(
    "x_images",
    f"""select doc_id, page_num, format, page_num % 5 <> 0 as success, least(2000, size - 2000 * (page_num - 1)) as bytes
        from (select doc_id, size, cast(unnest(range(1, (size + 1999) // 2000 + 1)) as int) as page_num,
                     lower({_FORMAT}) as format
              from (select doc_id, strlen(text) as size from documents) where size % 17 <> 0)
        where format <> 'tiff'""",
)


@workload(
    "map_contents",
    """select doc_id, page_num, format, cast(1 as bigint) as copies, success,
              case when not success then 'Failed to render page: stub' end as error,
              case when success then bytes end as size_bytes, case when success then page_num else 0 end as render_ms
       from x_images""",
    ("x_images",),
)
def _(t):
    return _rendered(t).select("doc_id", "page_num", "format", "copies", "success", "error", "size_bytes", "render_ms")


@workload(
    "content_conversion",
    """select doc_id, cast(count(*) as bigint) as pages, count(*) filter (success) as rendered_pages,
              cast(coalesce(sum(bytes) filter (success), 0) as bigint) as output_bytes,
              cast(coalesce(sum(page_num) filter (success), 0) as bigint) as render_ms, bool_and(success) as all_pages_ok
       from x_images group by doc_id""",
    ("x_images",),
)
def _(t):
    totals = doc_rollup(_rendered(t).drop("image"), copies=F.col("copies"))
    return totals.select("doc_id", "pages", "rendered_pages", "output_bytes", "render_ms", "all_pages_ok")


@workload(
    "collected_images",
    """select doc_id, page_num, success, case when success then md5(substr(hex(encode(text)), 4000 * (page_num - 1) + 1, 4000)) end as image_md5,
              row_number() over (order by doc_id, page_num) - 1 as position
       from x_images join documents using (doc_id)""",
    ("x_images",),
)
def _(t):
    pages = collect_pages(_rendered(t)).select(
        "doc_id", "page_num", "success", F.md5(F.hex("image")).alias("image_md5"), F.monotonically_increasing_id().alias("at")
    )
    return numbered(pages, [], ["at"]).drop("at")


_NAME = "page_num || '.' || replace(format, 'jpeg', 'jpg')"
_WRITTEN = """select doc_id, page_num, format, success, case when not success then 'Failed to render page: stub' end as error,
              case when success then {path} end as {name}, case when success then bytes end as size_bytes from x_images"""


@workload(
    "write_page_files",
    _WRITTEN.format(path=f"doc_id || '/' || format || '/p_' || {_NAME}", name="output_path"),
    ("x_images",),
)
def _(t):
    written = write_page_files(_rendered(t), work_folder(t.spark, "images"), "p")
    return written.select("doc_id", "page_num", "format", "success", "error", "output_path", "size_bytes")


@workload(
    "write_page_objects",
    _WRITTEN.format(path=f"'kept/' || doc_id || '/page_' || {_NAME}", name="object_key"),
    ("x_images",),
)
def _(t):
    prefix = F.concat(F.lit("kept/"), F.col("doc_id"))
    written = write_page_objects(_rendered(t), work_folder(t.spark, "objects"), prefix)
    return written.select("doc_id", "page_num", "format", "success", "error", "object_key", "size_bytes")


@workload(
    "write_manifest",
    """select format, count(distinct doc_id) as documents, count(*) as pages, count(*) filter (success) as rendered_pages,
              cast(sum(bytes) filter (success) as bigint) as output_bytes
       from x_images group by format""",
    ("x_images",),
)
def _(t):
    saved = write_manifest(_rendered(t), work_folder(t.spark, "manifest"))
    totals = doc_rollup(saved, keys=("doc_id", "format"), copies=F.col("copies"))
    return job_summary(totals, ["format"]).select("format", "documents", "pages", "rendered_pages", "output_bytes")


@workload(
    "convert_to_files",
    """select cast(doc_id as varchar) as doc_id, format, count(*) as files, cast(sum(bytes) as bigint) as output_bytes
       from x_images where success group by doc_id, format""",
    ("x_images",),
)
def _(t):
    folder = work_folder(t.spark, "images")
    convert_to_files(_content_plan(t), ContentRenderer, folder, work_folder(t.spark, "manifest"), contents=_contents(t))
    return output_size_rollup(list_outputs(t.spark, folder)).select("doc_id", "format", "files", "output_bytes")


@workload(
    "convert_to_objects",
    _WRITTEN.format(path=f"'out/' || doc_id || '/' || format || '/page_' || {_NAME}", name="object_key"),
    ("x_images",),
)
def _(t):
    manifest = convert_to_objects(
        _content_plan(t),
        ContentRenderer,
        work_folder(t.spark, "objects"),
        work_folder(t.spark, "manifest"),
        settings={"secret_id": "i", "secret_key": "k", "bucket": "b"},
        fallback={"region": "r"},
        key_prefix="out",
        contents=_contents(t),
    )
    return manifest.select("doc_id", "page_num", "format", "success", "error", "object_key", "size_bytes")


@workload(
    "resume_conversion",
    """select doc_id, page_num, format, case when success then 1 else 2 end as generation, bytes as size_bytes,
              count(*) filter (not success) over () as rendered_again
       from x_images""",
    ("x_images",),
)
def _(t):
    plan, contents = _content_plan(t), _contents(t)
    folder, manifest = work_folder(t.spark, "images"), work_folder(t.spark, "manifest")
    convert_to_files(plan, ContentRenderer, folder, manifest, contents=contents)
    again = resume_conversion(plan, PatientRenderer, folder, manifest, contents=contents)
    latest = latest_outcomes(again.manifest).where("success")
    return latest.select(
        "doc_id", "page_num", "format", "generation", "size_bytes", F.lit(again.summary["pages"]).alias("rendered_again")
    )
