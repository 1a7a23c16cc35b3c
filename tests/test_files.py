"""Scans, renderers, inspectors and writers on real files."""

import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscale.operators.page_table import gather_pages
from folioscale.operators.render import (
    _as_dicts,
    InspectedPage,
    RenderedPage,
    inspect_documents,
    inspected_documents,
    inspected_objects,
    inspected_pages,
    map_pages,
)
from folioscale.operators.results import doc_rollup, output_size_rollup
from folioscale.plans.conversion import convert_to_files
from folioscale.sinks.images import check_sink_settings, list_outputs, write_manifest, write_page_files, write_page_objects
from folioscale.sources.store import open_store
from folioscale.sources import listing
from folioscale.sources.corpus import read_contents, read_corpus, scan_buffers, scan_corpus
from folioscale.sources.listing import FolderReader
from pyspark.sql.datasource import InputPartition


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for name, size in {"a.pdf": 300, "b.PDF": 20, "c.Pdf": 100, "notes.txt": 50, "empty.pdf": 0}.items():
        (folder / name).write_bytes((b"%PDF-1.4" + b"x" * size)[: size])
    return str(folder)


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_scan_corpus(spark, corpus):
    files = scan_corpus(spark, corpus)
    assert [(row["file_name"], row["size_bytes"]) for row in files.collect()] == [
        ("empty.pdf", 0), ("b.PDF", 20), ("c.Pdf", 100), ("a.pdf", 300),
    ]
    assert all(row["input"].startswith("file:/") for row in files.collect())
    assert scan_corpus(spark, corpus, min_bytes=100).count() == 2
    assert "binaryFile" not in plan_of(files) and "content" not in plan_of(files)


def test_scan_corpus_tree(spark, corpus):
    folder = Path(corpus) / "sub" / "deeper"
    folder.mkdir(parents=True)
    (folder / "d.pdf").write_bytes(b"1234")
    (folder / "none.PDF").write_bytes(b"")
    (folder / "none.txt").write_bytes(b"")
    assert scan_corpus(spark, corpus).count() == 4
    deep = scan_corpus(spark, corpus, recursive=True).collect()
    assert [row["file_name"] for row in deep if row["size_bytes"] < 5] == ["empty.pdf", "none.PDF", "d.pdf"]
    assert len(deep) == 6
    by_pattern = scan_corpus(spark, f"{corpus}/sub/*").collect()
    assert [row["file_name"] for row in by_pattern] == ["none.PDF", "d.pdf"]
    assert [row["size_bytes"] for row in scan_corpus(spark, f"{corpus}/empty.pdf").collect()] == [0]


def test_scan_corpus_patterns(spark, tmp_path):
    for year in (2020, 2021, 2022):
        for kind in ("in", "out", "x,y"):
            folder = tmp_path / str(year) / kind / "deep"
            folder.mkdir(parents=True)
            (folder.parent / f"{year}{kind}.pdf").write_bytes(b"1")
            (folder / "deep.pdf").write_bytes(b"22")
            (folder / "_hidden.pdf").write_bytes(b"3")
            (folder.parent / ".draft.pdf").write_bytes(b"3")
    (tmp_path / "2022" / "loop").symlink_to(tmp_path / "2022")
    names = lambda pattern, deep=False: [r["file_name"] for r in scan_corpus(spark, f"{tmp_path}/{pattern}", recursive=deep).collect()]
    assert names("20{20,21}/in") == ["2020in.pdf", "2021in.pdf"]
    assert names("202[^0]/o*") == ["2021out.pdf", "2022out.pdf"]
    assert names("202?/in/202[0-1]*.pdf") == ["2020in.pdf", "2021in.pdf"]
    assert names("2020/x\\,y") == ["2020x,y.pdf"]
    assert names("*/in", deep=True) == ["2020in.pdf", "2021in.pdf", "2022in.pdf"] + ["deep.pdf"] * 3
    assert len(names("", deep=True)) == 18
    with pytest.raises(FileNotFoundError):
        names("19*")
    with pytest.raises(Exception, match="does not exist"):
        names("nowhere")


def test_scan_of_one_folder_with_very_many_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "many"
    folder.mkdir()
    for number in range(100_000):
        os.close(os.open(folder / f"{number}.pdf", os.O_CREAT))
    reader = FolderReader({"frontier": "", "suffix": ".pdf"})
    monkeypatch.setattr(listing, "_frontier_rows", lambda part: iter([f"file://{folder}"]))
    sizes = [batch.num_rows for batch in reader.read(InputPartition("any"))]
    assert sum(sizes) == 100_000 and max(sizes) <= listing.ROWS_PER_BATCH
    monkeypatch.undo()
    assert scan_corpus(spark, str(tmp_path), recursive=True).count() == 100_000


def test_very_many_folders_are_rows(spark, tmp_path):
    for number in range(3000):
        (tmp_path / f"{number % 60}" / f"{number}").mkdir(parents=True)
        (tmp_path / f"{number % 60}" / f"{number}" / "a.pdf").write_bytes(b"x" * (number % 3))
    found = scan_corpus(spark, str(tmp_path), recursive=True, min_bytes=1)
    assert found.count() == 2000 and found.agg(F.sum("size_bytes")).first()[0] == 3000


def test_unreadable_file_is_a_row_without_content(spark, corpus):
    files = scan_corpus(spark, corpus)
    Path(corpus, "a.pdf").unlink()
    rows = {row["file_name"]: row["content"] for row in read_contents(files).collect()}
    assert rows["a.pdf"] is None and rows["empty.pdf"] == b"" and len(rows["c.Pdf"]) == 100


def toy_inspect(content):
    """A page per 100 bytes; only contents with a PDF header are documents."""
    if not content.startswith(b"%PDF"):
        raise ValueError("FormatError")
    return [InspectedPage(612.0, 792.0, ("Image",)) for _ in range(len(content) // 100)]


def test_inspect_documents(spark, corpus):
    docs = read_corpus(spark, corpus).withColumn("doc_id", F.col("file_name"))
    found = inspect_documents(docs, toy_inspect).cache()
    rows = {(row["doc_id"], row["page_num"]): row for row in found.collect()}
    assert set(rows) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("c.Pdf", 1), ("b.PDF", None), ("empty.pdf", None)}
    assert rows[("b.PDF", None)]["num_pages"] == 0
    assert rows[("empty.pdf", None)]["error"] == "Failed to load PDF: FormatError"
    assert rows[("a.pdf", 2)]["num_pages"] == 3
    assert inspected_pages(found).count() == inspected_objects(found).count() == 4


def test_bad_plug_in_output_is_one_error_row(spark):
    class Odd:
        def open(self, source):
            return source

        def render(self, document, page):
            if page["page_num"] == 1:
                return RenderedPage(image=b"x", width="wide", height=1)
            if page["page_num"] == 2:
                raise ValueError("half a sign: \ud800")
            return RenderedPage(image=b"x", width=1, height=1)

        def close(self, document):
            pass

    planned = spark.createDataFrame([(1, n, "a") for n in (1, 2, 3)], "doc_id int, page_num int, input string")
    assert {row["page_num"]: row["success"] for row in map_pages(planned, Odd).collect()} == {1: False, 2: False, 3: True}

    def odd_inspect(document):
        kinds = {b"none": (1.0, 2.0, None), b"text": ("wide", 2.0), b"good": (1.0, 2.0, ("text",))}
        yield InspectedPage(1.0, 2.0)
        yield InspectedPage(*kinds[bytes(document)])

    docs = spark.createDataFrame([(1, b"none"), (2, b"text"), (3, b"good")], "doc_id int, content binary")
    found = inspected_documents(inspect_documents(docs, odd_inspect)).collect()
    assert {row["doc_id"]: (row["num_pages"], row["error"] is None) for row in found} == {1: (None, False), 2: (None, False), 3: (2, True)}


def test_scan_buffers(spark):
    frame = spark.createDataFrame([(1, b"abc"), (2, b"")], "id int, body binary")
    rows = scan_buffers(frame, "id", F.col("body")).orderBy("doc_id").collect()
    assert [(row["input_type"], row["size_bytes"]) for row in rows] == [("buffer", 3), ("buffer", 0)]


class CountingRenderer:
    """Fails for page 3 and documents named bad; the image tells how many
    documents this renderer has opened so far."""

    def __init__(self):
        self.opened = 0

    def open(self, source):
        if source == "bad":
            raise OSError("FormatError")
        self.opened += 1
        return source

    def render(self, document, page):
        if page["page_num"] == 3:
            raise RuntimeError("Failed to render page: x")
        return RenderedPage(f"{document}:{self.opened}".encode(), page["width"], 9, encode_ms=2)

    def close(self, document):
        pass


def planned(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, page_num int, input string, format string, width int")


def test_map_pages_isolates_faults(spark):
    rows = [(1, page, "one", "webp", 5) for page in (1, 2, 3, 4)] + [(2, 1, "bad", "png", 5), (3, 1, None, "png", 5)]
    result = {(r["doc_id"], r["page_num"]): r for r in map_pages(planned(spark, rows), CountingRenderer).collect()}
    assert len(result) == 6
    ok = result[(1, 2)]
    assert (ok["success"], ok["error"], ok["width"], ok["height"], ok["size_bytes"], ok["encode_ms"]) == (True, None, 5, 9, 5, 2)
    assert ok["render_ms"] >= 0
    assert result[(1, 3)]["error"] == "Failed to render page: x" and result[(1, 3)]["image"] is None
    assert result[(2, 1)]["error"] == "Failed to load PDF: FormatError"
    assert result[(3, 1)]["error"] == "No input provided: filePath or pdfBuffer required"


def test_document_opens_once_per_group(spark):
    rows = [(1, page, "one", "webp", 5) for page in range(10, 30)]
    images = {row["image"] for row in map_pages(planned(spark, rows), CountingRenderer).collect()}
    assert images == {b"one:1"}
    groups = map_pages(planned(spark, rows), CountingRenderer, pages_per_group=5)
    assert groups.select(F.spark_partition_id()).distinct().count() > 1


def test_repeated_pages_render_once(spark):
    rows = [(1, 1, "one", "webp", 5)] * 40 + [(1, 2, "one", "webp", 5)]
    result = map_pages(planned(spark, rows), CountingRenderer).orderBy("page_num").collect()
    assert [row["copies"] for row in result] == [40, 1]


@pytest.mark.parametrize("factory", [lambda: None, lambda: 1 / 0])
def test_renderer_missing(spark, factory):
    row = map_pages(planned(spark, [(1, 1, "one", "webp", 5)]), factory).first()
    assert (row["success"], row["error"]) == (False, "Native renderer not available in worker thread")


RENDERED = "doc_id int, page_num int, format string, copies bigint, width int, height int, success boolean, error string, image bytes"


def rendered(spark):
    return spark.createDataFrame(
        [
            (1, 1, "webp", 1, 5, 6, True, None, bytearray(b"aa")),
            (1, 2, "webp", 1, 5, 6, False, "Render failed", None),
            (1, 1, "jpeg", 1, 5, 6, True, None, bytearray(b"bbbb")),
            (1, 1, "jpeg", 1, 5, 6, True, None, bytearray(b"bbbb")),
        ],
        RENDERED.replace("bytes", "binary"),
    )


def test_write_page_files(spark, tmp_path):
    out = tmp_path / "out"
    rows = write_page_files(rendered(spark), str(out), "p").collect()
    written = {str(path.relative_to(out)): path.read_bytes() for path in out.rglob("*") if path.is_file()}
    written = {name: data for name, data in written.items() if not Path(name).name.startswith(".")}
    assert written == {"1/webp/p_1.webp": b"aa", "1/jpeg/p_1.jpg": b"bbbb"}
    assert sorted((r["output_path"] or "", r["size_bytes"] or 0, r["success"]) for r in rows) == [
        ("", 0, False), ("1/jpeg/p_1.jpg", 4, True), ("1/jpeg/p_1.jpg", 4, True), ("1/webp/p_1.webp", 2, True),
    ]
    assert {r["error"] for r in rows if not r["success"]} == {"Render failed"}


def test_write_error_is_a_failed_row(spark, tmp_path):
    out = tmp_path / "out"
    (out / "1").mkdir(parents=True)
    (out / "1" / "webp").write_text("a file where a folder is needed")
    rows = {(r["page_num"], r["format"]): r for r in write_page_files(rendered(spark), str(out)).collect()}
    assert rows[(1, "jpeg")]["success"]
    assert not rows[(1, "webp")]["success"]
    assert rows[(1, "webp")]["error"].startswith("File save failed: ")


def test_write_page_objects(spark, tmp_path):
    uri = (tmp_path / "store").as_uri()
    rows = write_page_objects(rendered(spark), uri, F.concat(F.lit("docs/"), F.col("doc_id"))).collect()
    assert {r["object_key"] for r in rows} == {"docs/1/page_1.webp", "docs/1/page_1.jpg", None}
    assert (tmp_path / "store" / "docs" / "1" / "page_1.jpg").read_bytes() == b"bbbb"
    with pytest.raises(Exception, match="key_prefix must not be empty"):
        write_page_objects(rendered(spark), uri, F.lit("")).collect()


def test_convert_to_files_and_roll_up(spark, tmp_path):
    out, manifest_path = tmp_path / "out", str(tmp_path / "manifest")
    (out / "1" / "webp").mkdir(parents=True)
    (out / "1" / "webp" / "stale_9.webp").write_bytes(b"123")
    rows = [(1, page, "one", "webp", 5) for page in (1, 2, 3)] + [(2, 1, "bad", "png", 5)]
    manifest = convert_to_files(planned(spark, rows), CountingRenderer, str(out), manifest_path)
    assert manifest.count() == 4 and "image" not in manifest.columns
    totals = {row["doc_id"]: row for row in doc_rollup(manifest, copies=F.col("copies")).collect()}
    assert (totals[1]["pages"], totals[1]["rendered_pages"], totals[1]["output_bytes"]) == (3, 2, 10)
    assert totals[2]["rendered_pages"] == 0
    # The listing counts whatever lies there, the manifest what was written.
    listed = output_size_rollup(list_outputs(spark, str(out))).collect()
    assert [(row["doc_id"], row["format"], row["output_bytes"], row["files"]) for row in listed] == [("1", "webp", 13, 3)]
    # Saved results feed the page table again.
    gathered = gather_pages(manifest.select("doc_id", "page_num", "copies"), results=manifest)
    assert gathered.where("success").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_manifest(manifest, manifest_path)


def test_sink_settings_are_checked_first():
    full = {"secret_id": "i", "secret_key": "k", "bucket": "b", "region": "r"}
    check_sink_settings(full)
    check_sink_settings({**full, "region": ""}, {"region": "r"})
    with pytest.raises(ValueError, match="incomplete: bucket, region"):
        check_sink_settings({**full, "bucket": None, "region": ""})


@pytest.mark.parametrize("name", ["with space", "日本", "a%20b", "plus+and#hash"])
def test_folder_names_stand_for_themselves(spark, tmp_path, name):
    folder = tmp_path / name / "inner"
    folder.mkdir(parents=True)
    (folder / "full.pdf").write_bytes(b"%PDF")
    (folder / "empty.PDF").write_bytes(b"")
    store, path = open_store(f"file://{folder}")
    assert path == str(folder) and store.get_file_info(path).type.name == "Directory"
    assert scan_corpus(spark, f"file://{tmp_path}", recursive=True).count() == 2


def test_of_several_results_one_row_counts(spark):
    requested = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, page_num bigint, copies bigint")
    geometry = spark.createDataFrame([(1, 1, 100.0, 900.0), (1, 1, 700.0, 50.0)], "doc_id bigint, page_num int, width_pt float, height_pt float")
    rows = [(1, 1, False, None, 9000, 5), (1, 1, True, 70, 10, 3), (1, 1, None, None, None, None)]
    results = spark.createDataFrame(rows, "doc_id bigint, page_num int, success boolean, size_bytes bigint, render_ms int, encode_ms int")
    row = gather_pages(requested, None, geometry, results).first()
    assert (row["width_pt"], row["height_pt"]) == (700.0, 50.0)
    assert (row["success"], row["size_bytes"], row["render_ms"], row["encode_ms"]) == (True, 70, 10, 3)


def test_target_outside_the_folder_is_a_failed_row(spark, tmp_path):
    rows = [("../../evil", 1, True, None, b"x", "png"), ("fine", 1, True, None, b"y", "png"), ("..", 2, True, None, b"z", "png")]
    schema = "doc_id string, page_num int, success boolean, error string, image binary, format string"
    written = write_page_files(spark.createDataFrame(rows, schema), str(tmp_path / "out")).collect()
    assert {row["doc_id"]: row["success"] for row in written} == {"../../evil": True, "fine": True, "..": False}
    assert not (tmp_path / "evil").exists() and not list(tmp_path.glob("*.png"))


def test_rows_of_a_batch_are_those_of_arrow():
    columns = {
        "whole": pa.array([1, 2, 3], pa.int32()), "holes": pa.array([1, None, (1 << 60) + 1]), "text": ["a", None, "日"],
        "sure": [True, False, True], "unsure": [True, None, False], "real": [0.5, 1.5, 2.5], "single": pa.array([0.1, 0.2, 0.3], pa.float32()),
        "bytes": [b"a", None, b""], "list": [["a"], None, []], "none": pa.nulls(3, pa.string()),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    for part in (batch, batch.slice(1, 2), batch.slice(0, 0)):
        found = list(_as_dicts(part))
        assert found == part.to_pylist()
        assert [[type(value) for value in row.values()] for row in found] == [[type(value) for value in row.values()] for row in part.to_pylist()]
