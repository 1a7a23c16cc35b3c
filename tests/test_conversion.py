"""Whole conversions: tasks of equal cost, bytes that cross once per group,
runs that leave all or nothing, and going on where a run ended."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscale.operators.numbering import numbered
from folioscale.operators.page_table import gather_pages
from folioscale.operators.render import RenderedPage, map_contents, map_pages, pack_pages
from folioscale.operators.results import collect_pages, doc_rollup, job_summary, result_arrays
from folioscale.plans.conversion import convert_to_files, convert_to_objects, resume_conversion
from folioscale.sinks.images import latest_outcomes, list_outputs, pages_to_do, save_manifest
from folioscale.sinks.transaction import PageWriter, open_runs, publish_run, stage_images
from workloads.registry import WORKLOADS, Tables

FOLDER = "/root/testdata/sf0.001"


def initial(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def files_under(folder):
    return sorted(str(path.relative_to(folder)) for path in Path(folder).rglob("*") if path.is_file() and ".crc" not in path.name)


class Tally:
    """Renders a few bytes, notes every page in a file, fails for some pages."""

    def __init__(self, notes, failing=(), dies=None):
        self.notes, self.failing, self.dies = Path(notes), failing, dies

    def open(self, source):
        return source

    def render(self, document, page):
        with open(self.notes, "a") as notes:
            notes.write(f"{page['doc_id']}/{page['page_num']}\n")
        if page["page_num"] == self.dies:
            raise SystemExit("the worker dies")  # no Exception: the task fails, not the page
        if page["page_num"] in self.failing:
            raise RuntimeError("Failed to render page: x")
        return RenderedPage(f"{document}:{page['page_num']}".encode(), 3, 4, render_ms=page["page_num"], encode_ms=1)

    def close(self, document):
        pass


def noted(notes):
    return Counter(Path(notes).read_text().split()) if Path(notes).exists() else Counter()


def plan(spark, docs=4, pages=5):
    return spark.range(docs * pages).selectExpr(
        f"cast(id div {pages} as int) as doc_id", f"cast(id % {pages} + 1 as int) as page_num",
        f"concat('doc', id div {pages}) as input", "'png' as format", "10 as width", "20 as height", "1L as copies",
    )


# --- packing -------------------------------------------------------------------


def test_tasks_cost_alike(spark):
    """Sizes differ by a factor of a thousand and one document has a third of all pages."""
    pages = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 7, id % 400) as doc_id", "cast(id as int) as page_num", "'a' as input", "'png' as format",
        "cast(if(id % 100 = 0, 4000, 100 + id % 300) as int) as width", "cast(if(id % 100 = 0, 4000, 100) as int) as height",
    )
    grouped = pages.withColumn("_group", F.floor(F.col("page_num") / 256))
    limit = 60_000_000
    packed, slots = pack_pages(grouped, F.col("width").cast("bigint") * F.col("height"), limit)
    costs = [row["cost"] for row in packed.groupBy("_slot").agg(F.sum(F.col("width").cast("bigint") * F.col("height")).alias("cost")).collect()]
    assert slots > 50 and packed.count() == 30_000
    assert max(costs) <= 2 * sum(costs) / slots
    dealt = packed.repartitionById(slots, "_slot").select(F.spark_partition_id().alias("at"), "_slot").distinct().collect()
    assert all(row["at"] == row["_slot"] for row in dealt)


def test_a_group_that_is_too_much_is_cut(spark):
    pages = spark.range(200).selectExpr("1 as doc_id", "cast(id + 1 as int) as page_num", "0L as _group")
    packed, slots = pack_pages(pages, F.lit(10), 100)
    counts = Counter(row["_slot"] for row in packed.collect())
    assert slots == 20 and set(counts.values()) == {10}


def test_number_of_tasks_follows_from_the_work(spark, tmp_path):
    make = lambda: Tally(tmp_path / "notes")
    few = map_pages(plan(spark), make)
    many = map_pages(plan(spark, 40, 50).withColumns({"width": F.lit(8000), "height": F.lit(8000)}), make, pixels_per_task=1 << 29)
    fixed = map_pages(plan(spark), make, partitions=3)
    partitions = [frame.select(F.spark_partition_id().alias("at"), "doc_id").agg(F.max("at")).first()[0] + 1 for frame in (few, many, fixed)]
    assert partitions[1] > 200 and partitions[0] <= 8 and partitions[2] <= 3
    assert many.count() == 2000


# --- bytes -----------------------------------------------------------------------


def contents(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, content binary")


def test_bytes_meet_groups_of_pages(spark, tmp_path, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    documents = contents(spark, [(0, b"zero"), (1, b"one"), (1, b"eins"), (2, None), (9, b"nobody asks")])
    pages = plan(spark).withColumn("page_num", F.col("page_num") * 30)
    found = map_contents(pages, documents, lambda: Tally(tmp_path / "notes", failing=(60,)), pages_per_group=50)
    rows = {(row["doc_id"], row["page_num"]): row for row in found.collect()}
    assert len(rows) == 20
    assert bytes(rows[(0, 30)]["image"]) == b"b'zero':30" and bytes(rows[(1, 150)]["image"]) == b"b'eins':150"
    assert rows[(0, 60)]["error"] == "Failed to render page: x"
    assert {row["error"] for key, row in rows.items() if key[0] in (2, 3)} == {"No input provided: filePath or pdfBuffer required"}
    assert noted(tmp_path / "notes") == Counter(f"{doc}/{page}" for doc in (0, 1) for page in (30, 60, 90, 120, 150))


def test_no_bytes_beside_pages_in_an_exchange(spark, tmp_path, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    documents = contents(spark, [(0, b"zero")])
    frame = map_contents(plan(spark), documents, lambda: Tally(tmp_path / "n"))
    text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)
    assert len(moved) >= 3 and any("content" in columns for columns in moved)
    assert not any("content" in columns and "page_num" in columns for columns in moved)


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_groups_of_bytes_are_streamed(spark, tmp_path, conf, threshold):
    """No call per group: tasks stream; nulls, repeats and copies of a page come out as they are."""
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    documents = contents(spark, [(doc, b"%d" % (doc * 7 % 10)) for doc in [*range(40), *range(40)]] + [(1, b"0"), (None, b"x"), (2, None)])
    pages = plan(spark, 40, 9).unionAll(plan(spark, 1, 9).withColumn("format", F.lit("webp")))
    pages = pages.unionAll(plan(spark, 1, 2).withColumn("doc_id", F.lit(None).cast("int"))).drop("copies")
    found = map_contents(pages.unionAll(plan(spark, 1, 3).drop("copies")), documents, lambda: Tally(tmp_path / "n"), pages_per_group=2)
    assert "CoGroup" not in initial(found) and "SortMergeJoin" in initial(found)
    rows = found.collect()
    assert len(rows) == 40 * 9 + 9 + 2 and sum(row["copies"] for row in rows) == 374
    least = {doc: b"%d" % (doc * 7 % 10) for doc in range(40)} | {1: b"0"}
    for row in rows:
        assert row["success"] == (row["doc_id"] is not None)
        assert not row["success"] or bytes(row["image"]) == f"{least[row['doc_id']]}:{row['page_num']}".encode()


def test_documents_are_inspected_once(spark):
    """Three uses of the inspected rows, each planned twice, are one run of the inspector."""
    frame = WORKLOADS["content_conversion"].run(spark, FOLDER)
    assert initial(frame).count("MapInArrow") <= 1  # that of the renderer


# --- all or nothing ------------------------------------------------------------


def test_a_run_holds_a_file_per_task(spark, tmp_path):
    """However many images there are: the driver deletes the run's files one by one."""
    out = str(tmp_path / "out")
    rendered = map_pages(plan(spark, 100, 9), lambda: Tally(tmp_path / "n", failing=(4,)), partitions=3).withColumn("generation", F.lit(1))
    run = stage_images(rendered, out, F.concat_ws("/", "doc_id", "page_num"), "File save failed: ")
    assert len(files_under(out)) <= 4
    published = publish_run(spark, out, run, "output_path", "File save failed: ")
    for _ in range(2):  # repeating it does no harm
        assert published.where("success and size_bytes > 0").count() == 800
    assert published.where("error = 'Failed to render page: x' and output_path is null").count() == 100
    assert Path(out, "7", "3").read_bytes() == b"doc7:3"


def test_a_job_that_dies_leaves_nothing(spark, tmp_path):
    out, manifest = tmp_path / "out", tmp_path / "manifest"
    with pytest.raises(Exception):
        convert_to_files(plan(spark, 20, 5), lambda: Tally(tmp_path / "n", dies=3), str(out), str(manifest), pages_per_group=1)
    assert len(noted(tmp_path / "n")) > 10  # some tasks had written by then
    assert files_under(out) == [] and open_runs(str(out)) == {} and not manifest.exists()
    saved = convert_to_files(plan(spark, 20, 5), lambda: Tally(tmp_path / "n"), str(out), str(manifest))
    assert saved.where("success").count() == 100 and len(files_under(out)) == 100
    with pytest.raises(FileExistsError, match="PATH_ALREADY_EXISTS"):
        convert_to_files(plan(spark), lambda: Tally(tmp_path / "again"), str(out), str(manifest))
    assert not (tmp_path / "again").exists()  # refused before any page was rendered


def test_a_committed_run_is_finished_later(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    rendered = map_pages(plan(spark), lambda: Tally(tmp_path / "n")).withColumn("generation", F.lit(1))
    target = F.concat_ws("/", "doc_id", "page_num")
    run = stage_images(rendered, out, target, "File save failed: ")
    assert open_runs(out) == {run: True} and list_outputs(spark, out).isEmpty()  # staged, not there yet
    assert publish_run(spark, out, run, "output_path", "File save failed: ").where("page_num > 3").where("success").count() == 8
    conversion = resume_conversion(plan(spark), lambda: Tally(tmp_path / "again"), out, manifest)
    assert open_runs(out) == {} and len(files_under(out)) == 20
    assert conversion.summary["pages"] == 0 and not (tmp_path / "again").exists()
    assert conversion.manifest.where("success").count() == 20
    assert {row["output_path"] for row in conversion.manifest.collect()} == set(files_under(out))


def test_an_uncommitted_run_is_discarded(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    (tmp_path / "out" / "_run-lost" / "images" / "1").mkdir(parents=True)
    (tmp_path / "out" / "_run-lost" / "images" / "1" / "page.png").write_bytes(b"half")
    assert open_runs(out) == {"lost": False}
    done = resume_conversion(plan(spark), lambda: Tally(tmp_path / "n"), out, manifest)
    assert open_runs(out) == {} and done.summary["rendered_pages"] == 20 and len(files_under(out)) == 20


def test_unwritable_pages_and_targets_outside_are_rows(spark, tmp_path):
    out = tmp_path / "out"
    (out / "0").mkdir(parents=True)
    (out / "0" / "png").write_text("a file where a folder is needed")
    pages = plan(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    odd = pages.where("doc_id = '3'").withColumn("doc_id", F.lit(".."))
    manifest = convert_to_files(pages.where("doc_id < '3'").unionAll(odd), lambda: Tally(tmp_path / "n"), str(out), str(tmp_path / "m"))
    rows = {row["doc_id"]: row["success"] for row in manifest.groupBy("doc_id").agg(F.every("success").alias("success")).collect()}
    assert rows == {"0": False, "1": True, "2": True, "..": False}
    assert all(row["error"].startswith("File save failed: ") for row in manifest.where("not success").collect())
    assert not (tmp_path / "png").exists()


def test_objects_are_checked_before_anything_is_rendered(spark, tmp_path):
    settings = {"secret_id": "i", "secret_key": "k", "bucket": None, "region": "r"}
    make = lambda: Tally(tmp_path / "n")
    with pytest.raises(ValueError, match="incomplete: bucket"):
        convert_to_objects(plan(spark), make, str(tmp_path / "o"), str(tmp_path / "m"), settings)
    with pytest.raises(ValueError, match="key_prefix must not be empty"):
        convert_to_objects(plan(spark), make, str(tmp_path / "o"), str(tmp_path / "m"), key_prefix="")
    with pytest.raises(Exception, match="incomplete: bucket"):
        PageWriter({"root": "r", "run": "x", "error": "", "settings": '{"secret_id": "i", "secret_key": "k", "region": "r"}'})
    assert not (tmp_path / "n").exists()
    saved = convert_to_objects(plan(spark), make, str(tmp_path / "o"), str(tmp_path / "m"), settings, {"bucket": "b"}, "k")
    assert {row["object_key"] for row in saved.collect()} == {f"k/{doc}/png/page_{page}.png" for doc in range(4) for page in range(1, 6)}


def test_nothing_planned(spark, tmp_path):
    saved = convert_to_files(plan(spark).where("false"), lambda: Tally(tmp_path / "n"), str(tmp_path / "o"), str(tmp_path / "m"))
    assert saved.count() == 0 and "output_path" in saved.columns


# --- going on ------------------------------------------------------------------


def test_second_run_renders_failed_pages_only(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    convert_to_files(plan(spark), lambda: Tally(tmp_path / "1", failing=(2, 4)), out, manifest)
    second = resume_conversion(plan(spark), lambda: Tally(tmp_path / "2", failing=(4,)), out, manifest)
    assert noted(tmp_path / "2") == Counter(f"{doc}/{page}" for doc in range(4) for page in (2, 4))
    assert (second.summary["pages"], second.summary["rendered_pages"]) == (8, 4)
    # New pages of the plan are to do as well.
    third = resume_conversion(plan(spark, 4, 6), lambda: Tally(tmp_path / "3"), out, manifest)
    assert noted(tmp_path / "3") == Counter(f"{doc}/{page}" for doc in range(4) for page in (4, 6))
    latest = latest_outcomes(third.manifest)
    assert latest.where("success").count() == latest.count() == 24 and pages_to_do(plan(spark, 4, 6), third.manifest).isEmpty()
    generations = {row["page_num"]: row["last"] for row in latest.groupBy("page_num").agg(F.max("generation").alias("last")).collect()}
    assert generations == {1: 1, 2: 2, 3: 1, 4: 3, 5: 1, 6: 3}


def test_latest_outcome_is_one_total_order(spark):
    rows = [(1, 1, "png", 1, True, 5, None), (1, 1, "png", 2, False, None, "x"), (1, 2, "png", 1, False, None, "a"), (1, 2, "png", 1, True, 7, None)]
    manifest = spark.createDataFrame(rows, "doc_id int, page_num int, format string, generation int, success boolean, size_bytes bigint, error string")
    latest = {row["page_num"]: (row["generation"], row["success"], row["size_bytes"]) for row in latest_outcomes(manifest.repartition(3)).collect()}
    assert latest == {1: (2, False, None), 2: (1, True, 7)}


def test_totals_seen_while_writing_are_those_of_the_manifest(spark, tmp_path):
    results = Tables(spark, FOLDER).fx_page_results.withColumn("format", F.lit("png")).withColumn("copies", F.lit(2).cast("bigint"))
    saved, summary = save_manifest(results, str(tmp_path / "m"))
    expected = job_summary(doc_rollup(saved, copies=F.col("copies"))).first().asDict()
    assert summary == {name: expected[name] for name in summary} and summary["avg_ms_per_page"] > 0


# --- order and arrays ----------------------------------------------------------


def test_images_are_not_sorted_by_range(spark, tmp_path):
    notes = tmp_path / "notes"
    ordered = collect_pages(map_pages(plan(spark, 30, 7), lambda: Tally(notes)))
    assert not re.search(r"Exchange rangepartitioning.*\n.*image", initial(ordered))
    rows = [(row["doc_id"], row["page_num"]) for row in ordered.collect()]
    assert rows == sorted(rows) and len(rows) == 210
    assert set(noted(notes).values()) == {1}  # each page was rendered once


def test_order_of_null_repeated_and_hot_pages(spark):
    rows = [(None, 1, True), (None, None, True), (3, None, False)] + [(2, 9, True)] * 500 + [(n, 1, n % 2 == 0) for n in range(40)]
    results = spark.createDataFrame([(*row, 1, 1, b"i", None) for row in rows], "doc_id int, page_num int, success boolean, width int, height int, image binary, error string").repartition(5)
    ordered = collect_pages(results)
    got = [(row["doc_id"], row["page_num"]) for row in ordered.collect()]
    key = lambda pair: [(value is not None, value or 0) for value in pair]
    assert got == sorted(((doc, page) for doc, page, _ in rows), key=key)
    spread = ordered.where("doc_id = 2").groupBy(F.spark_partition_id()).count().count()
    assert spread > 3  # one page with most of the results is in many ranges
    assert collect_pages(results.where("false")).count() == 0


def test_arrays_are_of_equal_length(spark):
    results = spark.range(100_000).selectExpr(
        "1 as doc_id", "1 as page_num", "true as success", "null as error", "1 as width", "1 as height", "id as size_bytes", "1 as render_ms", "1 as encode_ms"
    )
    few = results.limit(700).withColumn("doc_id", F.lit(2))
    sizes = Counter((row["doc_id"], row["n"]) for row in result_arrays(results.unionAll(few)).select("doc_id", F.size("pages").alias("n")).collect())
    assert sizes == {(1, 512): 195, (1, 160): 1, (2, 512): 1, (2, 188): 1}


def test_numbers_along_an_order(spark):
    rows = [(n % 3 if n % 7 else None, n * 37 % 101) for n in range(900)]
    found = numbered(spark.createDataFrame(rows, "kind int, value int").repartition(4), ["kind"], ["value"]).collect()
    for kind in (None, 0, 1, 2):
        mine = sorted((row["position"], row["value"]) for row in found if row["kind"] == kind)
        assert [position for position, _ in mine] == list(range(len(mine)))
        assert [value for _, value in mine] == sorted(value for key, value in rows if key == kind)
    assert numbered(spark.createDataFrame([], "kind int, value int"), [], ["value"]).count() == 0


# --- plans ---------------------------------------------------------------------


def test_gathering_sorts_no_source_rows(spark):
    for name in ("page_plan", "conversion_report", "conversion_plan"):
        assert "SortAggregate" not in initial(WORKLOADS[name].run(spark, FOLDER)), name


def test_values_of_a_page_come_from_one_row(spark):
    requested = spark.createDataFrame([(1, page, 1) for page in range(50)], "doc_id bigint, page_num bigint, copies bigint")
    sizes = [(1, page, float(100 + n % 3), float(n)) for page in range(50) for n in range(9)]
    geometry = spark.createDataFrame(sizes, "doc_id bigint, page_num int, width_pt float, height_pt float").repartition(6)
    outcomes = [(1, page, n % 2 == 0, n if n % 2 == 0 else None, 10 + n, 20 + n) for page in range(50) for n in range(8)]
    results = spark.createDataFrame(outcomes, "doc_id bigint, page_num int, success boolean, size_bytes bigint, render_ms int, encode_ms int").repartition(6)
    rows = gather_pages(requested, None, geometry, results).collect()
    again = gather_pages(requested, None, geometry.repartition(3), results.repartition(2)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == 50
    for row in rows:
        assert row["width_pt"] == 102.0 and row["height_pt"] in (2.0, 5.0, 8.0)
        assert row["success"] and row["render_ms"] == row["size_bytes"] + 10 and row["encode_ms"] == row["size_bytes"] + 20


@pytest.mark.parametrize("parts", [1, 2, 3, 8, 9, 100])
def test_ranges_are_found_by_halving(spark, conf, parts):
    """A row is not held against the border of every range."""
    conf("spark.sql.shuffle.partitions", str(parts))
    rows = [(n * 37 % 101 if n % 9 else None, n % 7, True, 1, 1, b"i", None) for n in range(700)]
    results = spark.createDataFrame(rows, "doc_id int, page_num int, success boolean, width int, height int, image binary, error string").repartition(5)
    ordered = collect_pages(results)
    assert "filter(" not in initial(ordered)
    got = [(row["doc_id"], row["page_num"]) for row in ordered.collect()]
    key = lambda pair: (pair[0] is not None, pair[0] or 0, pair[1])
    assert got == sorted(((doc, page) for doc, page, *_ in rows), key=key)
    counts = [row["count"] for row in ordered.groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) <= 4 * len(rows) / parts + 8
