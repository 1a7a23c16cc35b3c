"""Operators against brute force on small inputs, hot keys included."""

import random
from collections import Counter, OrderedDict, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscale.operators.cache import block_first_touch, blocks_of_read, cache_attribution, stream_stats
from folioscale.operators.correlate import correlate_requests, unmatched_responses
from folioscale.operators.geometry import plan_page_size, scan_detection, side_limit
from folioscale.operators.page_table import gather_pages, repeat_copies, requested_pages
from folioscale.operators.pages import expand_pages, explode_range, first_n_existing, first_n_pages, invalid_page_audit
from folioscale.operators.results import (
    doc_rollup,
    error_rollup,
    job_summary,
    page_arrays,
    page_status_rows,
    success_averages,
)

BLOCK = 256 * 1024


def bag(frame):
    return Counter(tuple(row) for row in frame.collect())


# --- page selection ----------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents 0..39; document 7 gets a third of all requests, mostly for
    the same page, and some documents get none or only invalid ones."""
    rng = random.Random(1)
    docs = {doc: rng.randrange(0, 12) for doc in range(40)}
    docs[7] = 11
    requests = [(rng.randrange(0, 45), rng.randrange(-1, 14)) for _ in range(400)]
    requests = [(doc, page) for doc, page in requests if doc % 5 != 3] + [(13, 99)]
    requests += [(7, 2)] * 180 + [(7, 5)] * 20
    return (
        docs,
        requests,
        spark.createDataFrame(list(docs.items()), "doc_id bigint, num_pages int"),
        spark.createDataFrame(requests, "doc_id bigint, page_num int").repartition(6),
    )


def expected_pages(docs, requests):
    listed = {doc for doc, _ in requests}
    picked = [(doc, page) for doc, page in requests if doc in docs and 1 <= page <= docs[doc]]
    whole = [(doc, page) for doc, n in docs.items() if doc not in listed for page in range(1, n + 1)]
    return Counter(picked + whole)


def test_expand_pages(corpus):
    docs, requests, docs_df, requests_df = corpus
    result = expand_pages(docs_df, requests_df).select("doc_id", "page_num")
    assert bag(result) == expected_pages(docs, requests)


@pytest.mark.parametrize("hot_copies", [1, 7, 1 << 20])
def test_gathered_copies_are_the_requests(corpus, hot_copies):
    docs, requests, docs_df, requests_df = corpus
    pages = gather_pages(requested_pages(docs_df, requests_df))
    assert pages.count() == pages.select("doc_id", "page_num").distinct().count()
    valid = pages.join(docs_df, "doc_id").where("page_num between 1 and num_pages").drop("num_pages")
    assert bag(repeat_copies(valid, hot_copies).select("doc_id", "page_num")) == expected_pages(docs, requests)


def test_invalid_page_audit(corpus):
    docs, requests, docs_df, requests_df = corpus
    audit = invalid_page_audit(docs_df, requests_df)
    expected = Counter()
    for doc, page in requests:
        total = docs.get(doc, 0)
        valid = 1 <= page <= total
        expected[(doc, page, total, valid, None if valid else f"Invalid page number: {page} (total: {total})")] += 1
    assert bag(audit) == expected


def test_explode_range_is_whole(spark):
    ranges = [(0, 1, 10_000), (1, 5, 4), (2, -9000, -1), (3, 4095, 4096), (4, 7, 7)]
    frame = spark.createDataFrame(ranges, "i int, a bigint, b bigint")
    result = explode_range(frame, F.col("a"), F.col("b"), "x").select("i", "x")
    assert bag(result) == Counter((i, x) for i, a, b in ranges for x in range(a, b + 1))


def test_first_n(spark, corpus):
    docs, _, docs_df, _ = corpus
    assert bag(first_n_pages(docs_df, 3).select("doc_id", "page_num")) == Counter(
        (doc, page) for doc, n in docs.items() for page in range(1, min(n, 3) + 1)
    )
    pages = spark.createDataFrame([(1, p) for p in (5, 9, 2, 7)] + [(2, 4)], "doc_id int, page_num int")
    assert bag(first_n_existing(pages, 2)) == Counter([(1, 2), (1, 5), (2, 4)])


# --- sizes -------------------------------------------------------------------


def size_model(width, height, target, limit):
    """The same steps in numpy 32-bit floats."""
    f = np.float32

    def half_up(value):
        return int(np.floor(f(value).astype(np.float64) + 0.5))

    scale = min(f(target) / f(width), f(4.0))
    w, h = half_up(f(width) * scale), half_up(f(height) * scale)
    if w > limit or h > limit:
        shrink = min(*(f(limit) / f(side) if side > limit else f(1.0) for side in (w, h)))
        scale = f(scale * shrink)
        w, h = half_up(f(width) * scale), half_up(f(height) * scale)
    return w, h


@pytest.mark.parametrize("mode", ["encoded", "raw"])
def test_page_size_model(spark, mode):
    rng = np.random.default_rng(3)
    points = np.exp(rng.uniform(np.log(1.0), np.log(60_000.0), (3000, 2))).astype(np.float32)
    formats = ["webp", "png", "jpg"]
    rows = [
        (i, float(w), float(h), formats[i % 3], i % 4 == 0, 640 + i % 5 * 160) for i, (w, h) in enumerate(points)
    ]
    frame = spark.createDataFrame(rows, "i int, width_pt float, height_pt float, format string, is_scan boolean, t int")
    sized = plan_page_size(frame, side_limit(F.col("format"), mode), target_width=F.col("t"))
    actual = {row["i"]: (row["width"], row["height"]) for row in sized.collect()}
    clamped = 0
    for i, w, h, fmt, scan, target in rows:
        limit = 16383 if fmt == "webp" and mode == "encoded" else 32767
        expected = size_model(w, h, 1024 if scan else target, limit)
        clamped += max(expected) == limit
        assert actual[i] == expected, rows[i]
    assert clamped > 50


def test_requested_width_is_honoured(spark):
    page = spark.createDataFrame([(612.0, 792.0, False)], "width_pt float, height_pt float, is_scan boolean")
    row = plan_page_size(page, side_limit(F.lit("webp")), target_width=800).first()
    assert (row["width"], row["height"]) == (800, 1035)


def test_zero_width_page(spark):
    page = spark.createDataFrame([(0.0, 100.0, False)], "width_pt float, height_pt float, is_scan boolean")
    row = plan_page_size(page, side_limit(F.lit("png"))).first()
    assert (row["width"], row["height"]) == (0, 400)


def test_scan_detection(spark):
    objects = [(1, 1, "Image"), (1, 1, "Path"), (1, 2, "Image"), (1, 2, "Text"), (1, 3, "Path")]
    frame = spark.createDataFrame(objects, "doc_id int, page_num int, object_type string")
    assert {row["page_num"]: row["is_scan"] for row in scan_detection(frame).collect()} == {1: True, 2: False, 3: False}


# --- cache -------------------------------------------------------------------


def random_trace(rng, reads, tasks, blocks, hot=None):
    rows = []
    for seq in range(reads):
        task = hot if hot is not None and seq % 3 == 0 else rng.randrange(tasks)
        # Half of the reads stay near a moving point, so that hits do occur.
        block = rng.randrange(blocks) if seq % 2 else (seq // 40) % blocks
        pos = block * BLOCK + rng.randrange(BLOCK)
        rows.append((task, seq, pos, rng.randrange(0, 3 * BLOCK), blocks * BLOCK - 100))
    return rows


def replay(trace, capacity):
    caches, evictions, touches = defaultdict(OrderedDict), 0, []
    for task, seq, pos, length, size in sorted(trace, key=lambda read: (read[0], read[1])):
        if pos >= size or length <= 0:
            continue
        cache = caches[task]
        for block in range(pos // BLOCK, (min(pos + length, size) - 1) // BLOCK + 1):
            hit = block in cache
            if not hit and len(cache) >= capacity:
                cache.popitem(last=False)
                evictions += 1
            cache[block] = True
            cache.move_to_end(block)
            touches.append((task, seq, block * BLOCK, hit, 0 if hit else min(BLOCK, size - block * BLOCK)))
    return Counter(touches), evictions


TRACE = "task_id bigint, seq bigint, pos bigint, len bigint, file_size bigint"


@pytest.mark.parametrize("capacity, chunk", [(4, 1 << 23), (4, 25), (9, 100), (1, 10), (30, 7)])
def test_cache_attribution_is_lru(spark, capacity, chunk):
    trace = random_trace(random.Random(capacity * chunk), 1500, 5, 24, hot=2)
    expected, evictions = replay(trace, capacity)
    frame = spark.createDataFrame(trace, TRACE).repartition(5)
    assert bag(cache_attribution(frame, capacity, chunk)) == expected
    # Whether anything was evicted shows that the capacity mattered at all.
    assert evictions > 0 or capacity >= 24


def test_one_block_over_many_chunks(spark):
    """A block touched only long ago is still held when little else was."""
    trace = [(1, 0, 0, 10, 10 * BLOCK)] + [(1, seq, BLOCK, 10, 10 * BLOCK) for seq in range(1, 99)]
    trace += [(1, 99, 5, 10, 10 * BLOCK)]
    attributed = cache_attribution(spark.createDataFrame(trace, TRACE), 2, 10)
    assert bag(attributed) == replay(trace, 2)[0]
    assert attributed.where("seq = 99").first()["hit"]


def test_stream_stats_and_first_touch(spark):
    trace = random_trace(random.Random(5), 600, 4, 20)
    frame = spark.createDataFrame(trace, TRACE)
    touches, _ = replay(trace, 8)
    expected = {}
    for (task, _, _, hit, fetched), n in touches.items():
        hits, misses, total = expected.get(task, (0, 0, 0))
        expected[task] = (hits + n * hit, misses + n * (not hit), total + n * fetched)
    for row in stream_stats(cache_attribution(frame, 8)).collect():
        assert (row["cache_hits"], row["cache_misses"], row["total_bytes_fetched"]) == expected[row["task_id"]]
        assert row["total_requests"] == row["cache_misses"]
    first = {}
    for task, seq, block, *_ in sorted(touches):
        first.setdefault((task, block), seq)
    assert {(r["task_id"], r["block_offset"]): r["first_seq"] for r in block_first_touch(frame).collect()} == first
    assert blocks_of_read(frame).count() == sum(touches.values())


# --- request logs ------------------------------------------------------------


def correlate_model(requests, responses, timeout):
    by_id = defaultdict(list)
    for request_id, recv, ok, size in responses:
        if request_id is not None:
            by_id[request_id].append((recv, not ok, 1 if size is None else -size))
    rows = []
    for request_id, sent in set(requests):
        found = [r for r in by_id[request_id] if sent <= r[0] <= sent + timeout]
        recv, failed, size = min(found, default=(None, None, None))
        superseded = recv is not None and any(i == request_id and sent < again <= recv for i, again in requests)
        if recv is not None and not superseded:
            rows.append((request_id, sent, recv, None if size == 1 else -size, "error" if failed else "ok"))
        else:
            rows.append((request_id, sent, None, None, "timeout"))
    return rows


def test_correlation_with_hot_id(spark):
    rng = random.Random(9)
    timeout = 300
    requests = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.randrange(0, 30_000)) for _ in range(900)] + [(8, -500)]
    responses = [
        (
            rng.choice([1, 1, 1, 2, 3, 5, None]),
            rng.randrange(-100, 31_000),
            rng.choice([True, True, True, False, None]),
            rng.choice([None, 0, 1, 2, 3]),
        )
        for _ in range(900)
    ] + [(8, -250, True, 3), (8, -250, False, 9), (8, -250, True, 3)]
    asked = spark.createDataFrame(requests, "request_id bigint, sent_ms bigint")
    answered = spark.createDataFrame(responses, "request_id bigint, recv_ms bigint, ok boolean, bytes bigint")
    expected = correlate_model(requests, responses, timeout)
    assert bag(correlate_requests(asked, answered, timeout)) == Counter(expected)

    used = {(i, recv, status == "ok", size) for i, _, recv, size, status in expected if status != "timeout"}
    left = Counter((i, recv, bool(ok), size) for i, recv, ok, size in responses)
    left.subtract(used)
    assert bag(unmatched_responses(asked, answered, timeout)) == +left


def test_one_response_answers_the_latest_request(spark):
    asked = spark.createDataFrame([(1, 0), (1, 1000), (2, 0), (None, 0)], "request_id bigint, sent_ms bigint")
    answers = [(1, 2000, True, 5), (2, 9, None, None), (None, 1, True, 1)]
    answered = spark.createDataFrame(answers, "request_id bigint, recv_ms bigint, ok boolean, bytes bigint")
    expected = [(1, 0, None, None, "timeout"), (1, 1000, 2000, 5, "ok"), (2, 0, 9, None, "error"), (None, 0, None, None, "timeout")]
    assert bag(correlate_requests(asked, answered)) == Counter(expected)
    assert bag(unmatched_responses(asked, answered)) == Counter([(None, 1, True, 1)])


# --- results -----------------------------------------------------------------

RESULT = (
    "doc_id int, page_num int, success boolean, error string, width int, height int, "
    "size_bytes bigint, render_ms int, encode_ms int"
)


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [
            (1, 2, True, None, 10, 20, 100, 5, None),
            (1, 1, True, None, 10, 20, 50, None, 3),
            (1, 3, False, "Failed to render page: x", 0, 0, None, 7, None),
            (2, 1, False, "boom", 0, 0, None, None, None),
            (2, 1, False, "boom", 0, 0, None, None, None),
        ],
        RESULT,
    )


def test_rollups(results):
    rollup = {row["doc_id"]: row for row in doc_rollup(results).collect()}
    one = rollup[1]
    assert (one["pages"], one["rendered_pages"], one["output_bytes"], one["render_ms"], one["encode_ms"]) == (3, 2, 150, 12, 3)
    assert (one["success"], one["all_pages_ok"]) == (True, False)
    assert rollup[2]["success"] and rollup[2]["rendered_pages"] == 0
    total = job_summary(doc_rollup(results)).first()
    assert (total["documents"], total["pages"], total["total_ms"], total["avg_ms_per_page"]) == (2, 5, 15, 8)
    averages = success_averages(results).first()
    assert (averages["avg_render_ms"], averages["avg_encode_ms"]) == (2.5, 1.5)
    assert bag(error_rollup(results)) == Counter([("render", 1), ("other", 2)])


def test_no_page_rendered(results):
    none = doc_rollup(results.where("doc_id = 2"))
    assert job_summary(none).first()["avg_ms_per_page"] is None
    assert success_averages(results.where("doc_id = 2")).first()["avg_render_ms"] is None


def test_page_arrays(results):
    rows = page_arrays(results, 2).orderBy("doc_id", "part").collect()
    assert [(row["doc_id"], row["part"], [(p["page_num"], p["copies"]) for p in row["pages"]]) for row in rows] == [
        (1, 0, [(1, 1), (2, 1)]), (1, 1, [(3, 1)]), (2, 0, [(1, 2)]),
    ]


def test_page_status_rows(spark):
    raw = spark.createDataFrame(
        [(1, 1, True, None, 5, 6, 7, 8, None), (1, 2, None, "", 5, 6, 7, 8, 9)], RESULT
    )
    done, failed = page_status_rows(raw).orderBy("page_num").collect()
    assert (done["success"], done["width"], done["size_bytes"], done["encode_ms"]) == (True, 5, 7, 0)
    assert (failed["success"], failed["error"], failed["width"], failed["size_bytes"]) == (False, "Render failed", 0, None)
    assert (failed["render_ms"], failed["encode_ms"]) == (8, 0)
