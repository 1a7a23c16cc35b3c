"""Literal cases for column functions."""

import math
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folioscale import functions as fn
from folioscale.constants import BLOCK_BYTES


def one(spark, column, **values):
    """Value of a column over one row."""
    row = spark.range(1).select(*[F.lit(value).alias(name) for name, value in values.items()])
    return row.select(column.alias("value")).first()["value"]


def column(spark, values, ddl, expression):
    """The expression over a column ``x`` of values, in order."""
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {ddl}")
    return [row["y"] for row in frame.select("i", expression.alias("y")).orderBy("i").collect()]


def test_input_kind_is_case_sensitive(spark):
    values = ["http://a/b.pdf", "https://a", "HTTP://a", "/x.pdf", "ftp://a", None]
    assert column(spark, values, "string", fn.classify_input("x")) == ["url", "url", "file", "file", "file", None]


def test_formats(spark):
    values = ["WebP", "PNG", "jpg", "JPEG", "tiff", None, ""]
    assert column(spark, values, "string", fn.normalize_format("x")) == ["webp", "png", "jpg", "jpeg", None, "webp", None]
    assert column(spark, values, "string", fn.lenient_format("x")) == ["webp", "png", "jpg", "jpg", "webp", "webp", "webp"]
    assert column(spark, ["jpeg", "jpg", "png"], "string", fn.format_extension("x")) == ["jpg", "jpg", "png"]
    assert column(spark, ["jpeg", "png", "gif"], "string", fn.format_mime("x")) == ["image/jpeg", "image/png", "image/webp"]
    error = one(spark, fn.format_error("x"), x="gif")
    assert error == "Unsupported format: gif. Supported formats: webp, png, jpg, jpeg"


@pytest.mark.parametrize(
    "text, pages",
    [
        ("3, 5abc,2-4,x,-1,0", [3, 5, 2]),
        ("abc", []),
        ("", []),
        (None, []),
        ("+7,\t8 , 9", [7, 8, 9]),
        ("99999999999", [99999999999]),
        ("1" + "0" * 30, [2**63 - 1]),
        ("-1" + "0" * 30, []),
        ("1.9,1e3", [1, 1]),
    ],
)
def test_page_list(spark, text, pages):
    assert column(spark, [text], "string", fn.parse_page_list("x")) == [pages]


def _leading_int(part):
    part = part.strip()
    sign, digits = 1, ""
    if part[:1] in ("+", "-"):
        sign, part = (-1 if part[0] == "-" else 1), part[1:]
    for char in part:
        if char not in "0123456789":
            break
        digits += char
    return sign * int(digits) if digits else None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789,-+ ax", max_size=24), min_size=1, max_size=40))
def test_page_list_model(spark, texts):
    def model(text):
        numbers = [_leading_int(part) for part in text.split(",")]
        return [min(number, 2**63 - 1) for number in numbers if number is not None and number > 0]

    assert column(spark, texts, "string", fn.parse_page_list("x")) == [model(text) for text in texts]


def _fixed(value: Fraction, digits: int) -> str:
    """Rounded half up to a fixed number of decimals, from the exact value."""
    scaled = math.floor(value * 10**digits + Fraction(1, 2))
    return str((Decimal(scaled) / 10**digits).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _bytes_model(size: int) -> str:
    if size < 1024:
        return f"{size} B"
    power = min(3, (size.bit_length() - 1) // 10)
    text = _fixed(Fraction(size, 1024**power), 2).rstrip("0").rstrip(".")
    return f"{text} {['B', 'KB', 'MB', 'GB'][power]}"


def test_format_bytes(spark):
    sizes = [0, 1, 1023, 1024, 1152, 1029, 1536, 2**20 - 1, 2**20, 2**30 - 1, 2**30, 5 * 2**40, 2**53 + 1, 2**62]
    sizes += [1024 + 128 * k for k in range(40)] + [2**20 + 5243 * k for k in range(60)]
    texts = column(spark, sizes, "bigint", fn.format_bytes("x"))
    assert texts == [_bytes_model(size) for size in sizes]
    assert texts[:5] == ["0 B", "1 B", "1023 B", "1 KB", "1.13 KB"]


def test_format_size(spark):
    sizes = [0, 1023, 1024, 1024 + 51, 2**20 - 1, 2**20, 992_500, 80_000_000, 2**40]
    assert column(spark, sizes, "bigint", fn.format_size("x")) == [
        "0 B", "1023 B", "1.0 KB", "1.0 KB", "1024.0 KB", "1.0 MB", "969.2 KB", "76.3 MB", "1048576.0 MB",
    ]


def test_times(spark):
    times = list(range(990, 1400)) + list(range(123_000, 126_000, 5)) + [1_000_000]
    expected = [f"{t} ms" if t < 1000 else f"{_fixed(Fraction(t / 1000), 2)} s" for t in times]
    assert column(spark, times, "bigint", fn.format_time("x")) == expected
    assert column(spark, [5, 1125, 1005], "bigint", fn.format_duration("x")) == ["5ms", "1.13s", "1.00s"]
    assert column(spark, [2.5, 999.6, 1234.5], "double", fn.format_time("x")) == ["3 ms", "1000 ms", "1.23 s"]


def test_names(spark):
    names = ["a.pdf", "a.pdf.pdf", "x.PDF", ".pdf", "a.pdfx", "plain"]
    assert column(spark, names, "string", fn.strip_pdf("x")) == ["a", "a.pdf", "x.PDF", "", "ax", "plain"]
    paths = ["/a/b.pdf", "b", "/a/b/", "/", "", "https://h/x.pdf"]
    assert column(spark, paths, "string", fn.base_name("x")) == ["b.pdf", "b", "b", "", "", "x.pdf"]
    assert column(spark, ["x" * 20, "y" * 21], "string", fn.short_name("x")) == ["x" * 20, "y" * 17 + "..."]
    assert one(spark, fn.sink_path("d", F.lit("page"), F.lit(3), F.lit("jpeg")), d="out") == "out/page_3.jpg"
    assert one(spark, fn.sink_key("d", F.lit(3), F.lit("webp")), d="k/1") == "k/1/page_3.webp"


def test_uri_components(spark):
    texts = ["a b+c&d", "!~*'()-_.", "发票 (1).pdf", "100%/?#"]
    encoded = ["a%20b%2Bc%26d", "!~*'()-_.", "%E5%8F%91%E7%A5%A8%20(1).pdf", "100%25%2F%3F%23"]
    assert column(spark, texts, "string", fn.encode_component("x")) == encoded
    assert column(spark, encoded, "string", fn.decode_component("x")) == texts
    assert column(spark, ["a+b", "%zz"], "string", fn.decode_component("x")) == ["a+b", None]


def test_blocks(spark):
    positions = [0, 100, BLOCK_BYTES, BLOCK_BYTES + 100]
    assert column(spark, positions, "bigint", fn.block_offset("x")) == [0, 0, BLOCK_BYTES, BLOCK_BYTES]
    size = BLOCK_BYTES + 10
    assert column(spark, [0, BLOCK_BYTES, size + BLOCK_BYTES], "bigint", fn.block_fetch_size("x", F.lit(size))) == [
        BLOCK_BYTES, 10, None,
    ]
    assert one(spark, fn.block_range_header("x", F.lit(10)), x=5) == "bytes=5-14"


def test_request_ids(spark):
    packed = one(spark, fn.request_id_pack("t", "s"), t=65536 + 40000, s=65536 + 7)
    assert packed == 40000 << 16 | 7
    assert one(spark, fn.request_task("x"), x=packed) == 40000
    assert one(spark, fn.request_seq("x"), x=packed) == 7


def test_http(spark):
    assert column(spark, [199, 200, 299, 300], "int", fn.http_ok("x")) == [False, True, True, False]
    assert column(spark, [200, 206], "int", fn.http_ok("x", ranged=True)) == [False, True]
    assert one(spark, fn.http_error("s", F.lit("Not Found")), s=404) == "Failed to download file: 404 Not Found"
    missing = fn.http_error("s", F.lit("OK"), F.lit(None).cast("bigint"))
    assert one(spark, missing, s=200) == "Server did not return Content-Length header"


@pytest.mark.parametrize(
    "found, method, header, expected",
    [
        (False, "GET", "bytes=0-1", (404, None, None, None)),
        (True, "HEAD", "bytes=0-1", (200, None, None, 1000)),
        (True, "GET", None, (200, None, None, 1000)),
        (True, "GET", "", (200, None, None, 1000)),
        (True, "GET", "bytes=10-19", (206, 10, 19, 10)),
        (True, "GET", "bytes=10-", (206, 10, 999, 990)),
        (True, "GET", "bytes=-5", (206, None, 5, None)),
    ],
)
def test_range_response(spark, found, method, header, expected):
    answer = fn.range_response(F.lit(found), F.lit(method), F.lit(header).cast("string"), F.lit(1000))
    assert tuple(spark.range(1).select(answer.alias("a")).first()["a"]) == expected


OPTION_SCHEMA = (
    "format string, target_width int, quality int, webp_quality int, webp_method int, "
    "jpeg_quality int, png_compression int, detect_scan boolean"
)


def test_option_defaults(spark):
    frame = spark.createDataFrame(
        [(None,) * 8, ("BMP", 800, 50, 0, 0, 0, 0, None), ("png", 800, 0, None, 6, None, 9, False)], OPTION_SCHEMA
    )
    rows = frame.select(
        fn.convert_options().alias("convert"), fn.merged_options().alias("merged"), fn.native_options().alias("native")
    ).collect()
    empty, zeros, mixed = rows
    assert empty.convert.asDict() == dict(
        format="webp", target_width=1280, scan_width=1024, max_scale=4.0, detect_scan=False,
        webp_quality=80, webp_method=4, jpeg_quality=85, png_compression=6,
    )
    assert (empty.merged.detect_scan, empty.merged.jpeg_quality) == (True, 85)
    assert (empty.native.detect_scan, empty.native.jpeg_quality, empty.native.png_effort) == (True, 80, "default")
    assert (zeros.convert.webp_quality, zeros.merged.webp_quality, zeros.native.jpeg_quality) == (50, 0, 0)
    assert (zeros.convert.format, zeros.merged.format, zeros.native.format) == (None, "BMP", "webp")
    assert (zeros.convert.webp_method, zeros.native.png_effort) == (0, "fast")
    assert (mixed.convert.webp_quality, mixed.merged.webp_quality, mixed.native.png_effort) == (80, 0, "best")


def test_options_out_of_range(spark):
    frame = spark.createDataFrame([("png", 800, 256, 101, 7, -1, 6, None)], OPTION_SCHEMA)
    assert frame.select(fn.out_of_range_options().alias("bad")).first()["bad"] == [
        "quality", "webp_quality", "webp_method", "jpeg_quality",
    ]


def test_missing_sink_fields(spark):
    frame = spark.createDataFrame([(None, "", "b", "r")], "secret_id string, secret_key string, bucket string, region string")
    assert frame.select(fn.missing_sink_fields().alias("m")).first()["m"] == ["secret_id", "secret_key"]
    fallback = fn.missing_sink_fields({"secret_id": F.lit("x"), "secret_key": F.lit("")})
    assert frame.select(fallback.alias("m")).first()["m"] == ["secret_key"]
