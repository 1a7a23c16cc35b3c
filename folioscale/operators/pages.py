"""Choosing pages: which page of which document is to be converted.

Documents carry ``doc_id, num_pages``; requests carry ``doc_id, page_num``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscale.constants import BENCH_FORMATS, BENCH_MAX_PAGES, INVALID_PAGE
from folioscale.functions._util import floor_div

_RUN = 4096


def explode_range(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per integer in ``first..last`` (none if ``last < first``).

    Two explodes in a row, so that no array holds more than ``_RUN`` numbers
    plus one number per ``_RUN`` of the range, however long the range is.
    """
    df = df.withColumns({"_first": first.cast("bigint"), "_last": last.cast("bigint")})
    df = df.where(F.col("_first") <= F.col("_last"))
    df = df.withColumn(
        "_run", F.explode(F.sequence(floor_div(F.col("_first"), _RUN), floor_div(F.col("_last"), _RUN)))
    )
    low = F.greatest(F.col("_first"), F.col("_run") * _RUN)
    high = F.least(F.col("_last"), F.col("_run") * _RUN + (_RUN - 1))
    return df.withColumn(name, F.explode(F.sequence(low, high))).drop("_first", "_last", "_run")


def valid_pages(pages: DataFrame) -> DataFrame:
    """Keep requested pages that exist; the others are dropped silently."""
    return pages.where(F.col("page_num").between(F.lit(1), F.col("num_pages")))


def expand_pages(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages to convert: all pages of documents nobody listed pages for, else
    the listed pages that exist, with repetitions.

    A document whose listed pages are all invalid yields nothing. The inner
    join can be split by AQE when one document has most of the requests; the
    anti join cannot, so its right side is made distinct before the shuffle.
    Both joins read the same documents, hence share one exchange of them.
    """
    docs = docs.where(F.col("num_pages") >= 1)
    listed = requests.select("doc_id").distinct()
    whole = explode_range(
        docs.join(listed, "doc_id", "left_anti"), F.lit(1), F.col("num_pages"), "page_num"
    )
    picked = valid_pages(docs.join(requests.select("doc_id", "page_num"), "doc_id"))
    return whole.unionByName(picked).withColumn("page_num", F.col("page_num").cast("int"))


def invalid_page_audit(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with ``valid`` and, where the page does not exist, the
    error text the strict mode gives. Unknown documents count as empty."""
    num_pages = F.coalesce(F.col("num_pages"), F.lit(0))
    valid = F.col("page_num").between(F.lit(1), num_pages)
    message = F.concat(
        F.lit(INVALID_PAGE[0]),
        F.col("page_num").cast("string"),
        F.lit(INVALID_PAGE[1]),
        num_pages.cast("string"),
        F.lit(INVALID_PAGE[2]),
    )
    return requests.join(docs.select("doc_id", "num_pages"), "doc_id", "left").select(
        "doc_id",
        "page_num",
        num_pages.alias("num_pages"),
        valid.alias("valid"),
        F.when(~valid, message).alias("error"),
    )


def first_n_pages(docs: DataFrame, n: int = BENCH_MAX_PAGES) -> DataFrame:
    """The first ``min(n, num_pages)`` pages of every document."""
    last = F.least(F.lit(n), F.col("num_pages"))
    return explode_range(docs, F.lit(1), last, "page_num").withColumn(
        "page_num", F.col("page_num").cast("int")
    )


def first_n_existing(pages: DataFrame, n: int = BENCH_MAX_PAGES) -> DataFrame:
    """The same for a table of pages. The row-number limit is also applied
    before the shuffle, so at most ``n`` rows per document and task travel."""
    order = Window.partitionBy("doc_id").orderBy("page_num")
    return pages.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def format_matrix(docs: DataFrame, formats: Sequence[str] = BENCH_FORMATS) -> DataFrame:
    """Every document once per output format; a projection, no join."""
    return docs.withColumn("format", F.explode(F.array(*[F.lit(name) for name in formats])))


def attach_options(pages: DataFrame, options: DataFrame, key: str = "job_id") -> DataFrame:
    """Copy each job's options to its rows; jobs without any keep NULLs.

    No broadcast hint: options grow with the number of jobs, so the size
    Spark measures decides, and a job with very many rows can be split.
    """
    return pages.join(options, key, "left")


def order_pages(pages: DataFrame) -> DataFrame:
    """Rows by document and page."""
    return pages.orderBy("doc_id", "page_num")
