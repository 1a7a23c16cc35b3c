"""Defined results of the pipeline's filters for clashing names, ids of any type and repeated rows."""

from collections import Counter

import pytest

from folioscale.llm.decontam import contamination_digest, decontaminate, drop_contaminated
from folioscale.llm.line_dedup import drop_repeated_lines, line_digest
from folioscale.llm.neardup import drop_near_duplicates, near_duplicates
from folioscale.llm.quality import clean_documents
from folioscale.llm.warc import archive_pages

PASSAGE = " ".join(f"quiz{n}" for n in range(40))
CLASHING = (
    "kept string, _id int, _hash string, _words int, _lines string, _hashes string, _judged int, _windows int, _removed string, "
    "_text_hash string, row string, own_id int, own_hash string, gone string, id int, hash string, text_hash string, "
    "cleaned_text string, n_words string, component string, matches string, contaminated string, unnamed int, first string, copies int"
)


def prose(name):
    return "\n".join(" ".join(f"{name}word{n}" for n in range(at, at + 10)) + "." for at in range(0, 80, 10))


def clash_values(number):
    return [number * 31 + at if part.strip().endswith(" int") else f"own{number}-{at}" for at, part in enumerate(CLASHING.split(","))]


def corpus(spark, as_text=False):
    texts = {1: prose("a"), 2: prose("b"), 3: prose("a"), 4: f"{prose('c')}\n{PASSAGE}.", 5: f"Home | Login\n{prose('d')}", 6: prose("e")}
    kind = "string" if as_text else "bigint"
    rows = [(f"doc-{n}" if as_text else n, text, *clash_values(n)) for n, text in texts.items()]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, {CLASHING}").repartition(3)


def stages(spark):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    return {
        "quality": clean_documents,
        "lines": drop_repeated_lines,
        "near": drop_near_duplicates,
        "benchmark": lambda docs: drop_contaminated(docs, benchmark),
    }


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("stage, lost", [("quality", set()), ("lines", set()), ("near", {3}), ("benchmark", {4})])
def test_other_columns_come_back_as_they_were(spark, stage, lost, as_text):
    docs = corpus(spark, as_text)
    result = stages(spark)[stage](docs)
    assert result.columns == docs.columns and result.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = {row["doc_id"]: row for row in result.collect()}
    name = (lambda n: f"doc-{n}") if as_text else (lambda n: n)
    assert set(rows) == {name(n) for n in range(1, 7) if n not in lost}
    for n in set(range(1, 7)) - lost:
        assert list(rows[name(n)])[2:] == clash_values(n)
    if stage == "quality":
        assert "Home" not in rows[name(5)]["text"]
    if stage == "lines":
        assert rows[name(3)]["text"] == "" and rows[name(1)]["text"] == prose("a")


def test_queries_take_ids_of_any_type(spark):
    docs = corpus(spark, as_text=True)
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    components = {row["doc_id"]: row["component_id"] for row in near_duplicates(docs).collect()}
    assert components["doc-3"] == "doc-1" and components["doc-2"] == "doc-2"
    found = {row["doc_id"]: row["contaminated"] for row in contamination_digest(decontaminate(docs, benchmark)).collect()}
    assert [doc for doc, bad in found.items() if bad] == ["doc-4"]
    assert {row["doc_id"]: row["n_removed"] for row in line_digest(docs).collect()}["doc-3"] == 8


def test_one_row_of_each_group_stays(spark):
    same, near = prose("a"), prose("a").replace("aword7 ", "other7 ")
    rows = [(1, same)] * 300 + [(1, near), (1, near), (2, same), (None, same), (None, same)]
    rows += [(None, prose("b"))] * 3 + [(None, prose("c")), (7, prose("d")), (8, ""), (8, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    left = Counter(map(tuple, drop_near_duplicates(docs).collect()))
    assert sum(left.values()) == 8 and set(left.values()) == {1, 2}
    assert left[(8, "")] == 2 and left[(None, None)] == 2  # without words: in no group
    assert left[(None, prose("b"))] == left[(None, prose("c"))] == left[(7, prose("d"))] == 1
    assert sum(left[(1, text)] for text in (same, near)) == 1 and left[(2, same)] == left[(None, same)] == 0
    assert drop_near_duplicates(docs.where("false")).count() == 0


def test_page_ids_are_read_from_the_head_only(spark):
    html = "<html>\r\nX-Page-Id: 77\r\n\r\nx</html>"
    rows = [(None, "http://a.example/", html), (5, "http://b.example/", html), (6, "u" * 5000, "\r\nX-Page-Id: 9\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted((row["page_id"] for row in archive_pages(pages).collect()), key=str) == [5, 6, None]
