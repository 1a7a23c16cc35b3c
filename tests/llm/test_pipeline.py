"""The pipeline against a brute-force version of its five stages."""

import re

import pytest

import corpus_pipeline
from folioscale.llm.pieces import MODEL

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = " ".join(f"quiz{n}" for n in range(60))


def prose(name, width=10):
    words = [f"{name}word{n}" for n in range(79)] + ["end."]
    return "\n".join(" ".join(words[at : at + width]) for at in range(0, 80, width))


def corpus():
    texts = {number: prose(f"d{number}") for number in range(10)}
    texts[10] = texts[0]
    texts[11] = prose("d1", 7)  # same words, other lines
    texts[12] = f"Home | Login\n{prose('d12')}\nClick here to continue reading"
    texts[13] = "too short"
    texts[14] = None
    texts[15] = "over and over " * 60
    texts[16] = f"{prose('d16')}\n{PASSAGE}"
    texts[17] = "### $$$ %%% &&&\n" * 60 + prose("d17")
    texts[18] = ""
    texts[19] = "\n".join(line.replace("word4", "edit4") for line in prose("d2").split("\n"))
    return [(number, text, None if number % 2 else "en", "web", len(text or "")) for number, text in texts.items()]


def line_fails(line):
    words, symbols = WORD.findall(line), sum(sign in "#*$%&|<>" for sign in line)
    starts = re.match(r"\W*(home|menu|next|login|click here)\b", line, re.I)
    return symbols >= 3 and symbols * 5 > len(words) or len(words) <= 8 and bool(starts) and not line.rstrip().endswith(".")


def after_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[at : at + 3]) for at in range(len(words) - 2)]
    again = {at + k for at, window in enumerate(windows) if windows.count(window) > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(again) > 50 * len(words):
        return None
    left = "\n".join(line for line in text.split("\n") if not line_fails(line))
    return left if 2 * len(WORD.findall(left)) >= len(words) else None


def similar(one, other):
    return bool(one and other) and 100 * len(one & other) >= 80 * len(one | other)


def brute_force():
    docs = {number: after_quality(text) for number, text, *_ in corpus()}
    docs = {number: text for number, text in docs.items() if text is not None}
    earlier = []
    for number in sorted(docs):
        kept = []
        for line in docs[number].split("\n"):
            words = set(WORD.findall(line))
            if not any(similar(words, other) for other in earlier):
                kept.append(line)
            earlier.append(words)
        docs[number] = "\n".join(kept)
    grams = {}
    for number, text in docs.items():
        words = WORD.findall(text.lower())
        grams[number] = {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()
    label = {number: number for number in docs}
    for _ in docs:
        for one in docs:
            for other in docs:
                if similar(grams[one], grams[other]):
                    label[one] = label[other] = min(label[one], label[other])
    return {number: text for number, text in docs.items() if label[number] == number and PASSAGE not in text.replace("\n", " ")}


def written(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, PASSAGE), (2, None), (3, "a question about rivers and lakes in early spring")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = brute_force()
    assert {10, 12} <= set(expected) and not {11, 13, 14, 15, 16, 18} & set(expected)
    found = {row["doc_id"]: row["n_tokens"] for row in corpus_pipeline.run(spark, written(spark, tmp_path, corpus())).collect()}
    assert found == {number: len(library.encode(text)) for number, text in expected.items()}


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() == 0
