"""Decontamination: which words a document brings along."""

import re
import sys

import numpy as np

from folioscale.llm import decontam
from folioscale.llm.decontam import FEATURES, _chunks, document_frequencies, plain_words


def test_words_of_no_passage_are_no_features():
    ((placed, run),) = _chunks(["Alpha beta gamma", None, "gamma"], {"alpha": 5, "gamma": 9})
    assert run[:3].tolist() == [5, FEATURES, 9] and [number for _, number, _ in placed] == [0, 2]
    assert (run != FEATURES).sum() == 3


def test_document_frequencies_in_small_portions(spark, monkeypatch):
    texts = [f"common word{number % 7} word{number} common" for number in range(300)] + [None, ""]
    docs = spark.createDataFrame([(text,) for text in texts], "text string").repartition(2)
    features, expected = decontam.Features(), np.zeros(FEATURES, np.int64)
    for text in texts:
        for word in set(plain_words(text)):
            expected[features[word]] += 1
    for most in (10, 100_000):
        monkeypatch.setattr(decontam, "COUNTED_WORDS", most)
        assert (document_frequencies(docs) == expected).all()


def test_words_are_runs_of_letters_and_digits():
    def matched(text):
        return re.findall(r"[^\W_]+", text.lower())

    every = "".join(map(chr, range(sys.maxunicode + 1)))
    assert plain_words(every) == matched(every)
    for text in ("Zur Übung: 3 Straßen_und İ", "a\u00a0b\u2013c\x85d\x1fe", "\ud800x Y", "x²y ½ ٣", "\u0301e\u0301t", "___ --", "日本、語"):
        assert plain_words(text) == matched(text)
    assert plain_words(None) == plain_words("") == []


def test_most_texts_are_cut_without_an_expression(monkeypatch):
    monkeypatch.setattr(decontam, "_OTHER_SPACE", None)
    assert plain_words("Hello, World_1!") == ["hello", "world", "1"]
    assert plain_words("Größe, très — bon".replace("—", "-")) == ["größe", "très", "bon"]
