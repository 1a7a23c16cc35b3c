"""The lattice of a segment in the task: its edges from an automaton, its ids by the fold."""

import random

import numpy as np
import pandas as pd

from folioscale.llm.pieces import Encodings, PieceModel, between_spaces, merged, segments


def test_folded_segments_are_kept_as_bytes_and_equal_merging():
    model = PieceModel()
    known = [number for _, number, _ in model.pieces[:2]]
    encodings = Encodings(pd.DataFrame({"word": ["▁the"], "ids": [known]}), model)
    draw = random.Random(4)
    letters = "".join(piece for piece, _, _ in draw.sample(model.pieces, 300)) + "é漢😀\n\t.,!?;:"
    words = {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 80))) for _ in range(2000)}
    words |= {"".join(piece for piece, _, _ in draw.sample(model.pieces, draw.randrange(1, 5))) for _ in range(2000)}
    for word in words:
        ids, decoded, whole = encodings[word]
        expected = merged(word, encodings.scores, model.byte_ids)
        assert isinstance(ids, bytes) and np.frombuffer(ids, np.int32).tolist() == expected
        assert decoded == word.encode() and whole
    assert np.frombuffer(encodings["▁the"][0], np.int32).tolist() == known


def test_parts_are_cut_at_their_marks():
    cut = {"word": ["word"], "word.": ["word", "."], "word\n": ["word", "\n"], "9.": ["9."], "a.b": ["a", ".b"], "a,\tb": ["a", ",", "\t", "b"]}
    for part, expected in cut.items():
        (whole,) = between_spaces(part)
        found = segments(whole)
        assert "".join(found) == whole and [word.lstrip("▁") for word in found] == expected
