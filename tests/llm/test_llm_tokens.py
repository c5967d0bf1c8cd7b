import re

import numpy as np
import pyarrow as pa
import pytest

from neraca.llm import tokens
from odd import rows

TEXTS = [t for _, t, *_ in rows()] + ["a" * 3000 + " b " * 2000, "\n\nx\n"]


@pytest.mark.parametrize("limit", [16, 1 << 10, 1 << 19])
def test_words_match_the_pattern_at_any_slice(limit):
    names, seen = {}, 0
    for found in tokens.words(pa.array(TEXTS), limit=limit):
        bounds = found.bounds
        for k in range(found.rows):
            text = (TEXTS[found.first + k] or "").translate({c: c + 32 for c in range(65, 91)})
            want = re.findall(r"[^\x20\x09-\x0D]+", text)
            got = found.hash[bounds[k] : bounds[k + 1]].tolist()
            assert len(got) == len(want)
            assert found.size[bounds[k] : bounds[k + 1]].tolist() == [len(w.encode()) for w in want]
            for w, h in zip(want, got):
                assert names.setdefault(w, h) == h
            seen += 1
    assert seen == len(TEXTS) and len(set(names.values())) == len(names)


def test_shingle_sets():
    column = pa.array(["a b c a b c", "a b", "", None, "a b c", "A B C"])
    (found,) = tokens.words(column)
    row, value = tokens.word_sets(found, 3)
    assert np.bincount(row, minlength=6).tolist() == [3, 1, 0, 0, 1, 1]
    by = [set(value[row == r].tolist()) for r in range(6)]
    assert by[4] == by[5] and by[4] < by[0] and not by[1] & by[0]


def test_sliced_and_empty_columns():
    column = pa.array(["x", "a b", None, "c"]).slice(1, 2)
    assert [f.rows for f in tokens.words(column)] == [2]
    assert list(tokens.words(pa.array([], pa.string()))) == []
