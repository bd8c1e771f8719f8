from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from orbitree.llm.textkernel import word_slices

WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b   z", max_size=30)), max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_are_cut_like_the_pattern(texts):
    seen = []
    for words in word_slices(pa.array(texts, pa.string())):
        seen += [words.joined(lo, hi).decode() for lo, hi in zip(words.offsets[:-1], words.offsets[1:])]
    assert seen == [" ".join(WORD.findall(t or "")) for t in texts]


def test_equal_windows_have_equal_hashes_anywhere():
    a = next(word_slices(pa.array(["x y z w", "q x y z"])))
    k = a.windows(3)
    assert k[a.offsets[0]] == k[a.offsets[1] + 1]
    assert len(set(k[[0, 1, 4, 5]].tolist())) == 3
