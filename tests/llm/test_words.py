import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm.words import Words, chunks, shingle_sets

from .helpers import FOLD, words

TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x0caAbBéß漢.\x85 "), max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()), lower=True)
    raw = w.bytes.tobytes()
    for i, t in enumerate(texts):
        got = [raw[w.starts[j] : w.ends[j]].decode() for j in range(w.first[i], w.first[i + 1])]
        assert got == words(t)
    said = [x.translate(FOLD) for t in texts for x in words(t)]
    assert len(set(w.hash.tolist())) == len(set(said))
    first = {}
    for h, x in zip(w.hash.tolist(), said, strict=True):
        assert first.setdefault(x, h) == h


def test_hashes_do_not_depend_on_place():
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["ab", "c", "dé", "xyz"], k=30)) for _ in range(50)]
    together = Words(pa.array(texts)).hash
    alone = np.concatenate([Words(pa.array([t])).hash for t in texts])
    assert (together == alone).all()


def test_shingle_sets():
    texts = ["a b c d e f", "a b", "", None, "a b c d e f a b c d e f"]
    v, o = shingle_sets(Words(pa.array(texts, pa.string())), 5)
    assert np.diff(o).tolist() == [2, 1, 0, 0, 6]


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 0, 7)] + [None])], ["t"])
    got = [x for part in chunks([batch], "t", 10) for x in part.column("t").to_pylist()]
    assert got == batch.column("t").to_pylist()
