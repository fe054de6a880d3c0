import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvidex.llm import bpe, lockstep
from tests.llm.test_bpe import ODD


def same(texts):
    length, ids = lockstep.load_lockstep().texts(texts, 2)
    want = [[*bpe.load().encode(x).tolist(), 2] for x in texts]
    assert length.tolist() == list(map(len, want))
    assert ids.tolist() == [i for x in want for i in x]


def test_odd_texts_match_the_backtracking_encoder():
    same(ODD)
    same([])
    same(["", " \n ", "", "a"])
    same([" a ", "a", "a　b c\x85d", "é e ́", "\x1ca\x1fb c"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet="abehinorst '<|>!#$\n", max_size=80), max_size=6))
def test_any_texts_match_the_backtracking_encoder(texts):
    same(texts)


@pytest.mark.parametrize("size", [lockstep.LONGEST_ROW - 1, lockstep.LONGEST_ROW, lockstep.LONGEST_ROW + 1, 50_000])
def test_long_words(size):
    same(["ab" * (size // 2), "a" * size, "é" * size, "x " * size, "thandingblend" * (size // 13)])


def test_rows_are_cut(monkeypatch):
    monkeypatch.setattr(lockstep, "ROWS", 40)
    rng = np.random.default_rng(3)
    same(["".join(rng.choice(list("abcdehinorst  "), 400)) for _ in range(5)])


def test_every_merge_is_found():
    own = lockstep.load_lockstep()
    pairs = own.keys[:-1]
    assert (own.rank(pairs >> 32, pairs & 0xFFFFFFFF) == np.arange(len(pairs))).all()
    assert (own.rank(np.array([0, 49406]), np.array([49407, 49406])) == 2**31 - 1).all()
