"""Pieces with line ends inside are put together from ids that are known."""

import random

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from graphlens.llm.encoding import Encoder, default_tokenizer  # noqa: E402


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def test_known_lines_do_not_reach_the_library_again():
    encoder = Encoder(default_tokenizer())
    encoder.encode(["a tree. house\ngarden"])
    asked, plain = [], encoder._ids
    encoder._ids = lambda text: asked.append(text) or plain(text)
    text = "a house\ngarden tree.\ngarden"
    assert ids(encoder, text) == encoder.library.encode(text, add_special_tokens=False).ids
    assert asked == ["a"]


def test_ids_are_those_of_the_library():
    encoder, pick = Encoder(default_tokenizer()), random.Random(7)
    parts = ["\n", "\n", "\n\n", "\r", "\t", "\x1c", "\x85", "\u2003", " ", " ", "  ", "a", "Wo", "é", "12", ".", ",", "'s", "漢", "🙂", "<|", "word", "x" * 70]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert ids(encoder, text) == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)
