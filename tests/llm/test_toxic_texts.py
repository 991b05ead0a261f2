"""Scores of long texts are those of short ones."""

import numpy as np
import pytest

from tandem.llm import toxicity


def grams_of(word):
    return sorted(set(toxicity._grams(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[2].tolist()))


@pytest.fixture
def table():
    """A table that knows the n-grams of one word only."""
    out = np.zeros(toxicity.BUCKETS)
    out[grams_of(b"ass")] = 5.0
    return out


def score(text, table):
    data = np.frombuffer(text, np.uint8)
    return toxicity._score_block(data, np.array([0, len(data)]), table)[0]


@pytest.mark.parametrize("text", [b"klass ", b"some ass, there. ", b"a-b c\n"])
def test_repeating_a_text_past_a_block_changes_nothing(table, text):
    assert len(text * 900_000) > 4 << 20
    assert score(text * 900_000, table) == pytest.approx(score(text * 50, table), abs=1e-9)


def test_stretches_give_the_same_words(table, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(8))
    words = [rng.choice([b"ass", b"klass", b"x", b"yy", b"z" * 700]) for _ in range(300)]
    text = b" ".join(words)
    whole = score(text, table)
    starts, _, buckets, at = toxicity._grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    plain = toxicity._word_scores(table, buckets, at, len(starts))
    monkeypatch.setattr(toxicity.tx, "BLOCK_BYTES", 128)
    parts = list(toxicity._stretches(np.frombuffer(text, np.uint8)))
    assert b"".join(p.tobytes() for p in parts) == text and len(parts) > 20
    assert np.allclose(np.concatenate([toxicity._stretch_scores(p, table) for p in parts]), plain, atol=1e-9)
    assert score(text, table) == pytest.approx(whole, abs=1e-9)
