"""Prefix doubling over every suffix against brute force, and against the sampled form on the given documents."""

import random

import pytest

from tandem.llm import prefix_doubling, suffix_dedup
from tests.conftest import rows
from tests.llm.conftest import SF
from tests.llm.test_pairs import AWKWARD, check_repeats


@pytest.fixture
def doubling(monkeypatch):
    """``remove_repeats`` takes its spans from the doubling."""
    monkeypatch.setattr(suffix_dedup, "repeated_spans", prefix_doubling.repeated_spans)


@pytest.mark.parametrize("length", [1, 2, 31, 32, 33, 100, 1000])
def test_rounds_at_most_double(length):
    steps = prefix_doubling.widths(length)
    assert steps[-1] == length and 1 <= steps[0] <= prefix_doubling.NAMED_BYTES and len(steps) > 1
    assert all(a <= b <= 2 * a for a, b in zip(steps, steps[1:]))


def test_doubling_of_awkward_rows(awkward, nothing, doubling):
    check_repeats(awkward, AWKWARD, 100)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_doubling_against_brute_force(spark, doubling):
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdé ", k=200)) for _ in range(5)]
    made = [(i, "".join(p[a : a + rng.randint(20, 160)] for p in rng.choices(pool, k=rng.randint(0, 4)) for a in [rng.randrange(150)])) for i in range(50)]
    # documents that meet end to end, runs of one byte, a text of exactly the length
    made += [(100, "q" * 300), (101, "q" * 99), (102, "q" * 100), (103, pool[0][:100]), (104, ""), (105, "é" * 60)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    for length in (100, 30):
        check_repeats(docs, made, length)


def test_doubling_in_blocks_of_a_long_text(spark, doubling, monkeypatch):
    monkeypatch.setattr(suffix_dedup.tx, "BLOCK_BYTES", 1 << 11)
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefgh", k=6000))
    made = [(1, text), (2, text[500:4000] + "q" + text[1000:]), (3, "r" + text)]
    check_repeats(spark.createDataFrame(made, "doc_id bigint, text string"), made, 100)


def test_both_forms_agree_on_the_given_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sampled = rows(suffix_dedup.remove_repeats(docs))
    monkeypatch.setattr(suffix_dedup, "repeated_spans", prefix_doubling.repeated_spans)
    assert rows(suffix_dedup.remove_repeats(docs)) == sampled
    assert sum(r[3] for r in sampled) > 0
