"""What the driver holds of a labelled text."""

import pickle
import random

import numpy as np

from quarrystone.llm import langid


def test_a_lesson_is_small_and_whole():
    """All counts of a long text come back, and what is gathered of it takes a few bytes a bucket (16 as plain arrays, far more as Python integers)."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=rng.randint(1, 9))) for _ in range(8000))
    made = langid.lesson("en", text)
    want = np.unique(langid.buckets_of(text.lower().encode()), return_counts=True)
    assert all(np.array_equal(a, b) for a, b in zip(made.whole(), want, strict=True)) and len(want[0]) > 10_000
    assert len(pickle.dumps(tuple(made))) < 3 * len(want[0]) + sum(map(len, made.pieces)) + 1000


def test_a_lesson_of_few_and_of_extreme_buckets():
    for text in ("a", "ä" * 70_000):
        want = np.unique(langid.buckets_of(text.encode()), return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(langid.lesson("x", text).whole(), want, strict=True))
    ends = np.array([0, 1, (1 << langid.BITS) - 1]), np.array([2**40, 1, 7])
    assert all(np.array_equal(a, b) for a, b in zip(langid.Lesson("x", [], langid.packed(*ends)).whole(), ends, strict=True))
