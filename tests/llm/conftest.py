import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, null and repeated ids and sources."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(9_000))
    return [
        (1, "the same  text\there", "a"), (2, "the same text here", "b"), (3, "the same text here ", "a"),
        (4, None, "a"), (5, "", None), (6, " \t ", "b"), (7, long, "a"), (8, long.replace(" ", "\n"), "b"), (9, long + "!", "a"),
        (10, "a", "c"), (10, "a", "c"), (10, "b", "c"), (None, "the same text here", "a"), (None, None, None), (None, "only here, without an id", "b"),
        (11, "ünï cödé 中文 \U0001f600 text", "ü"), (12, "one two", "c"), (13, "one two three", "c"),
    ]
