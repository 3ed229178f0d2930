"""Rows that the tests of the corpus operators share."""

import random

CLASH = ["key", "row", "n", "id", "host", "spread", "doc", "drop", "templates", "first", "fp", "digest", "h", "line"]


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(words))


ODD = [
    (1, None, None), (2, "", "a"), (3, " \n\t\r\x0b\x0c", "a"), (4, "one", "a"), (5, "one", "a"), (5, "one", "a"), (None, "two words", "b"), (None, None, None),
    (6, "é" * 30 + " 你好 \U0001f600", "b"), (7, prose(1, 5000), "b"), (8, "x" * 20000, "b"), (9, "o n\ne", "c"),
]
