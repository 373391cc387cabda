"""Rows that are hard on operators."""

import random


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(n))


ODD = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, "   \n\t ", None, "a", 6),
    (3, words(1, 60), "en", "a", None),
    (4, words(1, 60), "en", None, 1),  # a copy
    (4, words(1, 60), "en", None, 1),  # a repeated row
    (5, words(2, 30_000), "de", "b", 1),  # very long
    (6, "Ünï cödé €uro K ﬁ  line", "fr", "b", 1),
    (None, words(3, 40), "en", "b", 1),
    (7, "one", "en", "c", 1),
    (8, words(4, 60) + "\nReleased under the MIT License. GNU General Public License, CC BY", "en", "c", 1),
    (9, "word " * 500, "en", "c", 1),
]
