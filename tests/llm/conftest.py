import random

import pytest

WORDS = "the of and stone river light garden window table paper music winter".split()


@pytest.fixture(scope="session")
def prose():
    """A function of a seed and a length to words."""

    def make(seed: int, n: int) -> list[str]:
        rng = random.Random(seed)
        return [rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 3)) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Clean texts, copies, near copies, shared passages, null and empty and very long texts, repeated rows, clashing columns."""
    passage = prose(99, 60)
    rows = [(i, " ".join(prose(i, 120)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(3)]  # copies
    rows += [(200 + i, rows[5][1] + f" end{i}", "en", "s1", 1) for i in range(3)]  # near copies
    rows += [(300 + i, " ".join(prose(300 + i, 40) + passage + prose(400 + i, 40)), "fr", "s2", 1) for i in range(3)]  # a shared passage
    rows += [(400, None, "en", "s0", None), (401, "", None, None, 0), (402, " \t\n\r\x0b\x0c ", "xx", "s0", 3), (403, "one two", "en", None, 7), (None, rows[7][1], "en", "s1", 1), (None, None, None, None, None)]
    rows += [(500, " ".join(prose(500, 30_000)), "de", "s1", 1), (501, "x" * 100_000, "de", "s1", 1), (502, "Ärger über 💡 déjà. Ünï", "de", "s1", 1)]
    rows += [rows[10], rows[10]]  # repeated rows
    rows = [(*r, f"k{i}", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, _near bigint").cache()
