import random

import pytest

WORDS = "the of and a to in is on it by for was with as at be this".split()


def made_texts(n: int, seed: int) -> list:
    """Texts that share lines, passages and whole copies, among odd ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    lines = [" ".join(word() for _ in range(12)) for _ in range(6)]
    out: list = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.1 and out:
            out.append(rng.choice(out))
        elif kind < 0.2 and out and (base := rng.choice(out)):
            parts = base.split(" ")
            parts[rng.randrange(len(parts))] = word()
            out.append(" ".join(parts))
        else:
            body = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
            if rng.random() < 0.3:
                body.insert(rng.randrange(len(body)), passage)
            if rng.random() < 0.4:
                body.append("  " + rng.choice(lines).upper() + "\t")
            out.append("\n".join(body))
    return out + ["", None, " \t\n", "a", "é" * 50 + " ß\u00a0x", "x" * 300, "ab " * 400, "\n\n\n", "a\x00b <|endoftext|> c"]


@pytest.fixture(scope="session")
def texts():
    return made_texts(120, 4)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, shared ids, and columns by the names that the operators use inside."""
    rows = [(None, None, None, None), (None, "some words " * 30, None, 1), (None, "some words " * 30, None, 1), (1, None, "s", None), (1, "", None, 2), (2, "some words " * 30, "s", 3), (2, "some words " * 30, "s", 3), (2, "other words " * 30, "t", 3), (3, "x" * 200_000, "t", None), (4, "a b c " * 60_000, "t", 9)]
    names = ["_id", "_text", "_th", "_row", "_src", "_o", "_b", "_r", "h", "n", "k", "m", "j", "at", "found", "spans", "kept", "fp", "ids", "slot", "block", "position", "part", "key", "stack", "n_words", "n_lines", "n_dropped", "gone", "score", "toxic", "decoded", "c0"]
    schema = "doc_id long, text string, source string, lang int, " + ", ".join(f"{x} int" for x in names)
    return spark.createDataFrame([r + tuple([None] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
