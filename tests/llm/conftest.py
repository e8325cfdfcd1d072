from __future__ import annotations

import numpy as np
import pytest

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq".split()


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Texts with exact and near copies, a hot group, edge cases, and lines that many share."""
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(rng.choice(WORDS, n))
    line = "this line stands in very many documents of this small corpus"
    out: list[str | None] = [None, "", " \n\t ", "One", "one", "one two", "One TWO", "É é ÀB", "long " * 30_000]
    for _ in range(12):
        base = rng.choice(WORDS, 60).tolist()
        out.append(" ".join(base))
        for _ in range(rng.integers(1, 6)):
            near = list(base)
            for i in rng.integers(0, 60, rng.integers(1, 7)):
                near[i] = str(rng.choice(WORDS))
            out.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    out += [some(40) + "\n" + (" " + line.upper() + "\t" if i % 2 else line) + "\n" + some(5) for i in range(9)]
    out += [some(int(n)) for n in rng.integers(1, 50, 20)]
    return out + out[9:12]


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, ["en", None][i % 2], [None, "s2", "s10", "Z"][min(3, i % 7)], 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string").cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
