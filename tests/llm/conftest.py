import random

import pytest

BASE = "the quick brown fox jumps over the lazy dog and runs far away from all of the hunters in the green wood "


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, repeats, other scripts, odd white space, a very long text, empty and null ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8)))
    long = " ".join(word() for _ in range(9000))
    near = [word() for _ in range(120)]
    out = [None, "", " ", "\n\n", "a", "a a a a", long, long + " more", BASE, BASE * 8, BASE.upper() + "!!", "é" * 80, "中文🙂 " * 30]
    for k in range(12):
        other = list(near)
        for _ in range(k // 3):
            other[rng.randrange(120)] = word()
        out.append(" ".join(other))
    for _ in range(25):
        own = [word() for _ in range(rng.randint(5, 90))]
        out.append(" ".join(own) + rng.choice(["", BASE, "\n" + BASE, " de%%% ###"]) + "\n".join(word() for _ in range(4)))
    out += out[13:16] + ["x\ty\x0bz\r\n'S don't 123"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as rows with ids in another order than the rows, a null id, a repeated row, and columns with clashing names."""
    n = len(texts)
    rows = [((7 * k) % n if k != 20 else None, t, None, "s", k, "x", 1, 2, 3) for k, t in enumerate(texts)]
    rows.append(rows[15])
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id string, doc int, text_key int, bucket int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
