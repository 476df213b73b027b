import random

import pytest


def _texts():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, long = line(60), line(3000)
    texts = [line(r.randint(0, 90)) for _ in range(40)]
    texts += [shared, shared, f"{line(20)} {shared} {line(9)}", f"{line(3)}\n{shared}\t{line(40)}", f"{shared} {shared}", shared[:-9] + "XYZ"]
    texts += ["a" * 400, "a" * 130, "ab" * 90, "ab" * 91, "", None, None, " \n\t ", "é" * 80, "x", "The THE the", long, long + " end", long[5:], "aa\0bb", "İK   z"]
    return texts


@pytest.fixture(scope="session")
def rows():
    """Ids and texts with nulls, ties, repeats, empty and long texts."""
    texts = _texts()
    ids = [*range(7, 7 + len(texts))]
    out = list(zip(ids, texts, strict=True))
    out += [(7, texts[0]), (7, texts[0]), (8, "other text under the same id"), (None, texts[40]), (None, None), (-3, texts[42])]
    random.Random(1).shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns, whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, shard int, words string, score double, n int, block string, `key` string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "w", 0.5, 3, None, "k") for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
