import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, keys string, doc string, `block` string, part string"
WORDS = [f"w{i}" for i in range(400)]


def long_text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 31 + i * i * 7 + i * seed) % 400] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    texts = [
        (0, long_text(1, 80)), (1, long_text(1, 80)), (2, None), (3, ""), (4, "   \n\t "), (5, "one two"), (6, long_text(2, 30_000)), (None, long_text(3, 90)),
        (None, None), (7, long_text(4, 70)), (7, long_text(4, 70)), (8, "x" * 300_000 + " end"), (9, "é ü  double  spaces\r\n\x1c tail "),
        (10, long_text(1, 79) + " changed"), (11, "same line here and there again\nsame line here and there again\n" + long_text(5, 60)),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), "r", "k", None, "b", "p") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest tables whole."""
    return {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture(scope="session")
def no_labels(sample):
    return sample["labels"].limit(0)
