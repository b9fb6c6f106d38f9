import pytest

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(20_000))
SHARED = "This very long passage stands in several documents and goes on for more than fifty words, " * 6
LINE = "A common line of boilerplate that many documents hold verbatim."


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    texts = [None, "", "   ", "one", "two words", "the same text of a few words", "the same text of a few words", LONG, LONG, SHARED, "before " + SHARED + " after", "日本語のテキスト。改行\nと空白", "café naïve 'tis don't 12½ x", "a\r\n\x0b\x0c b\n\n", "\n".join([LINE] * 3)]
    texts += [f"Document number {i} has its own words {i * 7}.\n{LINE}\nAnd an end {i}." for i in range(8)]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}", len(t or ""), "k", i % 3) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a row without an id", "en", "s0", 19, "k", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, shard int")


@pytest.fixture(scope="session")
def plain(tricky):
    """The same with distinct, non-null ids."""
    return tricky.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)
