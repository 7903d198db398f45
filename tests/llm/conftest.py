import pytest

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, set_id string, "
        "length string, score string, kept_doc string, cluster string, rank string")
# Extra columns named like the operators' own.
EXTRA = ("d", "s", "l", "x", "k", "c", "r")

EN = "the cat and the other dog went over there and then they came back to the house with her"
DE = "der hund und die katze gehen nach hause und dann kommen sie wieder zurück zu der schönen straße"


def hard_rows():
    long_word = "x" * 70_000
    many_words = " ".join(f"w{k % 997} the" for k in range(20_000))
    rows = [(1, EN, "en"), (2, DE, "de"), (3, None, "en"), (4, "", None), (5, " \n\t ", "de"), (6, "1234 5678 !!", None),
            (7, long_word, None), (8, many_words, None), (9, EN.upper(), "en"), (10, EN, "en"), (10, EN, "en"),
            (None, EN, "en"), (None, None, None), (11, "a\u0000b \U0001F600 日本 é", None), (12, "mail bob@example.com or 10.0.0.1", "en"),
            (13, "0" * 5000 + "1.1.1.1 and " + "9" * 6000 + ".1.1.1", None)]
    return [(i, t, lang, None if i == 5 else "s", None if t is None or i == 9 else len(t), *EXTRA) for i, t, lang in rows]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark, small_sf):
    return spark.read.parquet(f"{small_sf}/documents.parquet")
