import pytest

TEXTS = [
    None,
    "",
    " ",
    "Hello, World! It's 3 o'clock.",
    "Hello, World! It's 3 o'clock.",
    "tab\tand\x1cseparator\x1f end",
    "naïve café ÄÖÜ ß İstanbul ΣΑΣ ﬁn",
    "日本語のテキスト　全角 스페이스",
    "<|endoftext|>not special<|startoftext|>",
    "don't we'll they're I'd 'tis ''s 's",
    "a" * 5_000,
    "no_space" * 2_000,
    "word " * 9_000,
    "\n\n\n  \t  x  \r\n",
    "é combining ́ alone",
    "1234567890 12,345.67 ½ ²",
    "!?.,;:... -- ***",
    "😀👍🏽 emoji‍",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, repeated rows and ids, and columns whose names operators use inside."""
    rows = [(i if i % 7 != 5 else None, t, None if i % 3 else "en", "src0", i, "x", i) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[12]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
