import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smaller tables as a list and as a table."""
    path = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{path}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, blank and very long texts, copies, a repeated row, columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    base = " ".join(f"base{i}" for i in range(40))
    near = base + " tail"
    rows = [(0, None, None, None, None), (1, "", "en", "a", "x"), (2, " \t\n\r\x0b\x0c ", "en", "a", "x"), (3, long, "de", "a", "x"),
            (4, base, "en", None, "x"), (5, base, "en", "b", "y"), (6, near, "en", "b", "y"), (7, near, "en", "b", "y"),
            (7, near, "en", "b", "y"), (None, base, "en", "b", "y"), (8, "short one", None, "c", "z"), (9, base + "\n" + base, "fr", "c", "z"),
            (10, "\x1c odd white space \x85", "fr", "c", "z"), (-3, "漢字 かな 🙂 ﬁn", None, "c", "z")]
    extra = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), r[4], r[4], 1, 2) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, h string, `count` string, n int, anchor int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")
