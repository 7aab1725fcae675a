import pytest

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"wörd{i % 997}" for i in range(40_000))
EDGES = [
    (100_001, None),
    (100_002, ""),
    (100_003, " \t\n"),
    (100_004, "one"),
    (100_005, "ONE two three four five"),
    (100_006, "one two three four five"),
    (100_006, "one two three four five"),
    (None, "one two three four five"),
    (None, None),
    (100_007, LONG),
    (100_008, "é̀ \U0001f600 \x00 <|im_end|> <|endoftext|> AKIA token=abc token: secretvalue a@b.co 1.2.3.4 +12 345 678 90 12"),
]


@pytest.fixture(scope="session")
def documents(spark):
    """The test documents, and rows of every odd kind, with columns whose names operators use themselves."""
    edges = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) as lang", "'x' as source", "cast(length(text) as long) as n_chars")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(edges)
    return docs.selectExpr("*", "1 as n", "2 as kept", "3 as blob", "'q' as quality", "4 as findings", "5 as contamination", "6 as words", "7 as component_id").persist()


@pytest.fixture(scope="session")
def pairs(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.filter("false")
