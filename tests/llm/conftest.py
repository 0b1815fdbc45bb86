import pytest

# Odd rows: nulls, empty and blank texts, repeated rows, equal ids, odd characters, and extra columns whose names clash.
LONG = " ".join(f"w{i % 211}x{i // 7}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, None), (2, ""), (3, "  \n\t \n"), (4, "one line"), (5, "one line"), (5, "one line"), (None, "null id " + PASSAGE), (6, LONG), (7, LONG + " tail"), (7, LONG), (8, "a " + PASSAGE + " b"),
    (9, "c " + PASSAGE + " d\ne\ne\nF \nf"), (10, "It's 'S über　naïve \x85 中文 don't WE'LL 12345 ½ <|endoftext|>\r\n\x1c x"), (11, "same " * 300), (12, "\n".join(f"Line {i} " for i in range(40))), (13, "é" * 5000),
]
SCHEMA = "doc_id long, text string, n_words int, kept string, fingerprint double, text_hash string, n_lines int, known_blocks int, base_failed int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2.0, "h", 3, 4, 5) for i, t in ROWS], SCHEMA).repartition(2)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
