import pytest

DATA = "/root/testdata/sf0.001"
LONG = "wörter und mehr " * 20_000 + "x" * 70_000
# NULLs, empty and very long texts, ties and repeated rows, and a NULL id.
EDGES = [
    (1, "Hello big world, mail me at a.b@c.org", "en"),
    (1, "Hello big world, mail me at a.b@c.org", "en"),
    (2, "", "en"),
    (3, None, None),
    (None, "Hello big world again", None),
    (4, LONG, "de"),
    (5, " \t\n", "fr"),
    (6, "...!!! 123", None),
    (7, "ÉLAN für alle Wörter", "de"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def clashing(edges):
    """The same rows with columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = ["score", "shard", "slot", "size", "record", "lang_pred", "_fp", "_text", "_base", "_spans", "_hits",
             "component_id", "root", "ids", "decoded", "held_out", "n_tokens", "bits_per_byte", "bucket", "fp"]
    return edges.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
