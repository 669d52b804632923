"""Phrases of a benchmark against their SQL on texts that the test tables do not hold."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brakta.functions.text import simple_upper
from brakta.operators import phrases
from brakta.queries import search

TEXTS = ["DIE GROSSE STRASSE IST", "die große Straße ist", "DIE GROẞE STRAẞE IST", "ŉ ᾳ ﬁ x", "ŉ ᾼ ﬁ", "sß sßß ssß èe SS ß été åo e" * 3000, None, ""]


@pytest.fixture
def folder(spark, tmp_path):
    documents = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "e é E"), (None, "é ß")]
    benchmark = [(1, "und die große Straße ist naß"), (2, "a ŉ ᾳ ﬁ")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0,)], "r_regionkey int").write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["phrases_in_documents", "folded_letters"])
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = search.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({search.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) != []


def test_capitals_are_those_of_sql(spark):
    text = "".join(chr(c) for c in range(1, 0x2000) if not 0xD800 <= c < 0xE000 and c not in (0x130,))
    got = spark.createDataFrame([("ßŉᾳﬁΐ aé",), (None,), (text,)], "x string").select(simple_upper(F.col("x"))).collect()
    assert got[0][0] == "ẞŉᾼﬁΐ AÉ" and got[1][0] is None and len(got[2][0]) == len(text)


def test_places_are_handed_on_in_small_batches():
    body = "e" * (3 * phrases.ROWS + 5)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "__text": [body, "xe"]})
    sizes = [b.num_rows for b in phrases._search([(7, "e")], True, False, "shown")(iter([batch]))]
    assert max(sizes) <= phrases.ROWS and sum(sizes) == len(body) + 1
