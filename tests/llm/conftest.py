from pathlib import Path

import duckdb
import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs or full rows, with extra columns whose names operators use themselves."""
    def make(rows, clash=True):
        full = [(*r, "en", "s0", len(r[1] or "")) if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("_row", "_rank", "key", "head", "size", "shard", "tokens", "kept", "n_words", "component_id", "lines", "copies", "rate"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Null ids and texts, empty and blank texts, one very long text, repeated rows, one id with two texts."""
    plain = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return docs_of([(None, plain), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, plain), (5, plain), (5, plain), (6, plain + " more"), (6, "quite another text here"),
                    (7, long), (8, "Ünïcode Wörter,   ständig \U0001F600 neu"), (9, "mit")])


@pytest.fixture(scope="session")
def sql():
    def rows(query, folder=SMALL, **views):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        for name, table in views.items():
            con.execute(f"DROP VIEW IF EXISTS {name}")
            con.register(name, table)
        cur = con.execute(query)
        names = [c[0] for c in cur.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
    return rows


@pytest.fixture(scope="session")
def sorted_rows():
    def rows(df):
        names = sorted(df.columns)
        return names, sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    return rows
