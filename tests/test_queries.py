"""Every query of the catalog and of the operations against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarry.plans import operations as catalog
from quarry.sources import tables
from quarry.sources.tables import FILES_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, list):
        return tuple(map(plain, x))
    return float(f"{x:.10g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name in catalog.SQL:
        found = duck.execute(catalog.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall()), key=repr)
        assert sorted((tuple(plain(v) for v in r) for r in rows), key=repr) == want
    else:
        assert rows


def test_coverage_of_deep_texts_and_negative_ids(spark, tmp_path):
    deep = "\n".join(["def f():", "    return 1", "", "x = " + "-" * 9_000 + "1", "y = 2"])  # too deep for Python's parser
    rows = [(i, deep if i % 12 == 0 else "def f():\n  pass\n\na b c" if i % 2 else None, "p" if i % 5 else None) for i in range(-90, 91)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["index_coverage"](spark, str(tmp_path)).select("file_id", "lines", "covered").collect()
    assert sorted(map(tuple, got)) == sorted(own.execute(catalog.SQL["index_coverage"]).fetchall()) and len(got) > 90
    want = own.execute(f"WITH {FILES_SQL} SELECT file_id, path, language, category FROM files ORDER BY file_id").fetchall()
    assert [tuple(r) for r in tables.files(spark, str(tmp_path)).select("file_id", "path", "language", "category").orderBy("file_id").collect()] == want
