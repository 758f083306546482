"""Every query against its SQL on the smallest tables."""

import math
import time

import pytest

duckdb = pytest.importorskip("duckdb")

from cantata.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


#: No query may take longer on the smallest tables.
SECONDS = 60


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    began = time.monotonic()
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert time.monotonic() - began < SECONDS
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_training_checks_on_odd_rows(spark, tmp_path):
    """More rows of a language than small sketches hold exactly; no language, text or length; no duration; a text of over two million characters."""
    text = "CASE i % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '　 ' WHEN 3 THEN 'bell \x07' || repeat('x', 30) ELSE repeat('word ', i * 7919 % 1013) END"
    rows = f"SELECT i AS doc_id, {text} AS text, CASE WHEN i % 11 > 0 THEN 'en' END AS lang, 's' AS source, CASE WHEN i % 17 > 0 THEN i * 7919 % 1013 * 5 + i % 7 END AS n_chars FROM range(12000) t(i)"
    rows += " UNION ALL SELECT 12000, repeat('y', 2200000), 'en', 's', 2200000 UNION ALL SELECT 12001, 'no length', 'de', 's', NULL"
    rows += " UNION ALL SELECT -2679, 'no duration', 'en', 's', 0 UNION ALL SELECT -7679, '', 'fr', 's', 0 UNION ALL SELECT 12002, 'alone', 'fr', 's', 5"
    con = duckdb.connect()
    con.execute(f"COPY ({rows}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    df = catalogue.queries()["training_checks"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()['training_checks']})").fetchall()
    assert len(want) > 100 and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
