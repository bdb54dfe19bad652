"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys
import textwrap

import __spark_entry__


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80


def test_a_query_against_its_oracle(spark):
    import duckdb

    root = "/root/testdata/sf0.001"
    for name in ("dates_parse", "amount_sign", "geo_country"):
        df = __spark_entry__.queries()[name](spark, root)
        columns = sorted(df.columns)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{root}/orders.parquet'")
        want = con.sql(__spark_entry__.oracle_sql()[name]).project(", ".join(columns)).fetchall()
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want)), name


def test_imports_without_llm():
    code = textwrap.dedent("""
        import sys
        sys.modules["veridra.llm"] = None
        import __spark_entry__
        assert not any(n.startswith("op") or n == "pipeline" for n in __spark_entry__.queries())
        assert __spark_entry__.oracle_sql()
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_stream_equals_batch(spark):
    got = __spark_entry__.queries()["stream_stateless"](spark, "/root/testdata/sf0.001")
    batch = __spark_entry__.queries()["dates_parse"](spark, "/root/testdata/sf0.001").select("k", "txn_date_time")
    assert got.select("k", "txn_date_time").exceptAll(batch).count() == 0 and got.count() == batch.count()
