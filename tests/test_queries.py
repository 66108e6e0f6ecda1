import pytest

from factlake.plans import bindings

from .compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, bindings.QUERIES[name], bindings.ORACLES[name], FOLDER)


def test_flagship_and_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and {r["adjusted_severity"] for r in rows} <= {"P0", "P1", "P2"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    assert all(r["n_stream"] == r["n_batch"] for r in bindings.QUERIES["stream_batch_equal"](spark, FOLDER).collect())


def test_rest_works_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['factlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and not any(k[:2] == 'op' and k[2:3].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
