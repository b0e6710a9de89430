import __spark_entry__


def test_every_sql_has_a_query():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
