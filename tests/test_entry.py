import __spark_entry__


def test_registry():
    calls, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(calls) and "aspect_summary" in calls


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
