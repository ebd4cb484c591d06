import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 64 and {"c", "y", "x", "v"} == set(rows[0].asDict())
