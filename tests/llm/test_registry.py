"""The SQL that goes with the queries is text."""

import __spark_entry__


def test_all_sql_is_text():
    sql = __spark_entry__.oracle_sql()
    assert sql and all(isinstance(v, str) for v in sql.values())
    assert set(sql) <= set(__spark_entry__.queries())
