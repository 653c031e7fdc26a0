from __future__ import annotations

import __spark_entry__ as entry


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
    assert all(callable(q) for q in queries.values()) and all(s.strip() for s in sql.values())


def test_checkpoints_stay_in_the_folder_of_the_session(spark):
    from rotogrid.session import cut, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert cut(spark.range(5)).count() == 5
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == folder


def test_no_local_checkpoints_in_the_library():
    from pathlib import Path

    import rotogrid

    for path in Path(rotogrid.__file__).parent.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path
