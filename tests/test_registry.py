import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "key" and df.count() > 0


def test_hot_session_scan_shuffles_rows_by_chunk(spark):
    """The carried state must not force a window over a whole session's rows."""
    from checks import standins as st

    plan = st.event_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in plan and "__chunk" in plan
