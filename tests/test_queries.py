"""Registered queries against their SQL on the small tables."""

import os

import pandas as pd
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, names):
    return sorted(tuple("" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the small tables are not here")
def test_queries_equal_their_sql(spark, duck):
    from verseline.plans import registry

    oracle = registry.oracle_sql()
    for name, query in registry.queries().items():
        got = query(spark, SF).toPandas()
        if name in oracle:
            want = duck.sql(oracle[name]).df()
            assert sorted(got.columns) == sorted(want.columns), name
            assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)), name


def test_boundary_votes_count_lines_that_occur_once(spark, tmp_path):
    from verseline.plans import registry

    spark.createDataFrame([("Ab cd\nx y",), ("ab  CD!\nabc d",), ("ab, cd",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["boundary_votes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("abcd", 2, 3, 4, 0.75)]


def test_prepared_times_are_rounded_as_in_their_sql(spark, tmp_path):
    """Lines whole seconds apart, so that their scaled times are ties, and at places where centiseconds are ties."""
    duckdb = pytest.importorskip("duckdb")
    from verseline.plans import registry

    con = duckdb.connect()
    starts = [5005 + 10 * k for k in range(20)] + [5650 + 50 * k for k in range(100)]
    # a track for each start: a line at 0, another one there; each is seen twice
    events = [(s, t, what) for s in starts for t, what in ((0, "view"), (1, "view"), (s, "click"), (s + 1, "click"))]
    users, seconds, types = map(list, zip(*events))
    con.execute("CREATE TABLE e AS SELECT unnest(?) AS user_id, unnest(?) AS s, unnest(?) AS event_type", [users, seconds, types])
    con.execute("CREATE TABLE events AS SELECT row_number() OVER (ORDER BY user_id, s) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, user_id, event_type, CAST(90 AS DOUBLE) AS value FROM e")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("prepared_lines", "lrc_texts", "review_rows"):
        got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(registry.oracle_sql()[name]).df()
        assert len(got) == len(starts) * (1 if name == "lrc_texts" else 2)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)), name
