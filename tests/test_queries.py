"""Registered queries against their SQL over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from weirlog import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    told = duck.execute(queries.SQL[name])
    columns = [d[0] for d in told.description]
    want = sorted(repr(tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns))) for r in told.fetchall())
    assert sorted(found.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in found.collect()) == want


def test_conversations_of_many_turns(spark, tmp_path):
    """Edges go on after turn 7, stop where a turn is missing, and never run into the next conversation."""
    turns = [(0, t) for t in range(12)] + [(1, t) for t in (0, 1, 8, 9, 10)] + [(2, t) for t in range(994, 1004)] + [(3, t) for t in range(3)]
    rows = [(c, t, "system" if t == 0 else "user", "x") for c, t in turns]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    number = lambda c, t: c * 1000 + t % 1000 + t // 1000 * 10**15
    there = set(turns)
    paths = {(number(c, a), number(c, b)) for c, a in turns for d, b in turns if c == d and a < b and all((c, t) in there for t in range(a, b))}
    seen = {number(c, t) for c, t in turns if (c, 0) in there and all((c, x) in there for x in range(t))}
    rows_of = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert rows_of("closure") == rows_of("nonlinear_closure") == sorted(paths)
    assert rows_of("unreachable") == sorted((number(c, t),) for c, t in turns if number(c, t) not in seen)
    assert rows_of("mutual_recursion") == sorted((number(c, t), t % 2 == 0) for c, t in turns if number(c, t) in seen)

    def closed(edges):
        found = set(edges)
        while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
            found |= more
        return found

    edges = {(number(c, t), number(c, t + 1)) for c, t in turns if (c, t + 1) in there}
    bridged = closed(edges - {(0, 1)} | {(0, 1000)})
    assert rows_of("apply_then_retract") == sorted(bridged)
    assert rows_of("delta_weights") == sorted([(a, b, -1) for a, b in paths - bridged] + [(a, b, 1) for a, b in bridged - paths])


def test_entry():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
