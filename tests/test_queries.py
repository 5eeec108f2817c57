"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from warder.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


SOME = ["audit_parse_roundtrip", "audit_saved_filters", "audit_sort", "audit_stream_counts", "av_search", "cond_eval", "rules_expand", "flow_transitive", "domtrans_invalid", "relabel_object", "diff_av", "check_unreachable_doms", "labels_expected"]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA)
    want = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)
