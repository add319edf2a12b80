"""Every query against its SQL on DuckDB."""

import os
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.test_native import NARROW
from tidegrid.plans import queries as plans
from tidegrid.plans import sessions  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return None if v != v else repr(v)
    return str(v) if v is not None else None


def rows(table):
    return sorted(zip(*([cell(v) for v in table[c].to_pylist()] for c in sorted(table.column_names))), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir).toArrow()
    want = duck.execute(plans.ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) - set(plans.ORACLE) == {"checksums"}


@pytest.fixture(scope="module")
def narrow(tmp_path_factory):
    """Line items whose counts are, between gaps, blocks that end in a narrow interval: one a channel."""
    rows = []
    for order, (flag, counts) in enumerate(zip("ANR", NARROW, strict=True)):
        prices = [1.0, *(c / 100 for c in counts), 1.0]
        for n, p in enumerate(prices):
            rows.append({"l_orderkey": order, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": n, "l_quantity": 1.0, "l_extendedprice": p, "l_discount": 0.05 if 0 < n < len(prices) - 1 else 0.0, "l_tax": 0.0, "l_returnflag": flag, "l_shipdate": datetime(1997, 1, 1)})
    folder = tmp_path_factory.mktemp("narrow")
    pq.write_table(pa.Table.from_pylist(rows).cast(pa.schema([pa.field(k, {int: pa.int64(), float: pa.float64(), str: pa.string()}.get(type(v), pa.timestamp("us"))) for k, v in rows[0].items()])), f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["codec_roundtrip", "native_import", "native_locked", "native_archive", "native_extract", "native_samples", "native_split", "native_append"])
def test_last_samples_of_narrow_blocks(spark, narrow, name):
    got = plans.QUERIES[name](spark, narrow).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{narrow}/lineitem.parquet'")
    assert rows(got) == rows(con.execute(plans.ORACLE[name]).to_arrow_table())
