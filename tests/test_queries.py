"""Each registered query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lockstep import queries_io  # noqa: F401  registers its queries
from lockstep.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in got.fetchall()]
    assert sorted(map(str, rows)) == sorted(map(str, expected))


@pytest.mark.parametrize(("name", "tables", "written"), [("command_line", ["lineitem"], [f"worker_id={w}" for w in range(4)]), ("late_results_in_a_stream", ["events"], ["in/a", "in/d"])])
def test_no_task_writes_a_whole_table(spark, duck, tmp_path, monkeypatch, name, tables, written):
    """A table of four files gives at least four files, and the same rows."""
    for t in tables:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(4).write.parquet(f"{tmp_path}/sf/{t}.parquet")
    monkeypatch.setattr(queries_io, "scratch", lambda s: f"file://{tmp_path}/at")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        rows = QUERIES[name](spark, f"file://{tmp_path}/sf").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, duck.execute(ORACLES[name]).fetchall()))
    for folder in written:
        assert len(glob.glob(f"{tmp_path}/at/{folder}/part-*")) >= 4
