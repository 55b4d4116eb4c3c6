from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    """Runs SQL over the tables of a folder, as dicts with columns in order of name."""
    import duckdb

    def run(sql: str, folder: str = sf_dir) -> list[tuple]:
        con = duckdb.connect()
        for p in sorted(Path(folder).glob("*.parquet")):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        return same(names, cur.fetchall())

    return run


def same(names: list[str], rows: list) -> list[tuple]:
    """Rows with columns by name, numbers rounded, sorted: equal for equal results."""
    order = sorted(range(len(names)), key=names.__getitem__)
    cut = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(cut(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def rows():
    """The rows of a DataFrame in the same form as those of duck."""
    return lambda df: same(df.columns, [tuple(r) for r in df.collect()])
