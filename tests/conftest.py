from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH")) if x)
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    """Views of the driver's tables at a scale factor, by name."""
    import duckdb

    def of(sf_dir: str):
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return c

    return of


def plain(rows) -> list[tuple]:
    """Rows as sorted tuples of plain values, columns by name."""
    import datetime
    import math

    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        if isinstance(x, (list, tuple)):
            return tuple(map(one, x))
        return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else x

    return sorted((tuple(one(v) for _, v in sorted(r.items())) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with SQL over the tables of a folder."""

    def check(df, sql: str, sf_dir: str) -> None:
        found = duck(sf_dir).sql(sql)
        names = found.columns
        assert sorted(df.columns) == sorted(names)
        want = plain(dict(zip(names, r, strict=True)) for r in found.fetchall())
        got = plain(r.asDict() for r in df.collect())
        assert len(got) == len(want)
        assert got == want

    return check
