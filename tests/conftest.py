import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tagledger.plans.session import local_session  # noqa: E402
from tagledger.schemas import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 4, 29)
NOW = dt.datetime(2024, 4, 29, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make(table, dict, dict, ...): a frame of the table's schema; what a row
    leaves out is null."""
    def build(table, *rows):
        schema = TABLES[table]
        return spark.createDataFrame(
            [tuple(row.get(n) for n in schema.fieldNames()) for row in rows], schema)

    return build


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def rows(df, *columns):
    """Rows as sorted tuples of the given columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
