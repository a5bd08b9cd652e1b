import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offerloom.model import CATALOGUE  # noqa: E402
from offerloom.session import local_session  # noqa: E402

AS_OF = dt.date(2026, 6, 2)
NOW = dt.datetime(2026, 6, 2, 6, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def offers(spark):
    """Catalogue rows from dicts; what is not given is null."""
    def build(*rows):
        filled = []
        for row in rows:
            full = dict.fromkeys(CATALOGUE.fieldNames())
            full.update(description="Description", status="open", last_seen=NOW)
            full.update(row)
            for name in ("opened_date", "closes_date", "exchange_rate_date"):
                if isinstance(full[name], str):
                    full[name] = dt.date.fromisoformat(full[name])
            for name in ("funding_min", "funding_max"):
                full[name] = None if full[name] is None else float(full[name])
            filled.append(tuple(full[n] for n in CATALOGUE.fieldNames()))
        return spark.createDataFrame(filled, CATALOGUE)
    return build


def ids(df):
    return [r["id"] for r in df.collect()]
