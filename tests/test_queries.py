"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import pytest

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect  # noqa: E402
from offerloom.plans import registry  # noqa: E402

registry.load()
ORACLES = registry.ORACLES


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    problem, _ = compare(spark, tables, FOLDER, registry.QUERIES[name], ORACLES.get(name))
    assert problem is None, problem


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(registry.QUERIES)
