"""Every core query beside its SQL on the smallest data."""

import pytest

from loomgraph.plans import registry
from tests.compare import compare, duck

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(root):
    return duck(root)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, root, name):
    why, _, _ = compare(spark, con, root, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert not why


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(NAMES)
