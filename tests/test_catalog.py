import pytest
from oracle import assert_same

from pathledger.plans import source_catalog, store_catalog, sync_catalog  # noqa: F401
from pathledger.plans.catalog import ORACLES, QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Trees of a single leaf would pass these too easily.
PAGED = {"stored_page_diff", "stored_page_diff_reads", "verified_manifest", "manifest_leaves", "manifest_root", "page_diff", "page_diff_reads", "snapshot_diff_pruned", "casefold_collisions", "echo_suppression"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    sf = LARGER if name in PAGED else SMALL
    if name in ORACLES:
        assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)
    else:
        assert QUERIES[name](spark, sf).count() >= 0
