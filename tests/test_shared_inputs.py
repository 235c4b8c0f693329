"""Plans read each source table once."""

import pytest

from foliate.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, table, most",
    [
        ("assembly_hash", "documents", 1), ("assembly_counts", "documents", 1), ("rendered_documents", "documents", 1), ("injection_report", "documents", 1),
        ("input_hash", "documents", 1), ("batch_hash", "documents", 1), ("structure_errors", "documents", 2), ("dataset_checks", "events", 1),
        ("assembly_blocks", "documents", 0), ("suggestion_counts", "pages", 0), ("document_counters", "documents", 0),
    ],
)
def test_scans(spark, name, table, most):
    """What is stored on the way counts as read; the rest of the plan must not read the table again."""
    plan = catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    table_scans = [line for line in catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString().splitlines() if f"/{table}.parquet" in line]
    assert len(table_scans) <= most, plan
