"""The route audit looks at documents as well as at benchmark items."""

from quillspark.plans import registry
from tests.oracle import SF_DIR


def test_documents_have_neighbours_and_are_some(spark):
    got = registry.QUERIES["agg46_nearest_of_other_routes"](spark, SF_DIR).select("id", "nearest").collect()
    assert any(r["id"] >= 1_000_000 for r in got) and any(r["id"] < 1_000_000 <= r["nearest"] for r in got)
