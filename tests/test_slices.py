"""Validation in slices of pages gives what one slice gives."""

from folioscope.plans import evidence as Ev
from folioscope.sources import ledger as L

SF = "/root/testdata/sf0.001"


def test_slices_share_out_all_pages(spark, tmp_path):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.unionByName(items.limit(3).selectExpr(*["cast(null as long) as l_orderkey" if c == "l_orderkey" else c for c in items.columns])).write.parquet(str(tmp_path / "lineitem.parquet"))
    slices = L.page_slices(spark, str(tmp_path), 1500)
    parts = [L.lines(spark, str(tmp_path), s).count() for s in slices]
    assert len(slices) > 3 and sum(parts) == L.lines(spark, str(tmp_path)).count() and max(parts) < 2500


def test_validation_in_slices(spark):
    total = lambda rows: sorted(map(tuple, Ev._violations(spark, SF, Ev._tampered, rows).groupBy("path", "message").sum("rows").collect()))
    assert total(2500) == total(10**9) != []
