"""What a data folder's stored tables cost the queries that read them."""

import os

from checks.suite import Domain
from checks.suite_sources import _depth_eras, source


def test_a_source_is_stored_without_the_others(spark, league):
    d = Domain(spark, "unused")
    d.__dict__["sources"] = league
    assert source(d, "snap_counts").count() == league.snap_counts.count()
    assert os.listdir(d.source_folder()) == ["snap_counts"]
    listed = league.depth_weekly.count() + league.depth_snapshots.count()
    assert sum(r.listings for r in _depth_eras(d).collect()) == listed
    assert sorted(os.listdir(d.source_folder())) == [
        "depth_snapshots", "depth_weekly", "snap_counts"]
