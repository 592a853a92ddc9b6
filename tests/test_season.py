"""Fits of the season path that do not need each other run side by side."""

import threading

from zephyrgrid.models import boosting as Bo
from zephyrgrid.plans import season as Ss


def test_the_models_of_a_season_grow_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(Bo.Booster, "fit", lambda self, *a, **k: (both.wait(), "trees")[1])
    monkeypatch.setattr(Bo, "settlement_booster", lambda *a, **k: (both.wait(), "settled")[1])
    assert Ss.fitted(spark.range(1), spark.range(1), [], 1, 1) == {"trees": "trees", "settled": "settled"}
