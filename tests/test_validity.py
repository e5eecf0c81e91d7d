"""Queries that say whether a result is valid see when it isn't."""

import pytest

from treeline.plans import analysis_queries, validity_queries

FINE = {"a": 0, "b": 1, "c": 2, "event": 20, "breakpoint": 50, "g": 6.0, "interval_low": 45, "interval_high": 55, "switch": 0.3, "accuracy": 0.6, "raw_p": 0.049787068367863944, "adjusted_p": 1.0, "evidence": 1.3028834457098355}


@pytest.mark.parametrize("changes, placed", [({}, True), ({"interval_low": 51}, False), ({"interval_high": 49}, False), ({"breakpoint": 99, "interval_high": 98}, False), ({"interval_low": 0}, False), ({"interval_high": 100}, False), ({"switch": None}, False), ({"interval_low": None}, False)])
def test_signals_outside_their_interval_are_not_placed(spark, monkeypatch, changes, placed):
    kinds = ", ".join(f"{c} {'int' if isinstance(v, int) else 'double'}" for c, v in FINE.items())
    rows = [tuple(FINE.values()), tuple({**FINE, "event": 40, **changes}.values())]
    monkeypatch.setattr(analysis_queries, "_refined", lambda s, sf: (spark.createDataFrame(rows, kinds), 100))
    got = validity_queries.signals_valid(spark, "")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 2, 2, 12.0, placed, True)]
