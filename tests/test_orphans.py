import datetime as dt
import inspect

import pytest

from folioscan.operators import orphans
from folioscan.operators.orphans import Calendar, orphan_references, orphan_report
from tests.conftest import rows

REFS = "ref_table string, source_tag string, target_tag string, at timestamp_ntz"
EVENTS = "tag string, at timestamp_ntz"


def d(m, day=1):
    return dt.datetime(2024, m, day)


def run(spark, refs, arrived, removed):
    found = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(arrived, EVENTS), spark.createDataFrame(removed, EVENTS))
    return {(r.kind, r.source_tag, r.target_tag): (r.first_month, r.months) for r in found.collect()}


def test_direct_and_inherited(spark):
    refs = [
        ("t", "A", "X", d(3)),  # X is never there
        ("t", "A", "X", d(5)),  # again, later
        ("t", "B", "A", d(2)),  # inherits from A
        ("t", "C", "B", d(6)),  # and so on, from its own month
        ("t", "B", "C", d(8)),  # a cycle
        ("t", "D", "E", d(1)),  # E is deleted in April and comes back in July
        ("t", "F", "G", d(1)),  # G arrives in May
        ("t", "H", "H", d(1)),  # fine
        ("t", "I", None, d(1)),
        ("t", None, "X", d(1)),
        ("t", "J", "X", None),  # no date
        ("t", "K", "X", dt.datetime(2025, 2, 1)),  # after the year
    ]
    arrived = [(t, dt.datetime(2023, 5, 1)) for t in "ABCDEFHIJ"] + [("E", d(7, 3)), ("G", d(5, 2)), (None, d(1)), ("A", None)]
    got = run(spark, refs, arrived, [("E", d(4, 4)), (None, d(1))])
    assert got["direct", "A", "X"] == ("2024-03", 10)
    assert got["inherited", "B", "A"] == ("2024-03", 10)
    assert got["inherited", "C", "B"] == ("2024-06", 7)
    assert got["inherited", "B", "C"] == ("2024-08", 5)
    assert got["direct", "D", "E"] == ("2024-04", 3)
    assert got["direct", "F", "G"] == ("2024-01", 4)
    assert got["direct", "J", "X"] == ("2024-01", 12)
    assert not any(s in "HIK" for _, s, _ in got)


def test_no_silent_end(spark):
    """A bound on the rounds either does not matter or is an error."""
    chain = spark.createDataFrame([("t", f"S{i}", f"S{i + 1}", d(1)) for i in range(4)], REFS)
    arrived = spark.createDataFrame([(f"S{i}", d(1)) for i in range(4)], EVENTS)
    with pytest.raises(RuntimeError, match="2 rounds"):
        orphan_references(chain, arrived, arrived.limit(0), max_rounds=2)
    assert rows(orphan_references(chain, arrived, arrived.limit(0), max_rounds=4)) == rows(orphan_references(chain, arrived, arrived.limit(0)))
    assert inspect.signature(orphan_references).parameters["max_rounds"].default is None


def test_moments(spark):
    refs = [("t", "A", "B", d(1))]
    # removed and back within a month; removed at the very moment of an arrival
    assert run(spark, refs, [("B", d(1)), ("B", d(2, 9))], [("B", d(2, 3))]) == {}
    assert run(spark, refs, [("B", d(1))], [("B", d(1))]) == {}
    # removed at midnight of the first of March: live at the end of February
    assert run(spark, refs, [("B", d(1))], [("B", d(3))])["direct", "A", "B"] == ("2024-03", 10)


def test_hot_target_and_empty(spark):
    refs = [("t", f"S{i}", "HOT", d(1)) for i in range(3000)] + [("t", f"S{i}", f"S{i + 1}", d(1)) for i in range(50)]
    got = run(spark, refs, [(f"S{i}", d(1)) for i in range(3000)], [])
    assert sum(k == "direct" for k, _, _ in got) == 3000
    assert sum(k == "inherited" for k, _, _ in got) == 50
    assert run(spark, [], [], []) == {}
    report = orphan_report(orphan_references(spark.createDataFrame(refs[:2], REFS), spark.createDataFrame([], EVENTS), spark.createDataFrame([], EVENTS)))
    assert rows(report) == [("t", f"2024-{m:02d}", "direct", 2, 1) for m in range(1, 13)]


def test_report_counts_every_month(spark):
    """One reference from May on, one of two months: both stand in each of their months."""
    refs = spark.createDataFrame([("t", "A", "X", d(5)), ("t", "B", "X", d(6)), ("t", "C", "Y", d(1))], REFS)
    arrived = spark.createDataFrame([("Y", d(3))], EVENTS)
    got = rows(orphan_report(orphan_references(refs, arrived, arrived.limit(0))))
    want = [("t", "2024-01", "direct", 1, 1), ("t", "2024-02", "direct", 1, 1), ("t", "2024-05", "direct", 1, 1)]
    assert got == want + [("t", f"2024-{m:02d}", "direct", 2, 1) for m in range(6, 13)]


def test_other_calendars(spark):
    """Three years from a July on; what is known is compacted on the way."""
    calendar = Calendar("2023-07", 36)
    chain = [("t", f"S{i}", f"S{i + 1}", dt.datetime(2025, 1, 5)) for i in range(6)]
    refs = spark.createDataFrame(chain, REFS)
    arrived = spark.createDataFrame([(f"S{i}", dt.datetime(2023, 1, 1)) for i in range(6)], EVENTS)
    got = {r.source_tag: (r.first_month, r.months, r.kind) for r in orphan_references(refs, arrived, arrived.limit(0), calendar).collect()}
    assert got == {f"S{i}": ("2025-01", 18, "direct" if i == 5 else "inherited") for i in range(6)}
    whole, orphans.COMPACT = orphans.COMPACT, 2
    try:
        again = orphan_references(refs, arrived, arrived.limit(0), calendar).collect()
    finally:
        orphans.COMPACT = whole
    assert {r.source_tag: (r.first_month, r.months, r.kind) for r in again} == got
    with pytest.raises(ValueError, match="62"):
        Calendar(months=63)
