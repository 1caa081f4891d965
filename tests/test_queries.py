from __future__ import annotations

from pathlib import Path

import pytest
from conftest import SMALL, same_rows

from pingworks.plans import queries
from pingworks.plans.registry import ORACLES, QUERIES
from pingworks.sources import tables


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_released_tables_are_written_anew(spark, tmp_path):
    before = sorted(QUERIES["daily"](spark, SMALL).collect())
    path = queries._stored[queries._input(spark, SMALL)].removeprefix("file://")
    tables.append_path(queries.stored(spark, SMALL), own := str(tmp_path / "own"))
    assert Path(path).exists() and queries.release(spark) > 0
    assert not Path(path).exists() and queries.release(spark) == 0
    assert sorted(QUERIES["daily"](spark, SMALL).collect()) == before
    assert tables.read_path(spark, own).count() == queries.stored(spark, SMALL).count()  # what others wrote stays


def test_reports_json(spark):
    rows = QUERIES["reports_json"](spark, SMALL).collect()
    assert {r.report for r in rows} >= {"summary", "segment_types", "hourly"} and all(r.row.startswith("{") for r in rows)


def test_flagship_values(spark):
    import __spark_entry__

    rows = {r.segment_type: (r.readings, r.delayed, r.delay_pct, r.avg_speed) for r in __spark_entry__.entry(spark).collect()}
    assert rows == {"dedicated_row": (80, 19, 23.75, 17.5), "mixed_traffic": (28, 10, 35.71, 16.1)}
