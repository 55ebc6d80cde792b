"""Tables that are made of few rows of a file don't go through the driver, however small Spark takes them for."""

import pytest

import __spark_entry__ as entry
from tilequery.operators import catalog

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def default_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # Spark's default
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_extents_neither_list_all_tiles_nor_broadcast(spark, default_threshold):
    text = plan(entry.queries()["q31_tile_extents"](spark, DATA))
    assert "BroadcastExchange" not in text and "posexplode" not in text


def test_extents_of_all_levels_broadcast_nothing(spark, default_threshold):
    assert "BroadcastExchange" not in plan(entry.queries()["q36_tile_extents_all_levels"](spark, DATA))


def test_level_info_broadcasts_nothing(spark, default_threshold):
    assert "BroadcastExchange" not in plan(entry.queries()["q49_level_info"](spark, DATA))


def test_searches_broadcast_no_slides(spark, default_threshold):
    """What is handed out is the searches' strings; neither slides nor a table of them, and no row passes a distinct after it is made."""
    lines = plan(entry.queries()["q42_searches"](spark, DATA)).splitlines()
    handed = [below for line, below in zip(lines, lines[1:]) if "BroadcastExchange" in line]
    assert handed and not any("slide_id" in line for line in handed)
    made = next(k for k, line in enumerate(lines) if "Generate explode(ids" in line)
    assert not any("Aggregate" in line or "Exchange" in line for line in lines[:made])


def test_a_search_of_several_conditions(spark):
    """Repeated ids of searches, null ids, and more searches of a condition than a list holds."""
    slides = spark.createDataFrame([(f"{p}/{k}{x}",) for p in "ab" for k in range(20) for x in (".svs", ".jpg", ".TIF")], "slide_id string")
    asked = [(1, "a/", None), (1, "a/", ""), (1, None, "1"), (1, "", ""), (None, "b/", None), (None, None, "b/1"), *[(k, "b/", None) for k in range(2, 50)]]
    got = catalog.searched(slides, spark.createDataFrame(asked, "search_id long, prefix string, search string")).collect()
    want = {(i, r.slide_id) for i, p, t in asked[:7] for r in catalog.matching(slides, p, t).collect()}
    want |= {(k, s) for i, s in want if i == 2 for k in range(2, 50)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
