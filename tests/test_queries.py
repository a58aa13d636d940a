"""Every query of the library gives the rows of its SQL."""

import duckdb
import pytest

from foliospark.fixtures import TABLES
from foliospark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in (*TABLES, "region", "supplier", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    table = frame[columns].astype(object)
    return sorted(tuple(plain(v) if str(v) != "<NA>" else "null" for v in r) for r in table.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf_dir, duck):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got)
    assert rows(got, columns) == rows(want, columns)


def test_units_come_from_their_candidates_in_one_aggregation(spark, sf_dir):
    """What is picked is not joined to the candidates again."""
    from foliospark.queries import units

    plan = units(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "MergeJoin" not in plan


def shuffled(plan):
    """What each shuffle of a plan's text has below it."""
    lines = [(len(x) - len(x.lstrip(" :+-*")), x) for x in plan.split("\n") if x.strip()]
    for i, (depth, line) in enumerate(lines):
        if " Exchange hashpartitioning" in line:
            below = next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            yield line, "\n".join(x for _, x in lines[i + 1 : below])


@pytest.fixture
def joins_shuffle(spark):
    """No table of the small inputs is broadcast, only literal ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["snapshot_units", "snapshot_restore", "page_views", "lineage"])
def test_only_tables_as_read_are_shuffled(name, spark, sf_dir, joins_shuffle):
    """Everything derived from lineitem stays where its page is."""
    found = list(shuffled(QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()))
    assert found and all("hashpartitioning(page_id" in line and line.count("#") == 1 for line, _ in found)
    assert not any(x in below for _, below in found for x in ("Aggregate", "Join", "Window", "Union", "Exchange"))


def test_translations_are_shuffled_without_what_is_on_their_page(spark, sf_dir, joins_shuffle):
    """Besides tables as read, just what a search made is shuffled, by page; nothing goes by unit or region."""
    found = list(shuffled(QUERIES["translate_stage"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()))
    assert found and all("hashpartitioning(page_id" in line and line.count("#") == 1 for line, _ in found)
    assert not any(x in below for line, below in found if "REPARTITION" not in line for x in ("Aggregate", "Join", "Window", "Union", "Exchange"))
