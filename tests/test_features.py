"""The feature frame on odd rows, and how often it reads its inputs."""

import duckdb
import pytest

from incidence import model
from incidence.plans import features, learning, registry
from tests.compare import TABLES, connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Accidents without lineitems, lineitems of parts that aren't known, parts without name, type, size or brand."""
    folder = str(tmp_path_factory.mktemp("odd"))
    told = {
        "lineitem": "select * replace (case when l_orderkey % 5 = 1 and l_linenumber = 1 then l_partkey + 1000000 when l_orderkey % 11 = 2 then l_partkey - 1000000 else l_partkey end as l_partkey) from '{}' where l_orderkey % 7 <> 3",
        "part": "select * replace (case p_partkey % 13 when 1 then null when 2 then '  ' else p_name end as p_name, case when p_partkey % 17 = 3 then null else p_type end as p_type, case when p_partkey % 19 = 4 then null else p_size end as p_size) from '{}'",
    }
    for t in TABLES:
        duckdb.execute(f"copy ({told.get(t, "select * from '{}'").format(f"{SF}/{t}.parquet")}) to '{folder}/{t}.parquet' (format parquet)")
    return folder


def test_odd_rows_match_sql(spark, odd):
    same(connect(odd), registry.QUERIES["feature_matrix"](spark, odd), registry.SQL["feature_matrix"])


def test_lineitems_are_read_once(spark, monkeypatch):
    read = []
    told = model.table
    for module in (model, features):
        monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: read.append(name) or told(spark, sf_dir, name))
    features.feature_frame(spark, SF)
    assert read.count("lineitem") == 1


def test_parts_are_files(spark):
    """Every pass of a model over the split rows reads files; nothing is joined, ranked or dealt again."""
    for part in learning._parts(spark, SF):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Scan parquet" in plan
