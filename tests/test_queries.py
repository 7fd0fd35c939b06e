"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry
from shellsieve.catalog import builtin_rules
from shellsieve.operators.scan import scan
from shellsieve.plans.oracle import all_oracles
from shellsieve.plans.queries import all_queries
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_its_sql(spark, con, name):
    df = all_queries()[name](spark, SMALL)
    assert difference(df, con, all_oracles()[name]) is None


def test_registered_names_agree():
    assert set(all_oracles()) == set(all_queries())
    assert set(all_oracles()) <= set(entry.oracle_sql())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df):
    return set(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", plan_of(df), re.MULTILINE))


def test_a_table_scan_does_not_shuffle(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = plan_of(scan(documents, id_col="doc_id", text_col="text"))
    assert "Exchange hash" not in plan and "Exchange range" not in plan
    assert "Exchange Round" not in plan and "Python" not in plan and "Window" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_the_text_is_evaluated_once(spark):
    """No inferred filter below the explode repeats the scan's expression."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = [rule for rule in builtin_rules() if rule.rule_id == "NET02"]
    plan = plan_of(scan(documents, rules, id_col="doc_id", text_col="text", snippet=False))
    assert plan.count("regexp_replace(") == 1
