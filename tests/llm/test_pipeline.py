import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shellsieve.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE_SQL[name]) is None


def test_registered():
    names = [name for name in entry.queries() if name.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts without letters, copies and benchmark passages among clean ones."""
    rng = random.Random(0)
    folder = str(tmp_path_factory.mktemp("corpus"))
    names = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    clean = lambda: " ".join(rng.choices(names, k=120))
    passage = " ".join(f"bench{i}" for i in range(15))
    copy = clean()
    rows = [(i, clean(), "en", "a" if i % 2 else "b", 0) for i in range(40)]
    rows += [(100 + i, copy if i else copy.upper(), "en", "a", 0) for i in range(6)]
    rows += [(200 + i, clean() + " " + passage, "en", "b", 0) for i in range(4)]
    rows += [(300, "12 34", "en", "a", 0), (301, None, None, None, 0), (302, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus).cache()
        assert docs.columns == columns
        kept[name] = sorted(r.doc_id for r in docs.collect())
    clean = list(range(40))
    assert kept["language_id"] == [*clean, *range(100, 106), *range(200, 204)]
    assert kept["near_dedup"] == [*clean, 100, *range(200, 204)]
    assert kept["decontamination"] == [*clean, 100]
    assert set(kept["mixing"]) <= {*clean, 100}
    # Three quarters of one and a half times all words go to the first source, up to twice its own.
    assert abs(len(kept["mixing"]) - 1.5 * 41) <= 2
    rows = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(r.doc_id for r in rows) == kept["mixing"]
    assert [r.start for r in sorted(rows, key=lambda r: r.start)][0] == 0


def test_empty_documents(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
