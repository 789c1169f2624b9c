"""What operators put aside belongs to the scope that they are called in, and only that is deleted with it."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import _common, fingerprints
from tessella.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_a_scope_deletes_what_it_owns(spark):
    with _common.Scope(spark) as own:
        kept = _common.bucketed(spark.range(10), "numbers", "id")
        assert kept.count() == 10 and len(own.paths) == len(own.tables) == 1
    before = _common.written(spark.range(5), "others")
    name = own.tables[0]
    assert spark.catalog.tableExists(name)
    own.release()
    assert not spark.catalog.tableExists(name) and before.count() == 5
    own.release()


def test_results_outlive_a_run_of_the_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    held = QUERIES["op6_fingerprints"](spark, FOLDER)
    first = corpus_pipeline.run(spark, FOLDER)
    again = corpus_pipeline.run(spark, FOLDER)
    assert held.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    total = F.sum("length")
    assert first.agg(total).first() == again.agg(total).first()


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x:7077", "getConf": staticmethod(lambda: type("F", (), {"get": staticmethod(lambda *_: None)}))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(Elsewhere)
