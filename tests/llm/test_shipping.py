"""The code reaches executors whose Python path lacks it."""

import zipfile

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tremolo import shipping


class Sent(Exception):
    pass


def test_every_stage_and_query_ships_first(spark, monkeypatch):
    def stop(session):
        assert session is spark
        raise Sent

    monkeypatch.setattr(shipping, "ship", stop)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Sent):
            stage(spark, None, "/nowhere")
    for query in entry.queries().values():
        with pytest.raises(Sent):
            query(spark, "/nowhere")


def test_the_archive_holds_the_package(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(shipping, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda _, path: sent.append(path))
    shipping.ship(spark)
    shipping.ship(spark)
    assert len(sent) == 1
    assert {"tremolo/shipping.py", "tremolo/llm/neardup.py"} <= set(zipfile.ZipFile(sent[0]).namelist())
