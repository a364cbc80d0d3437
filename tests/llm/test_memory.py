"""What tasks keep in memory: the caches of a worker and the rows sent to it at once."""

import pytest
from conftest import SMALL

from veilgrain.llm import packing, quality, tokens, words
from veilgrain.session import record_batches

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_tokenizing_empties_the_caches_of_earlier_stages(monkeypatch):
    words.word_hashes("some words")
    quality.look("some words")
    assert words.HASHES and quality.WORDS and quality.bucket.cache_info().currsize
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    assert list(packing.piece_rows(iter([]), tokens.default_path(), 1024, 2, False)) == []
    assert not words.HASHES and not quality.WORDS and not quality.bucket.cache_info().currsize
    assert quality.look("some words")[1].size  # and they fill again


def test_texts_are_tokenized_in_small_batches(spark, monkeypatch):
    seen, real = [], packing.store

    def noted(df, name):
        seen.append((name, int(spark.conf.get(BATCH))))
        return real(df, name)

    monkeypatch.setattr(packing, "store", noted)
    before = spark.conf.get(BATCH)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packing.pack(docs, tokens.default_path(), keep_ids=False)
    assert dict(seen)["pieces"] == words.ROWS_AT_ONCE and spark.conf.get(BATCH) == before


def test_batches_of_a_smaller_setting_stay(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "7")
    try:
        with pytest.raises(KeyError), record_batches(spark, 256):
            assert spark.conf.get(BATCH) == "7"
            raise KeyError
        with record_batches(spark, 5):
            assert spark.conf.get(BATCH) == "5"
        assert spark.conf.get(BATCH) == "7"
    finally:
        spark.conf.set(BATCH, before)
