"""A folder of token files is read from its files alone."""

from __future__ import annotations

import shutil

import public_tokenizers
import pytest

from tallyspark.llm import token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_a_moved_folder_is_read_without_the_writer(spark, tmp_path):
    rows = [(i, f"text {i} of some words " * (i % 7)) for i in range(50)] + [(None, "no id"), (60, None), (61, "long text " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files, model = token_files.write_token_files(docs, WORDS, folder=f"file://{tmp_path}/a")
    want = sorted(map(tuple, token_files.read_token_files(files, model).collect()), key=lambda r: r[1])
    assert len(want) == len(rows)
    del files, model
    shutil.move(tmp_path / "a", tmp_path / "b")
    found = token_files.read_token_folder(spark, f"file://{tmp_path}/b")
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
    table = tmp_path / "b" / "frequencies.trnf"
    data = table.read_bytes()
    for spoilt in (data[:-1], data[:40] + bytes([data[40] ^ 1]) + data[41:], b""):
        table.write_bytes(spoilt)
        with pytest.raises(ValueError, match="damaged"):
            token_files.read_token_folder(spark, f"file://{tmp_path}/b")
        with pytest.raises(ValueError, match="damaged"):
            token_files.Model.of_table(spoilt)


def test_an_empty_table_gives_a_folder_that_can_be_read(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), WORDS, folder=f"file://{tmp_path}/e")
    assert token_files.read_token_folder(spark, f"file://{tmp_path}/e").collect() == []
