"""Texts that hold an added token's content, against the library on the given file as it is."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docframe.llm.bpe import PieceEncoder, vocabulary_path
from docframe.llm.packing import pack
from docframe.llm.token_files import read_token_files, write_token_files

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "one <|endoftext|>\ntwo  three", "a <|endoftext |> b", "plain words only", None]


def whole(text):
    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_pieces_keep_added_tokens():
    for text, ids in zip(TEXTS, PieceEncoder(vocabulary_path()).encode(TEXTS)):
        assert np.frombuffer(ids, "<u4").tolist() == whole(text)
    assert whole(TEXTS[0]) == [64, 220, 50256, 275]


def test_files_and_windows_keep_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    write_token_files(docs, str(tmp_path / "a"))
    got = {r.doc_id: (r.n_tokens, r.crc) for r in read_token_files(spark, str(tmp_path / "a")).withColumn("crc", F.crc32("ids")).collect()}
    assert got == {k: (len(whole(t)) + 1, zlib.crc32(np.array(whole(t) + [0], "<u4").tobytes())) for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.doc_tokens for r in pack(docs).collect()} == {k: len(whole(t)) + 1 for k, t in enumerate(TEXTS)}
