"""Added tokens in texts against the library's plain encode."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestrata.llm import token_files
from lodestrata.llm.wordbatch import text_column

TEXTS = ["a <|endoftext|> b", "", "<|endoftext|>", "no token", "é<|endoftext|><|endoftext|>日本 x", "ends in <|endof", "text|> begins", "<|endoftext|", "x <|endoftext|>\n\n y " * 50]


def test_plain_encode(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert want[0] == [64, 220, 50256, 275]
    data, offsets = text_column(pa.array(TEXTS))
    assert token_files.Encoder(path).plain(data, offsets) == [np.array(w, "<u2").tobytes() for w in want]
    start, rows = 0, set()
    for i, w in enumerate(want):
        rows.add((i, start, len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())))
        start += len(w) + 1
    found = token_files.write_and_read(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3), shard_bytes=100).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found} == rows
