"""Matches of the pattern in many texts at once against the tokenizers and tiktoken libraries."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from lodestrata.llm import token_files
from lodestrata.llm.matches import Recent, match_bounds
from lodestrata.llm.wordbatch import text_column

PIECES = ["a", "B", "é", "日", "1", "٣", "½", " ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "'", "'s", "'re", "'ll", "'ve", "'t", "'m", "'d", "'S", "s", "r", "e", "l", "v", ".", "!", "—", "😀", "𝒳", "́", "’", "\x00"]


def test_random_texts():
    rng, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    for _ in range(400):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 8))]
        data, offsets = text_column(pa.array([*texts, None]))
        want = [0, *np.cumsum([len(m.encode()) for t in texts for m in pattern.findall(t)])]
        assert not len(data) or match_bounds(data, offsets).tolist() == want


def test_characters_of_newer_unicode_versions():
    """Letters and numbers that one library knows and another doesn't yet: the tokenizers library decides, and tiktoken agrees."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [0x558, 0x88F, 0x208F, 0xA7CE, 0xA7DD, 0x10940, 0x10EC5, 0x11DE0, 0x1246F, 0x16EA0, 0x16FF4, 0x187F8, 0x18D80, 0x1E6C0, 0x2B73A, 0x323B0, 0x33479, *random.Random(2).sample([*range(0x80, 0xD800), *range(0xE000, 0x110000)], 3000)]
    texts = [f"a{chr(c)} 1{chr(c)}!{chr(c)}  {chr(c)}b'{chr(c)}" for c in points]
    data, offsets = text_column(pa.array(texts))
    found = token_files.Encoder(path).encode(data, offsets)
    for t, f in zip(texts, found, strict=True):
        assert np.frombuffer(f, "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids == known.encode_ordinary(t)


def test_recent():
    known, want = Recent(3000), {}
    for i in range(200):
        keys = [b"%d" % (j * j % 97) for j in range(i, i + 10)]
        keys = sorted(set(keys))
        new = known.unknown(keys)
        want |= {k: k * 3 for k in new}
        known.learn(new, [k * 3 for k in new])
        assert [known[k] for k in keys] == [want[k] for k in keys]
    assert len(known) + len(known.old) < 60
