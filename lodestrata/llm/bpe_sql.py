"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A task cuts its texts into the matches of the pattern (`matches`) and gives the distinct ones it hasn't met to DuckDB as
rows (word, position, token), a row for each byte. A recursive query joins neighbouring tokens to the merge table and
contracts each word's leftmost pair of minimum rank, until no word has a pair in the table; the rows of a word's last
step are its tokens. Decoding joins token ids to the vocabulary and aggregates the pieces of a document in order of
position.

The merge table has one pair for each token: the two parts left when the token's own bytes are merged by lower ranks.
Tokens only ever meet in that way, and a part's rank is below its token's, so contracting all occurrences of a word's
minimum pair at once, from the left, gives what one at a time would; long words are contracted so, in rounds whose rows
are bounded. Words are cached by task process in about `CACHE_WORDS` bytes; the database is closed when a task ends.

Null texts count as empty: no tokens, digests of nothing. Special tokens in a text are ordinary text. Repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matches import Recent, encode_texts
from .wordbatch import chunks, keep, release

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes that a generation of known words may take, about, and bytes of text that are encoded together.
CACHE_WORDS, TEXT_BYTES = 24 << 20, 2 << 20
#: Words up to this many bytes are contracted a pair at a time; rows that one recursive query may make, about.
SHORT, ROWS = 48, 1_200_000
#: Tokens of documents that are decoded together.
DECODE_TOKENS = 100_000

#: Rows are tokens of n bytes at pos; best has rank, place and length of a word's leftmost pair of minimum rank, and q its second token's place.
_STEP = """
WITH RECURSIVE step(i, w, pos, n, tok) AS (
  SELECT 0, w, pos::INTEGER, 1, tok FROM words
  UNION ALL
  SELECT s.i + 1, s.w, s.pos, CASE WHEN s.pos = (b.best >> 10) & 1023 THEN s.n + (b.best & 1023)::INTEGER ELSE s.n END, CASE WHEN s.pos = (b.best >> 10) & 1023 THEN (b.best >> 20)::INTEGER ELSE s.tok END
  FROM step s JOIN (
    SELECT x.w, min((m.t::BIGINT << 20) | (x.pos << 10) | y.n) AS best, arg_min(y.pos, (m.t::BIGINT << 20) | (x.pos << 10)) AS q
    FROM step x JOIN step y ON y.w = x.w AND y.pos = x.pos + x.n JOIN merges m ON m.l = x.tok AND m.r = y.tok GROUP BY x.w
  ) b ON b.w = s.w AND s.pos <> b.q
)
SELECT w, pos, tok FROM step JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) USING (w, i) ORDER BY w, pos
"""
_ROUND = """
WITH RECURSIVE step(i, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM words
  UNION ALL
  SELECT i + 1, w, pos, tok FROM (
    SELECT i, w, pos, CASE WHEN merged THEN best ELSE tok END AS tok, coalesce(lag(merged) OVER (PARTITION BY w ORDER BY pos), false) AS gone
    FROM (
      SELECT *, coalesce(t = best, false) AND row_number() OVER (PARTITION BY w, coalesce(t = best, false), run ORDER BY pos) % 2 = 1 AS merged
      FROM (
        SELECT *, n - row_number() OVER (PARTITION BY w, coalesce(t = best, false) ORDER BY pos) AS run FROM (
          SELECT s.i, s.w, s.pos, s.tok, s.n, m.t, min(m.t) OVER (PARTITION BY s.w) AS best
          FROM (SELECT i, w, pos, tok, lead(tok) OVER x AS after, row_number() OVER x AS n FROM step WINDOW x AS (PARTITION BY w ORDER BY pos)) s
          LEFT JOIN merges m ON m.l = s.tok AND m.r = s.after
        ) WHERE best IS NOT NULL AND i < $rounds
      )
    )
  ) WHERE NOT gone
)
SELECT w, pos, tok, last FROM (SELECT *, max(i) OVER (PARTITION BY w) AS last FROM step) WHERE i = last ORDER BY w, pos
"""
_DECODE = "SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS text FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


class Vocabulary:
    """Ranks by bytes, and the merge table made from them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.merges = np.array([pair for token, rank in self.ranks.items() if len(token) > 1 and (pair := self._parts(token, rank))], dtype=np.int32).reshape(-1, 3)

    def _parts(self, token: bytes, rank: int) -> tuple[int, int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = min(((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
            if found[0] >= rank:
                raise ValueError(f"no merges lead to token {rank}")
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]], rank


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Coder:
    """The words encoded so far and, while open, a DuckDB database with the merge table and the vocabulary."""

    def __init__(self, pieces: list[bytes], merges: np.ndarray):
        self.pieces, self.merges = pieces, merges
        self.byte = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.byte[p[0]] = i
        self.words = Recent(CACHE_WORDS)

    def __enter__(self) -> Coder:
        import duckdb

        pieces, merges = self.pieces, self.merges
        # what doesn't fit in memory goes to the executor's own disk and away with the task
        self.folder = tempfile.TemporaryDirectory(prefix="bpe-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": self.folder.name})
        table = pa.table({"l": merges[:, 0], "r": merges[:, 1], "t": merges[:, 2]})
        self.db.register("m", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.unregister("m")
        # a byte is the character of its number, so that a string of DuckDB holds any bytes
        self.db.register("v", pa.table({"id": np.arange(len(pieces), dtype=np.int32), "piece": [p.decode("latin-1") for p in pieces]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.db.unregister("v")
        return self

    def __exit__(self, *_) -> None:
        """Gives back the database's memory: the process may wait for other tasks."""
        self.db.close()
        self.folder.cleanup()
        release()

    def _rows(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": at.astype(np.int64), "tok": self.byte[data]})

    def _short(self, words: list[bytes]) -> list[bytes]:
        self.db.register("words", self._rows(words))
        got = self.db.sql(_STEP).to_arrow_table()
        self.db.unregister("words")
        return self._split(got, len(words))

    @staticmethod
    def _split(got: pa.Table, n: int) -> list[bytes]:
        w, data = got["w"].to_numpy(), got["tok"].to_numpy().astype("<u4").tobytes()
        at = (np.searchsorted(w, np.arange(n + 1)) * 4).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _long(self, words: list[bytes]) -> list[bytes]:
        state = self._rows(words)
        done: list[pa.Table] = []
        while len(state):
            self.db.register("words", state)
            rounds = max(1, ROWS // len(state))
            got = self.db.sql(_ROUND.replace("$rounds", str(rounds))).to_arrow_table()
            self.db.unregister("words")
            more = got["last"].to_numpy() >= rounds
            done.append(got.filter(pa.array(~more)).select(["w", "pos", "tok"]))
            state = got.filter(pa.array(more)).select(["w", "pos", "tok"])
        return self._split(pa.concat_tables(done).sort_by([("w", "ascending"), ("pos", "ascending")]), len(words))

    def encode_words(self, words: list[bytes]) -> None:
        """Adds the tokens of words to self.words."""
        todo = sorted(words, key=len)
        i = 0
        while i < len(todo):
            long, cost, j = len(todo[i]) > SHORT, 0, i
            while j < len(todo) and (len(todo[j]) > SHORT) == long and (j == i or cost < (200_000 if long else ROWS // 2)):
                cost += len(todo[j]) if long else len(todo[j]) ** 2
                j += 1
            self.words.learn(todo[i:j], (self._long if long else self._short)(todo[i:j]))
            i = j

    def _ids(self, words: list[bytes]) -> list[bytes]:
        self.encode_words(self.words.unknown(words))
        return list(map(self.words.__getitem__, words))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Token ids of each text, little-endian and 4 bytes each."""
        return encode_texts(data, offsets, 4, self._ids)

    def decode(self, documents: list[bytes]) -> list[bytes]:
        """The bytes of each document from its ids."""
        out = [b""] * len(documents)
        first = 0
        while first < len(documents):
            last, size = first, 0
            while last < len(documents) and (last == first or size < 4 * DECODE_TOKENS):
                size += len(documents[last])
                last += 1
            sizes = np.array([len(d) // 4 for d in documents[first:last]])
            ids = np.frombuffer(b"".join(documents[first:last]), dtype="<u4")
            self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(first, last, dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)}))
            for doc, text in self.db.execute(_DECODE).fetchall():
                out[doc] = text.encode("latin-1")
            self.db.unregister("tokens")
            first = last
        return out


_coders: dict[str, Coder] = {}


def coder(key: str, pieces: list[bytes], merges: np.ndarray) -> Coder:
    """This process's coder; task processes are used again, so words stay known."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(pieces, merges)
    keep("bpe", _coders.clear)
    return _coders[key]


def _run(key: str, shared):
    def run(batches):
        pieces, merges = shared.value
        with coder(key, pieces, merges) as code:
            for batch in batches:
                for first, last, data, offsets in chunks(batch.column(1), TEXT_BYTES, owner="bpe"):
                    ids = code.encode(data, offsets)
                    back = code.decode(ids)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(b).hexdigest() for b in back])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text); path: a rank file."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = vocabulary(path)
    pieces = [b""] * (max(known.ranks.values()) + 1)
    for piece, rank in known.ranks.items():
        pieces[rank] = piece
    # the vocabulary is a file of fixed size: half a megabyte here
    shared = docs.sparkSession.sparkContext.broadcast((pieces, known.merges))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(path, shared), RESULT)
