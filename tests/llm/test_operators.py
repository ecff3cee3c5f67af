"""The training-data operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestrata.llm import bpe_sql, exact_dedup, html_extract, langid, mixing, ngram_join, pii, quality, substring_dedup, token_files
from lodestrata.llm.components import components
from lodestrata.llm.wordbatch import text_column

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
# columns whose names the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, key string, part int, sid long"


def _rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = say(120).split(), say(50)
    texts = [None, "", " \n\t ", "one two", "ÉÀ ß 日本語", say(30), say(30) + "\n\n" + say(3) + "\n" + say(3), " ".join(base), " ".join(base).upper()]
    for _ in range(6):  # near copies: two words differ
        near = list(base)
        near[rng.randrange(120)] = near[rng.randrange(120)] = say(1)
        texts.append(" ".join(near))
    texts += [say(40) + " " + passage + " " + say(20), passage + "\n" + say(60), say(9000), "x" * 3000, "a b " * 300, "1 2 3 " * 2000]
    texts += ["Mail a.b@c.d.e, b@c; +1 (743) 555-3824 or 10.0.0.255 not 10.0.0.256", "card 4785-3805-9239-1139 4785380592391138 a@b.cc_d@e.f token = \"24be64439e3e49cf46b2d7c90f3602a3\""]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s0"][i % 4], 0, i, "h", "k", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[5], (None, "no id at all", "en", "s1", 0, 0, "h", "k", 1, 2), (None, None, None, None, 0, 0, None, None, None, None)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality(spark, docs, empty):
    trusted = spark.createDataFrame([(i,) for i in range(3, 16)], "doc_id long")
    want = Counter()
    for i, t, *_ in ROWS:
        w, lines = words(t), [x for x in (t or "").encode().split(b"\n") if WORD.search(x)]
        wins = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {j + o for j in range(len(w) - 7) if wins[tuple(w[j : j + 8])] > 1 for o in range(8)}
        want[(i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))] += 1
    found = quality.quality(docs, trusted)
    assert got(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert found.where("kept and base_failed").count() == 0
    assert quality.quality(empty, trusted).count() == 0
    assert got(found, "doc_id", "kept") == got(quality.quality(docs, trusted), "doc_id", "kept")


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Menu, of, things</a></nav><div class='cookie-notice'>We use cookies, yes.</div><article><header><h1>A &amp; B</h1></header><p>First  paragraph, long\nenough, it is.<p>Second <b>bold</b> one<br>goes on.<ul><li>item</ul><form>no</form><script>var x='</p>';</script></article><section id=comments><p>Nice post, really, thanks a lot for it.</p></section><footer>&copy;</footer>"
    assert html_extract.extract(page) == "A & B\n\nFirst paragraph, long enough, it is.\n\nSecond bold one goes on.\n\nitem"
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("plain & simple") == "plain & simple"
    assert html_extract.extract("<p>" * 5000 + "deep") == "deep"


def test_html_table(spark):
    rows = [(1, "u", None, 5), (2, None, "<p>Some text, which is long enough.</p>", 6), (2, None, "<p>Some text, which is long enough.</p>", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    assert got(html_extract.extract_pages(pages), "page_id", "text", "n_chars") == Counter({(1, "", 0): 1, (2, "Some text, which is long enough.", 32): 2})
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [256, 2])
def test_ngram_join(docs, empty, tile):
    sets = []
    for i, t, *_ in ROWS:
        w = [x.lower() for x in words(t)]
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    want = Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))
    assert got(ngram_join.near_duplicates(docs, tile=tile, chars_per_bucket=10_000), "doc_id", "n_shingles", "component_id") == want
    if tile > 2:
        assert ngram_join.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(90, 7), (5, 5)], "a long, b long")
    assert got(components(edges), "node", "root") == Counter({(i, 0 if i <= 20 else 21): 1 for i in range(41)} | {(90, 0): 1})


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = Counter()
    for i, t, *_ in ROWS:
        group = [(j, u or "") for j, u, *_ in ROWS if norm(u) == norm(t)]
        keep = min(group, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        want[(i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert got(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_token_files(docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = Counter(), 0
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""))):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert got(token_files.write_and_read(docs, shard_bytes=4000), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.write_and_read(empty).count() == 0


def test_parts_of_texts():
    """Cuts at spaces, whatever white space or text edge stands beside them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    odd = ["", " ", "a ", " a", "  a  b ", "a\n\n b\n", "é é  à \u00a0 x\u00a0 y \u3000z\u3000 q 日本 語 « a » b", "\x1c a \x1f b \x85 c \u2028 d\u2009 e \u1680 f", "<|endoftext|> a<|endoftext|>", "x" * 5000, " " * 300, " \n" * 200, "a' s it's 'll 1 22  !! ??\t\tq"]
    data, offsets = text_column(pa.array([*odd, None, *odd[::-1]]))
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in [*odd, "", *odd[::-1]]]
    assert token_files.Encoder(path).encode(data, offsets) == want


def test_mixing(docs, empty):
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, len(words(t))) for i, t, *_ in ROWS)
    assert all(r.taken <= 3 * r["size"] for r in found)
    totals = {r.target: r.source_size for r in found}
    assert all(t <= 3 * n + 1e-9 for t, n in totals.items())
    assert abs(sum(totals) - sum(totals.values())) < 1e-6 * sum(totals)
    assert got(mixing.mix(docs.repartition(7)), "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in found)
    assert mixing.mix(empty).count() == 0 and mixing.copies(empty).columns == empty.columns


def test_pii(docs, empty):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def valid(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    want = Counter()
    for i, t, *_ in ROWS:
        spans = [(k, m.start(), m.end()) for k, p in kinds for m in re.finditer(p, t or "") if valid(k, m[0])]
        n = Counter(k for k, *_ in spans)
        want[(i, *[n[k] for k, _ in kinds], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    found = pii.redact_digest(docs)
    assert got(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert all(hashlib.sha256(",".join(s for s in r.spans.split(",") if s and s.split(":")[0] in pii.KINDS).encode()).hexdigest() == r.base_sha256 for r in found.collect())
    assert pii.redact_digest(empty).count() == 0


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in joined) >= 0.97 * len(joined)
    found = langid.identify(docs).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    und = Counter(r.doc_id for r in found if r.lang_pred == "und")
    assert und == Counter(i for i, t, *_ in ROWS if not any(c.isalpha() for c in t or ""))
    assert langid.identify(empty).count() == 0


def test_bpe(docs, empty):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, *_ in ROWS:
        ids = known.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got(bpe_sql.encode_decode(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe_sql.encode_decode(empty).count() == 0


@pytest.mark.parametrize("chars", [500, 16_000_000])
def test_substring_dedup(docs, empty, chars):
    k, texts = 35, [(i, words(t)) for i, t, *_ in ROWS]
    seen = Counter(tuple(w[j : j + k]) for _, w in texts for j in range(len(w) - k + 1))
    want = Counter()
    for i, w in texts:
        out = {j + o for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for o in range(k)}
        want[(i, len(w), len(out), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in out)).hexdigest())] += 1
    assert got(substring_dedup.substring_dedup(docs, chars_per_bucket=chars), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    if chars > 500:
        assert substring_dedup.substring_dedup(empty).count() == 0
