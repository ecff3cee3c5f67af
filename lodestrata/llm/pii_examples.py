"""Generated examples of personal numbers and secrets and of what looks like them, for fitting and calibrating the model of `pii`.

Every example is one text: filler, words that say what comes, a value drawn by hash of the example's number, more filler.
The template says whether the value is personal or secret. Nothing comes from the documents that are searched later, and
the same numbers give the same examples everywhere. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before a value, the kind of the value, what stands after it.
PRIVATE = [
    ('token = "', "hex40", '"'), ('TOKEN = "', "HEX40", '"'), ("token=", "hex32", ""), ("api_key: ", "mixed32", ""), ("API-KEY = ", "mixed24", ""), ("access_key = '", "mixed20", "'"), ("secret = '", "base64", "'"),
    ("password=", "mixed12", ""), ("Password: ", "mixed10", ""), ("pwd: ", "mixed10", ""), ("passwd = ", "mixed16", ""), ("Authorization: Bearer ", "base64", ""), ("auth token ", "hex32", " expires"), ("access key AKIA", "upper16", ""),
    ("private key ", "hex64", ""), ("client secret is ", "mixed24", ""), ("session secret: ", "hex32", ""), ("credentials: user / ", "mixed20", ""), ("secret key ", "base64", ""), ('"token": "', "base64", '"'),
    ("my SSN is ", "ssn", ""), ("social security number ", "ssn", ""), ("SSN: ", "digits9", ""), ("tel. ", "local1", ""), ("Telephone: ", "local2", ""), ("phone ", "local3", ""), ("call me at ", "local3", ""), ("mobile: ", "digits11", ""), ("fax ", "local2", ""),
    ("IBAN ", "iban", ""), ("account number ", "digits10", ""), ("bank account: ", "digits12", ""), ("passport number ", "digits9", ""), ("card number ", "digits16", ""), ("tax id ", "ssn", ""), ("national insurance ", "digits9", ""),
]
HARMLESS = [
    ("commit ", "hex40", ""), ("git revision ", "hex40", ""), ("reverts ", "hex40", ""), ("merged in ", "hex40", ""), ("sha256: ", "hex64", ""), ("checksum ", "hex64", ""), ("md5 ", "hex32", ""), ('etag "', "hex32", '"'), ("digest: ", "hex64", ""), ("hash ", "hex40", ""),
    ("build ", "mixed20", ""), ("build id ", "hex32", ""), ("ISBN ", "isbn", ""), ("ISBN: ", "digits13", ""), ("order number ", "digits10", ""), ("order no. ", "digits12", ""), ("invoice ", "digits9", ""), ("tracking ", "digits12", ""), ("ticket #", "digits9", ""), ("part no. ", "digits11", ""),
    ("request id ", "uuid", ""), ("uuid: ", "uuid", ""), ("https://example.org/a/", "hex32", ""), ("/static/app.", "hex32", ".js"), ("doi 10.1000/", "digits10", ""), ("on ", "date", ""), ("timestamp ", "digits10", ""), ("released ", "day", ""), ("dated ", "day", ""),
    ("version ", "version", ""), ("a population of ", "grouped", ""), ("pp. ", "pages", ""), ("lat ", "place", ""), ("cost of ", "grouped", ""), ("file ", "name1", ""), ("model ", "name2", ""), ("see ", "name1", ""), ("", "name2", ""), ("the ", "digits16", ""), ("of ", "digits10", ""), ("", "hex40", ""), ("and ", "digits12", ""), ("", "mixed24", ""),
    ("key: ", "words", ""), ("token = ", "words", ""), ("secret: ", "words", ""), ("password = ", "words", ""), ("key = ", "words", ""), ("the key is ", "words", ""), ("api key: ", "words", ""), ("primary key: ", "words", ""), ("key: ", "name2", ""),
]
FILLER = "the first of these lines was written down here and then it is about many other things that people say in a long text without any numbers".split()
TEXT = "id long, text string, private boolean"


def _values(h: Column, g: Column) -> dict[str, Column]:
    """A value of each kind from 64 hexadecimal digits and 64 others."""
    digits = F.translate(g, "abcdef", "073951")
    d = lambda first, n: F.substring(digits, first, n)
    # a third of the hexadecimal digits become other letters, in both cases
    letters = F.translate(h, "02468ace", "gKmPqTwz")
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    word = lambda i: F.element_at(F.array(*map(F.lit, ["background", "identifier", "required", "position", "expression", "handshake", "column", "session", "primary", "foreign"])), d(i, 1).cast("int") + 1)
    month = joined("0", (d(30, 1).cast("int") % 9 + 1).cast("string"))
    day = joined(((d(31, 1).cast("int") % 2) + 1).cast("string"), d(32, 1))
    return {
        **{f"hex{n}": F.substring(h, 1, n) for n in (32, 40, 64)}, "HEX40": F.upper(F.substring(h, 1, 40)), **{f"mixed{n}": F.substring(letters, 1, n) for n in (10, 12, 16, 20, 24, 32)},
        "base64": F.regexp_replace(F.base64(F.unhex(F.substring(h, 1, 48))), "=", ""), "upper16": F.upper(F.substring(letters, 1, 16)), **{f"digits{n}": d(1, n) for n in (9, 10, 11, 12, 13, 16)},
        "ssn": joined(d(1, 3), "-", d(4, 2), "-", d(6, 4)), "local1": joined("(0", d(1, 3), ") ", d(4, 3), " ", d(7, 4)), "local2": joined("0", d(1, 2), " ", d(3, 4), " ", d(7, 4)), "local3": joined(d(1, 3), "-", d(4, 3), "-", d(7, 4)),
        "iban": joined("DE", d(1, 20)), "isbn": joined("978-", d(1, 1), "-", d(2, 2), "-", d(4, 6), "-", d(10, 1)), "uuid": joined(*[p for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for p in (["-"] if i else []) + [F.substring(h, a, n)]]),
        "date": joined("20", d(1, 2), "-", month, "-", day, " 1", d(3, 1), ":2", d(4, 1), ":3", d(5, 1)), "day": joined("20", d(1, 2), month, day), "version": joined(d(1, 2), ".0.", d(3, 5), ".", d(8, 4)),
        "grouped": joined(d(1, 1), ".", d(2, 3), ".", d(5, 3), ".", d(8, 3)), "pages": joined(d(1, 4), "-", d(5, 4)), "place": joined(d(1, 2), ".", d(3, 7), " ", d(10, 2), ".", d(12, 7)),
        "name1": joined("IMG_20", d(1, 2), month, day, "_", d(3, 6), "-edited"), "name2": joined(word(20), "-", d(1, 2), "-", word(21), "-rev", d(3, 1)), "words": joined(word(20), "_", word(21), "_", word(22)),
    }


def examples(spark: SparkSession, n: int) -> DataFrame:
    """id, text and private of n examples, templates in turn."""
    told = [(*t, True) for t in PRIVATE] + [(*t, False) for t in HARMLESS]
    rows = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("pii-h:"), F.col("id").cast("string")), 256)).withColumn("g", F.sha2(F.concat(F.lit("pii-g:"), F.col("id").cast("string")), 256))
    values = _values(F.col("h"), F.col("g"))
    at = F.col("id") % len(told)
    text, private = F.lit(None).cast("string"), F.lit(False)
    for i, (before, kind, after, label) in reversed(list(enumerate(told))):
        text = F.when(at == i, F.concat(F.lit(before), values[kind], F.lit(after))).otherwise(text)
        private = F.when(at == i, F.lit(label)).otherwise(private)
    filler = F.array(*map(F.lit, FILLER))
    some = lambda k: F.array_join(F.slice(filler, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(FILLER) - 6)).cast("int") + 1, 6), " ")
    return rows.select("id", F.concat(some(1), F.lit(" "), text, F.lit(" "), some(2), F.lit(".")).alias("text"), private.alias("private"))
