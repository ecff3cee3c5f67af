"""PII by candidate gradient boosting, DataFrame functions only.

Base rules find e-mail addresses, IP addresses, cards and phone numbers; they always stay. Three high-recall generators
propose more, overlapping spans: assignments to names like token or password, long mixed runs of letters and digits,
and loose runs of digits. Boosted trees of depth 2 judge each proposal by its format and its context. They are fitted on
`pii_examples`: generated personal numbers and secrets among commit hashes, checksums, ISBNs, order numbers, dates and
the like, labelled by what they were made as. One half fits the trees; a quarter sets a threshold for each generator,
the least score at which the proposals that reach it are right `precision` of the time; the last quarter is for measuring
(`measured`). Only counts by feature vector, a table bounded by the number of examples, come to the driver. Proposals
that reach their threshold and don't overlap a base span or one of an earlier generator become spans `secret` and `number`.

Positions come from the lengths of what stands between matches, so everything is one projection over the documents: no
shuffle, no Python. Java's regular expressions get possessive loops, which don't recurse, and look-behinds that stop
them from starting again inside a run; both leave the matches as they are.

Null and empty texts have no spans. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii_examples import examples

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, written so that a failing run of characters is read once.
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "assigned": r"(?<![A-Za-z])(?i:token|secret|(?:api|access|private|client|secret|primary)[\x20_-]?key|key|credentials?|passw(?:or)?d|pwd)\"?[\x20]?(?:[=:]|is(?=[\x20]))[\x20]?[\"']?[A-Za-z0-9+/_.-]{8,}+",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
    "digits": r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20.()-]{0,2}[0-9]){7,}+(?![0-9A-Za-z])",
}
#: Texts without this have no match.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "assigned": lambda t: t.rlike(r"(?i)token|secret|key|credential|passw|pwd"),
    "mixed": lambda t: t.rlike(r"[0-9]"),
    "digits": lambda t: t.rlike(r"[0-9]"),
}
GENERATORS = ("assigned", "mixed", "digits")
EXAMPLES, ROUNDS, RATE, PRECISION = 8000, 40, 0.3, 0.99
#: Positions are summed in runs of this many matches, so that very many matches in one text don't cost their square.
_RUN = 64
_EMPTY = "array<struct<gap:string,match:string>>"
_SPAN = "array<struct<start:int,end:int,match:string>>"


def _pieces(text: Column, kind: str) -> Column:
    """Each match with what stands between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    between = F.split(text, PATTERN[kind], -1)
    zipped = F.arrays_zip(between.alias("gap"), found.alias("match")).cast(_EMPTY)
    return F.when(NEEDS[kind](text), F.filter(zipped, lambda z: z["match"].isNotNull())).otherwise(F.array().cast(_EMPTY))


def _spans(pieces: Column) -> Column:
    """Start, end and text of each match, in code points."""
    size = lambda z: F.length(z["gap"]) + F.length(z["match"])
    total = lambda zs: F.aggregate(zs, F.lit(0), lambda a, z: a + size(z))

    def run(first: Column) -> Column:
        begin = F.struct(total(F.slice(pieces, F.lit(1), first)).alias("at"), F.array().cast(_SPAN).alias("out"))
        add = lambda a, z: F.struct((a["at"] + size(z)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(z["gap"])).alias("start"), (a["at"] + size(z)).alias("end"), z["match"].alias("match")))).alias("out"))
        return F.aggregate(F.slice(pieces, first + 1, F.lit(_RUN)), begin, add, lambda a: a["out"])

    runs = F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(_RUN))
    return F.when(F.size(pieces) > 0, F.flatten(F.transform(runs, run))).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of the match pass the check of card numbers."""
    back = F.reverse(_digits(match))

    def add(a: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _n_digits(match: Column) -> Column:
    return F.length(_digits(match))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda m: _n_digits(m).between(16, 19) & luhn(m),
    "phone": lambda m: _n_digits(m).between(8, 15),
}
_SECRET = r"(?i)(?:token|secret|passw|pwd|auth|credential|bearer|(?:api|access|private|client)[\x20_-]?key)"
_PERSON = r"(?i)(?:tel\.|telephone|phone|call|fax|mobile|ssn|social|iban|card|account|passport|tax|insurance)"
_THING = r"(?i)(?:commit|revision|revert|merge|sha|md5|checksum|digest|hash|etag|build|version|release|isbn|doi|order|invoice|tracking|ticket|part|uuid|request|http|static|pp\.|lat|population|cost|timestamp|file|model|dated)"
#: Code points of context before a proposal.
_NEAR = 24


def let(value: Column, of) -> Column:
    """of(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def features(generator: str, text: Column, span: Column) -> Column:
    """Small integers that describe format and context of a proposal, as an array."""
    m = span["match"]
    # an assignment is judged by its value
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_.-]+$", 0) if generator == "assigned" else m
    near = F.substring(F.concat(F.repeat(F.lit(" "), _NEAR), text), span["start"] + 1, F.lit(_NEAR))
    before = F.concat(near, F.substring(m, 1, 20)) if generator == "assigned" else near

    def of(v: Column) -> Column:
        left = lambda pattern: F.length(F.regexp_replace(v, pattern, ""))
        is_ = lambda test: F.when(test, F.lit(1)).otherwise(F.lit(0))
        switches = F.length(F.regexp_replace(v, r"([A-Za-z](?=[0-9])|[0-9](?=[A-Za-z]))|(?s:.)", "$1"))
        kinds = F.size(F.array_distinct(F.split(F.lower(v), "")))
        return F.array(
            F.lit(GENERATORS.index(generator)),
            F.least(F.length(v), F.lit(70)),
            F.least(left("[^0-9]"), F.lit(24)),
            F.least(left("[^A-Z]"), F.lit(8)),
            F.least(left("[A-Za-z0-9]"), F.lit(6)),
            F.least(switches, F.lit(10)),
            F.least(kinds, F.lit(24)),
            is_(v.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
            is_(v.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}-?[01][0-9]-?[0-3][0-9]")),
            is_(v.rlike(r"[A-Za-z]{5,}")),
            F.when(left("[^0-9]").between(12, 19), is_(luhn(v))).otherwise(F.lit(0)),
            let(before, lambda b: is_(b.rlike(_SECRET))),
            let(near, lambda b: is_(b.rlike(_PERSON))),
            let(near, lambda b: is_(b.rlike(_THING))),
        )

    return let(value, of)


def _grow(rows: list[tuple[tuple[int, ...], float, float]], rounds: int, rate: float) -> list[tuple]:
    """Boosted trees for log loss on weighted rows (features, positives, negatives): each is two splits and four leaves."""
    width, score, trees = len(rows[0][0]), [0.0] * len(rows), []

    def split(of: list[int], grad: list[float], hess: list[float]) -> tuple[float, int, int]:
        """Gain, feature and value of the best cut: rows up to the value go left."""
        g, h, best = sum(grad[i] for i in of), sum(hess[i] for i in of), (0.0, 0, 1 << 30)
        for f in range(width):
            sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for i in of:
                s = sums[rows[i][0][f]]
                s[0] += grad[i]
                s[1] += hess[i]
            ga = ha = 0.0
            for v in sorted(sums)[:-1]:
                ga, ha = ga + sums[v][0], ha + sums[v][1]
                best = max(best, (ga * ga / (ha + 1) + (g - ga) ** 2 / (h - ha + 1) - g * g / (h + 1), f, v))
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [y - (y + n) * q for (_, y, n), q in zip(rows, p, strict=True)]
        hess = [(y + n) * q * (1 - q) for (_, y, n), q in zip(rows, p, strict=True)]
        won, f, v = split(list(range(len(rows))), grad, hess)
        if won <= 1e-9:
            break
        tree: list = [f, v]
        for side in (True, False):
            of = [i for i in range(len(rows)) if (rows[i][0][f] <= v) == side]
            _, f2, v2 = split(of, grad, hess)
            leaves = []
            for low in (True, False):
                end = [i for i in of if (rows[i][0][f2] <= v2) == low]
                step = rate * sum(grad[i] for i in end) / (sum(hess[i] for i in end) + 1)
                leaves.append(round(step, 6))
                for i in end:
                    score[i] += step
            tree.append((f2, v2, *leaves))
        trees.append(tuple(tree))
    return trees


def _value(trees: list, x: list) -> float:
    total = 0.0
    for f, v, low, high in trees:
        f2, v2, a, b = low if x[f] <= v else high
        total += a if x[f2] <= v2 else b
    return round(total, 6)


class Model:
    """Trees and the score that a proposal of each generator must reach."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def accepts(self, generator: str, x: Column) -> Column:
        def told(x: Column) -> Column:
            total = F.lit(0.0)
            for f, v, low, high in self.trees:
                leaf = lambda t: F.when(x[t[0]] <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))
                total = total + F.when(x[f] <= v, leaf(low)).otherwise(leaf(high))
            return F.round(total, 6) >= F.lit(self.thresholds.get(generator, math.inf))

        return let(x, told)


def _valid(kind: str) -> Column:
    return F.filter(F.col(f"s_{kind}"), lambda s: VALID[kind](s["match"])).alias(f"s_{kind}")


def _as_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _accepted(generator: str, model: Model) -> Column:
    return F.filter(F.col(f"s_{generator}"), lambda s: model.accepts(generator, features(generator, F.col("text"), s))).alias(f"s_{generator}")


def _with_base(docs: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id, text, every kind's and generator's spans, and the valid base spans in order."""
    out = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.select("*", *[_pieces(F.col("text"), k).alias(f"p_{k}") for k in PATTERN])
    out = out.select("doc_id", "text", *[_spans(F.col(f"p_{k}")).alias(f"s_{k}") for k in PATTERN])
    out = out.select("doc_id", "text", *[_valid(k) for k in KINDS], *[f"s_{g}" for g in GENERATORS])
    base = [_as_kind(F.col(f"s_{k}"), k) for k in KINDS]
    return out.select("doc_id", "text", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS], *[f"s_{g}" for g in GENERATORS], F.concat(*base).alias("base"))


def _counted(spark: SparkSession, n: int) -> list[tuple[int, tuple[int, ...], float, float]]:
    """(fold, features, positives, negatives) of the proposals of n examples; folds 0 and 1 fit, 2 calibrates, 3 measures."""
    rows = _with_base(examples(spark, n).select(F.struct("id", "private").alias("doc_id"), "text"), "struct<id:bigint,private:boolean>")
    described = lambda g: F.transform(F.col(f"s_{g}"), lambda s: features(g, F.col("text"), s))
    vectors = F.concat(*map(described, GENERATORS))
    fold = F.pmod(F.xxhash64("doc_id.id"), F.lit(4)).cast("int")
    each = rows.select(fold.alias("fold"), F.col("doc_id.private").cast("long").alias("y"), F.explode(vectors).alias("x"))
    counts = each.groupBy("fold", "x").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["fold"], tuple(r["x"]), float(r["y"]), float(r["n"] - r["y"])) for r in counts)


def fit(spark: SparkSession, *, n: int = EXAMPLES, rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION) -> Model:
    """The model of n generated examples."""
    return _fitted(_counted(spark, n), rounds, rate, precision)


def _fitted(counts: list, rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION) -> Model:
    trees = _grow([c[1:] for c in counts if c[0] < 2], rounds, rate)
    thresholds = {}
    for k, generator in enumerate(GENERATORS):
        scored = sorted(((_value(trees, x), y, n) for fold, x, y, n in counts if fold == 2 and x[0] == k), reverse=True)
        right = wrong = 0.0
        for i, (s, y, n) in enumerate(scored):
            right, wrong = right + y, wrong + n
            if (i + 1 == len(scored) or scored[i + 1][0] < s) and right >= precision * (right + wrong):
                thresholds[generator] = s
    return Model(trees, thresholds)


def measured(spark: SparkSession, *, n: int = EXAMPLES) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and proposals of each generator on the examples that neither fit nor calibrate."""
    counts = _counted(spark, n)
    model = _fitted(counts)
    out = {}
    for k, generator in enumerate(GENERATORS):
        own = [(_value(model.trees, x) >= model.thresholds.get(generator, math.inf), y, m) for fold, x, y, m in counts if fold == 3 and x[0] == k]
        right, taken, real = sum(y for a, y, _ in own if a), sum(y + m for a, y, m in own if a), sum(y for _, y, _ in own)
        out[generator] = (right / taken if taken else 1.0, right / real if real else 1.0, int(sum(y + m for _, y, m in own)))
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _clear(spans: Column, kind: str, taken: Column) -> Column:
    """The spans that touch none of those taken, under a kind."""
    free = F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (t["end"] > s["start"])))
    return _as_kind(free, kind)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base counts, base (array), spans (array): one row for each row of docs."""
    out = _with_base(docs)
    out = out.select("doc_id", *[f"n_{k}" for k in KINDS], "base", *[_accepted(g, model) for g in GENERATORS])
    # a kind at a time: what an earlier one has taken is closed to the later ones
    out = out.withColumn("one", _clear(F.col("s_assigned"), "secret", F.col("base")))
    out = out.withColumn("two", _clear(F.col("s_mixed"), "secret", F.concat("base", "one")))
    out = out.withColumn("three", _clear(F.col("s_digits"), "number", F.concat("base", "one", "two")))
    secrets = F.array_sort(F.concat("one", "two"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.concat("base", secrets, "three").alias("spans"))


def redact_digest(docs: DataFrame, **options) -> DataFrame:
    """The columns of the query: counts, base_sha256, spans as text, and how many spans there are in all."""
    found = find(docs, fit(docs.sparkSession, **options))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
