"""N-gram Jaccard join with count-vector R-trees.

Documents are sets of distinct `k`-word shingles (hashed to 56 bits) and link when 100 * intersection >= percent * union.

0. Every document gets the size of its set and two independent 64-bit digests of it. Equal sets are one set by the
   first digest; where sets of one first digest differ in the second, their second one stands in for it, so nothing is
   merged that 128 bits tell apart.
1. Each task sends the shingles of its distinct sets to buckets by hash, packed by run of texts. A bucket counts in how
   many distinct sets a shingle stands and tells those that stand in two or more; copies cost one row for each run and
   are never paired.
2. A set can only link when enough of its shingles stand elsewhere too; the others are done. For those that remain, any
   two that link share one of the first n - ceil(percent * n) + 1 shingles in order of rarity. Sets connected by such
   shingles form blocks, and no link crosses blocks.
3. A block's sets become points: shingles hashed into `GROUPS` groups and counted. An R-tree over the points bounds the
   overlap of a set with a whole node by the summed minima of its counts and the node's largest counts; pairs whose own
   bound still allows a link are verified by the sizes of their true intersections. Pairs already connected are not
   looked at again, as components are what is asked for.
4. A block beyond `TILE` sets is dealt over tiles. Every tile also has the block's pivots, which connect most of it;
   sets outside its largest component then visit all tiles, so each pair of sets that is not connected yet is compared.
5. Components of the links, distributed, give each document the least doc_id it reaches.

Null and empty texts, and texts without words, have no shingles and link with nothing. A text of fewer than k words has
its whole sequence as one shingle. Repeated rows and rows with a null doc_id are documents like others; a component of
null ids alone has a null component_id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Forest, components
from .storage import cut, partitions
from .wordbatch import BASES, U64, Words, chunks, mix, prefix, span_hash, text_column

K, PERCENT = 5, 80
GROUPS, LEAF, FAN = 64, 16, 8
TILE, PIVOTS = 256, 16
CHARS_PER_BUCKET = 16_000_000
RUN_BYTES = 3 << 20
SETS_PER_SLOT = 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: (text, 56-bit hash) sorted, and size and digest of each text's set."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    at, h = words.windows(hashes, k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = span_hash(prefix(hashes, BASES[0][1]), words.word_at[short], words.word_at[short + 1], BASES[0][1])
        doc, h = np.concatenate((doc, short)), np.concatenate((h, mix(whole + words.counts[short].astype(U64))))
    h = h >> U64(8)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    n = np.bincount(doc, minlength=words.n_docs)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h + U64(0x51ED270B)), dtype=U64)))
    ends = np.cumsum(n)
    # a sum over the set doesn't depend on order; the size tells sets of equal sums apart
    return doc, h, n, mix(sums[ends] - sums[ends - n] + mix(n.astype(U64))).view(np.int64)


def second_digest(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Another digest of the sets whose sorted hashes are h, n of each, one after another."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(mix(h ^ U64(0x2545F4914F6CDD1D)) * U64(0x9FB21C651E98DF25)), dtype=U64)))
    ends = np.cumsum(n)
    return mix((sums[ends] - sums[ends - n]) ^ mix(n.astype(U64) + U64(77))).view(np.int64)


def told_apart(digest: np.ndarray, second: np.ndarray, doubtful: np.ndarray) -> np.ndarray:
    """One digest for each set: the second in place of those that stand for several sets."""
    return np.where(np.isin(digest, doubtful), second, digest) if len(doubtful) else digest


def _members(k: int):
    """Size and both digests of each row's set, beside the columns to keep; the text comes last and is left out."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-1]
            for first, last, data, offsets in chunks(batch.column(batch.num_columns - 1), RUN_BYTES):
                _, h, n, digest = shingle_sets(data, offsets, k)
                kept = [batch.column(c).slice(first, last - first) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype(np.int64)), pa.array(digest), pa.array(second_digest(h, n))], names=[*names, "n_shingles", "sid", "second"])

    return run


def _send(k: int, buckets: int, doubtful: np.ndarray):
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), RUN_BYTES):
                doc, h, n, digest = shingle_sets(data, offsets, k)
                digest = told_apart(digest, second_digest(h, n), doubtful) if len(doubtful) else digest
                _, once = np.unique(digest, return_index=True)
                mine = np.zeros(len(n), dtype=bool)
                mine[once] = True
                keep = mine[doc]
                doc, h = doc[keep], h[keep]
                bucket = ((mix(h) >> U64(24)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                doc, h, bucket = doc[order], h[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(edges)):
                    a, z = edges[b], edges[b + 1]
                    docs, counts = np.unique(doc[a:z], return_counts=True)
                    raw = h[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                    rows.append((int(b), digest[docs].tobytes(), n[docs].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), raw))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *(pa.binary(),) * 4), strict=True)], names=["bucket", "sids", "sizes", "counts", "hashes"])

    return run


_TOLD = "target int, sids binary, sizes binary, counts binary, hashes binary, sets binary"


def _count(targets: int):
    """Which shingles of a bucket stand in two sets or more, and in how many, told by set."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            columns = list(zip(batch.columns[1:], (np.int64, "<u4", "<u4", np.uint8), strict=True))
            for i, b in enumerate(batch.column(0).to_pylist()):
                held.setdefault(b, []).append([np.frombuffer(c[i].as_buffer(), t) for c, t in columns])
        batch = columns = None
        for b in sorted(held):
            rows = held.pop(b)
            sids, sizes, counts = (np.concatenate([r[c] for r in rows]) for c in range(3))
            owner = np.repeat(np.arange(len(sids), dtype=np.uint32), counts)
            wide, at = np.zeros((len(owner), 8), dtype=np.uint8), 0
            for r in rows:
                own = r[3].reshape(-1, 7)
                wide[at : at + len(own), :7] = own
                at += len(own)
            h = wide.view("<u8").ravel()
            rows = wide = own = r = None
            order = np.argsort(h).astype(np.uint32)
            h = h[order]
            same = np.zeros(len(h) + 1, dtype=bool)
            same[1:-1] = h[1:] == h[:-1]
            some = np.flatnonzero(same[1:] | same[:-1])
            h, owner = h[some], owner[order[some]]
            sid, size = sids[owner], sizes[owner]
            same = some = order = owner = None
            # a set that several runs sent counts once
            order = np.lexsort((sid, h))
            h, sid, size = h[order], sid[order], size[order]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
            h, sid, size = h[once], sid[once], size[once]
            _, at, sets = np.unique(h, return_inverse=True, return_counts=True)
            df = sets[at]
            some = df > 1
            h, sid, size, df = h[some], sid[some], size[some], df[some]
            if not len(h):
                continue
            target = (sid.view(U64) % U64(targets)).astype(np.int64)
            order = np.lexsort((sid, target))
            h, sid, size, df, target = h[order], sid[order], size[order], df[order], target[order]
            edges = np.searchsorted(target, np.arange(targets + 1))
            rows = []
            for t in np.flatnonzero(np.diff(edges)):
                a, z = edges[t], edges[t + 1]
                sids, first, n = np.unique(sid[a:z], return_index=True, return_counts=True)
                rows.append((int(t), sids.tobytes(), size[a:z][first].astype("<u4").tobytes(), n.astype("<u4").tobytes(), h[a:z].astype("<u8").tobytes(), np.minimum(df[a:z], 0xFFFFFFFF).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *(pa.binary(),) * 5), strict=True)], names=["target", "sids", "sizes", "counts", "hashes", "sets"])

    return run


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of all binary values of a column, one after another."""
    data, offsets = text_column(column.cast(pa.large_binary()))
    return data[offsets[0] : offsets[-1]].view(kind)


def _survivors(percent: int):
    """Sets that can link: their shared shingles, sorted, and the rarest that make their prefix."""

    def run(told: pa.Table) -> pa.Table:
        kinds = {"sids": np.int64, "sizes": "<u4", "counts": "<u4", "hashes": "<u8", "sets": "<u4"}
        sids, sizes, counts, hashes, sets = (_flat(told[c], t) for c, t in kinds.items())
        one, rank = np.unique(sids, return_inverse=True)
        owner = np.repeat(rank.astype(np.uint32), counts)
        order = np.lexsort((hashes, owner))
        h, df = hashes[order], sets[order]
        n = np.bincount(owner, minlength=len(one))
        first = np.cumsum(n) - n
        size = np.zeros(len(one), dtype=np.int64)
        size[rank] = sizes
        need = least_common(size, percent)
        out = []
        for i in np.flatnonzero(n >= need):
            a, z = first[i], first[i] + n[i]
            keys, total = h[a:z], int(size[i])
            alone = total - len(keys)
            take = total - int(need[i]) + 1 - alone
            rare = np.lexsort((keys, df[a:z]))[:take]
            out.append((int(one[i]), total, keys.tobytes(), keys[rare].tobytes()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["sid", "n", "keys", "prefix"])

    return run


def _prefix(batches):
    for batch in batches:
        keys = [np.frombuffer(p, np.int64) for p in batch.column(1).to_pylist()]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in keys]))], names=["key", "sid"])


class RTree:
    """Count vectors packed into nodes; a node knows the largest count of each group and the least set size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = self._pack(np.arange(len(points)))
        starts = np.arange(0, len(points), LEAF)
        #: from the leaves up: (largest counts, least size) of each node
        self.levels = [(np.maximum.reduceat(points[self.order], starts), np.minimum.reduceat(sizes[self.order], starts))]
        while len(self.levels[-1][1]) > FAN:
            high, low = self.levels[-1]
            starts = np.arange(0, len(low), FAN)
            self.levels.append((np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts)))

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        """Halves by the group of widest spread, at multiples of a leaf, so that near points share leaves."""
        if len(rows) <= LEAF:
            return rows
        own = self.points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        rows = rows[np.lexsort((self.sizes[rows], own[:, axis]))]
        half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
        return np.concatenate((self._pack(rows[:half]), self._pack(rows[half:])))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose bound on the overlap allows a link: (100 + percent) * overlap >= percent * (size + other size)."""
        level = len(self.levels) - 1
        nodes = np.arange(len(self.levels[level][1]))
        while True:
            high, low = self.levels[level]
            bound = np.minimum(high[nodes], point).sum(axis=1)
            nodes = nodes[(100 + percent) * bound >= percent * (size + low[nodes])]
            if level == 0:
                break
            level -= 1
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes = nodes[nodes < len(self.levels[level][1])]
        at = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = self.order[at[at < len(self.order)]]
        bound = np.minimum(self.points[rows], point).sum(axis=1)
        return rows[(100 + percent) * bound >= percent * (size + self.sizes[rows])]


def links(sets: list[np.ndarray], sizes: np.ndarray, asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links from the asked rows that connect what wasn't connected; sets are sorted hashes."""
    lengths = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    group = np.concatenate(sets).astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(58)
    points = np.bincount(np.repeat(np.arange(len(sets)), lengths) * GROUPS + group.astype(np.int64), minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS)
    tree, forest = RTree(points, sizes), Forest(len(sets))
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
    out = []
    for i in asked:
        root = forest.find(int(i))
        near = np.array([j for j in tree.search(points[i], int(sizes[i]), percent).tolist() if forest.find(j) != root], dtype=np.int64)
        if not len(near):
            continue
        mark[ids[starts[i] : starts[i] + lengths[i]]] = 1
        n = lengths[near]
        at = np.repeat(starts[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.add.reduceat(mark[ids[at]], np.cumsum(n) - n)
        mark[ids[starts[i] : starts[i] + lengths[i]]] = 0
        for j in near[(100 + percent) * common >= percent * (sizes[i] + sizes[near])].tolist():
            if forest.join(int(i), j):
                out.append((int(i), j))
    return out


def _join_tiles(percent: int):
    """Links within each tile of a slot; rows asked for are compared with all rows of their tile."""

    def run(rows: pa.Table) -> pa.Table:
        block, tile = rows["block"].to_numpy(), rows["tile"].to_numpy()
        sid, n, asked = rows["sid"].to_numpy(), rows["n"].to_numpy(), rows["asked"].to_numpy()
        keys = rows["keys"]
        # a set that visits its own tile is there once, and asked
        order = np.lexsort((~asked, sid, tile, block))
        edge = np.flatnonzero(np.append(True, (block[order][1:] != block[order][:-1]) | (tile[order][1:] != tile[order][:-1])))
        a_out, b_out = [], []
        for a, z in zip(edge, np.append(edge[1:], len(order)), strict=True):
            own = order[a:z]
            own = own[np.append(True, sid[own][1:] != sid[own][:-1])]
            if len(own) > 1 and asked[own].any():
                sets = [np.frombuffer(keys[int(i)].as_buffer(), "<u8") for i in own]
                for i, j in links(sets, n[own], np.flatnonzero(asked[own]), percent):
                    a_out.append(int(sid[own[i]]))
                    b_out.append(int(sid[own[j]]))
        return pa.table([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _rooted(docs: DataFrame, kept: list[str], k: int, percent: int, chars_per_bucket: int, tile: int) -> DataFrame:
    """The columns kept, n_shingles and root of each row of docs: rows of one root are connected, and a row without shingles has no root."""
    rows = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars, n_rows = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).head()
    buckets = max(8, (chars or 0) // chars_per_bucket + 1)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    members = cut(rows.mapInArrow(_members(k), f"{kinds}, n_shingles long, sid long, second long"))
    # sets that one digest doesn't tell apart: n * n / 2**65 of n sets, none as a rule
    doubtful = members.where("n_shingles > 0").groupBy("sid").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b")
    doubtful = np.array(sorted(r[0] for r in doubtful.select("sid").collect()), dtype=np.int64)
    if len(doubtful):
        members = members.withColumn("sid", F.when(F.col("sid").isin(doubtful.tolist()), F.col("second")).otherwise(F.col("sid")))
    linked = _linked(rows, k, percent, buckets, tile, n_rows, doubtful)
    rooted = members.drop("second").join(linked.select(F.col("node").alias("sid"), F.col("root").alias("found")), "sid", "left")
    return rooted.select(*kept, "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("found", "sid")).alias("root"))


def near_duplicates(docs: DataFrame, *, k: int = K, percent: int = PERCENT, chars_per_bucket: int = CHARS_PER_BUCKET, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs (doc_id, text)."""
    rooted = _rooted(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], k, percent, chars_per_bucket, tile)
    # texts without shingles have no root and link with nothing
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "r")
    found = rooted.join(least, F.col("root") == F.col("r"), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, *, k: int = K, percent: int = PERCENT, chars_per_bucket: int = CHARS_PER_BUCKET, tile: int = TILE) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays of each group of near duplicates: that of least doc_id, null last.

    Rows are told apart by a 128-bit hash of id and text; of rows that repeat both, one stays. Every text without
    shingles is a group of its own, so all such rows that differ stay.
    """
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull()]
    keyed = docs.withColumns({"__h": F.xxhash64(*ids), "__g": F.xxhash64(F.lit("near"), *ids[::-1]), "__id": F.col("doc_id").cast("long")})
    rooted = _rooted(keyed, ["__id", "__h", "__g"], k, percent, chars_per_bucket, tile)
    # of a group the row whose struct is least; rows without a root are groups by themselves
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__h").alias("h"), F.col("__g").alias("g"))
    groups = rooted.groupBy("root", F.when(F.col("root").isNull(), order).alias("alone")).agg(F.min(order).alias("o"))
    repeats = rooted.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("__n"))
    stays = groups.select(F.col("o.h").alias("__h"), F.col("o.g").alias("__g")).distinct().join(repeats, ["__h", "__g"])
    kept = keyed.drop("__id").join(stays, ["__h", "__g"])
    once = kept.where("__n = 1").select(*docs.columns)
    more = kept.where("__n > 1").withColumn("__r", F.row_number().over(Window.partitionBy("__h", "__g").orderBy(*[c for c, t in docs.dtypes if not t.startswith("map")])))
    return once.unionByName(more.where("__r = 1").select(*docs.columns))


def _linked(rows: DataFrame, k: int, percent: int, buckets: int, tile: int, n_rows: int, doubtful: np.ndarray) -> DataFrame:
    """node and root of every set that links with another one."""
    sent = rows.select("text").mapInArrow(_send(k, buckets, doubtful), "bucket int, sids binary, sizes binary, counts binary, hashes binary")
    told = sent.repartition(max(partitions(rows), buckets), "bucket").mapInArrow(_count(buckets), _TOLD)
    sets = cut(told.groupBy("target").applyInArrow(_survivors(percent), "sid long, n long, keys binary, prefix binary"))
    # sets that share a shingle of their prefixes are of one block
    prefix_keys = sets.select("sid", "prefix").mapInArrow(_prefix, "key long, sid long")
    shared = prefix_keys.groupBy("key").agg(F.min("sid").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    star = prefix_keys.join(shared, "key").where("sid <> first").select("first", "sid").distinct()
    blocks = components(star).select(F.col("node").alias("sid"), F.col("root").alias("block"))
    tiles = blocks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    placed = sets.select("sid", "n", "keys").join(blocks, "sid").join(tiles, "block")
    placed = cut(placed.withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int")))
    slots = max(partitions(rows), n_rows // SETS_PER_SLOT + 1)

    def joined(some: DataFrame) -> DataFrame:
        some = some.select("block", "tile", "sid", "n", "keys", "asked").withColumn("slot", F.pmod(F.xxhash64("block", "tile"), F.lit(slots)))
        return some.groupBy("slot").applyInArrow(_join_tiles(percent), "a long, b long")

    large = placed.where("tiles > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pivots = large.groupBy("block", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(PIVOTS)).alias("p")).agg(F.min("sid").alias("sid")).select("sid")
    visiting = large.join(pivots, "sid", "left_semi").withColumn("tile", every)
    found = cut(joined(placed.unionByName(visiting).withColumn("asked", F.lit(True))))
    linked = components(found)
    if not large.isEmpty():
        # what the pivots have left outside a block's largest component visits every tile
        own = large.select("sid", "block").join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        main = own.groupBy("block", "root").count().groupBy("block").agg(F.max(F.struct("count", "root")).alias("m")).select("block", F.col("m.root").alias("main"))
        loose = own.join(main, "block").where("root <> main").select("sid")
        guests = large.join(loose, "sid", "left_semi").withColumn("tile", every).withColumn("asked", F.lit(True))
        more = joined(large.withColumn("asked", F.lit(False)).unionByName(guests))
        linked = components(found.union(more))
    return linked


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n f ON f.doc_id = x JOIN n g ON g.doc_id = y WHERE 100 * o >= 80 * (f.n + g.n - o)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""
