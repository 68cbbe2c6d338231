"""Exact Jaccard join of documents on word shingles: components of linked documents.

Equal sets of shingles make one class, whose representative is the least doc_id. A representative enters the
tiles of its prefix: the shingles that any set close enough must share one of, rarest first. Tiles are banded
by set size. Within a tile, hashed bitmaps (each shingle toggles one bit) bound the overlap from above: sets
that differ in d shingles differ in at most d bits. Tiles carry bitmaps of fixed size; pairs that pass meet bitmaps
that grow with the set. What both bounds let through is verified by intersecting the sorted shingle arrays of
the whole texts.

Links are only needed until components are known. So rounds of hubs come first: each tile's least member is
compared with the others, which is linear in the tile, and verified links are contracted. The last round takes
all pairs of a tile that are still in different components; nothing is left out, and a large group of near
copies has one component by then.

Rarity comes from a sketch of fixed size that counts all shingles; any order would give the same result, the
sketch only keeps frequent passages out of prefixes. Which texts take part in a verification is told by a bit
table of eight bits or more for each of them, so that no whole-corpus exchange of texts is needed; false positives
drop out in the join. The table is broadcast and at most 2^MOST_BITS bits large; beyond that it lets more pass.
A tile of very many members is compared in blocks: its rows are dealt to several tasks, each of which meets all.

Defined results: null, empty and wordless texts have an empty set and are their own component; a text of
fewer words than a shingle is one shingle; repeated rows share a component; a null doc_id never represents a
class, and its component is null where its class has no other id. A doc_id names one text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_path, map_rows, shingles, stored, word_hashes

SKETCH_BITS, LEAST_BITS, MOST_BITS, LONGS, HUB_ROUNDS, HOT_SHARE, BLOCK = 19, 20, 28, 8, 2, 1000, 2048


@dataclass(frozen=True)
class Near:
    """Shingle length and the least similarity, num / den."""

    words: int
    num: int
    den: int

    def prefix(self, n: int) -> int:
        """Shingles of which a close enough set shares at least one; 0 where only equal sets are close."""
        least, most = -(-n * self.num // self.den), n * self.den // self.num
        return 0 if least == n == most else n - least + 1

    def band(self, n: int) -> int:
        """Sets close enough are in the same or a neighbouring band."""
        return int(math.log(n) / (math.log(self.den / self.num) * 1.000001))

    def close(self, overlap: str, a: str, b: str) -> str:
        """SQL: this overlap of sets of sizes a and b is enough."""
        return f"{self.den} * ({overlap}) >= {self.num} * ({a} + {b} - ({overlap}))"


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z count as a-z."""
    found = (text or "").encode().lower().split()
    return np.unique(shingles(word_hashes()(found), words)) if found else np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the set's members in each of 64 * LONGS bits."""
    bits = np.bincount((s & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def wide_bitmap(s: np.ndarray) -> bytes:
    """The same with two bits or more for each member, a power of two of them, so that large sets don't fill it."""
    size = max(64 * LONGS, 1 << (2 * max(1, len(s)) - 1).bit_length())
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two wide bitmaps differ; the longer is folded, as parities add up."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How many sets hold a shingle of each hash prefix, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    rows = docs.select("text").mapInArrow(count, "counts binary").rdd
    zero = np.zeros(1 << SKETCH_BITS, np.float32)
    return rows.map(lambda r: np.frombuffer(r.counts, "<i4").astype(np.float32)).treeAggregate(zero, np.add, np.add, 3)


def measured(docs: DataFrame, near: Near, order: np.ndarray) -> DataFrame:
    """doc_id, n, a 128-bit id of the set, its bitmap and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def start():
        import xxhash

        rank = shared.value

        def row(doc_id, text):
            s = shingle_set(text, near.words)
            k = near.prefix(len(s)) if len(s) else 0
            if k:
                first = np.lexsort((s, rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:k]
                prefix = s[first].view(np.int64).tolist()
            else:
                prefix = []
            return doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), bitmap(s).tolist() if k else None, wide_bitmap(s) if k else None, prefix, near.band(len(s)) if k else None

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n long, set_id binary, bits array<long>, wide binary, prefix array<long>, band int", start)


def needed(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table over hashed ids, and the logarithm of its size."""
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * ids.count()).bit_length()))
    place = ids.select(F.col("id").bitwiseAND((1 << bits) - 1).alias("h"))
    rows = place.groupBy(F.expr("bitmap_bucket_number(h)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).collect()
    table = np.zeros((1 << bits) // 8 + 8192, np.uint8)
    for r in rows:  # bucket 0 holds place 0, bucket k the 32768 places from (k - 1) * 32768 + 1 on
        table[4096 * r.k : 4096 * (r.k + 1)] |= np.frombuffer(bytes(r.bits), np.uint8)
    return table, bits


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows that may be among the ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(needed(ids.select(F.expr("xxhash64(id)").alias("id"))))
    bounded_batches(spark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << bits) - 1)
            bucket, bit = np.where(x == 0, 0, 1 + (x - 1) // 32768), np.where(x == 0, 0, (x - 1) % 32768)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["doc_id", "text"]).filter(pa.array((table[4096 * bucket + bit // 8] >> (bit % 8)) & 1 == 1))

    return docs.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "doc_id", "text").mapInArrow(keep, "doc_id long, text string")


def narrowed(pairs: DataFrame, own: DataFrame, near: Near) -> DataFrame:
    """The pairs whose wide bitmaps let enough overlap through."""
    side = lambda x: own.selectExpr(f"doc_id AS {x}", f"n AS n{x}", f"wide AS w{x}")
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def start():
        def row(a, b, na, nb, wa, wb):
            most = (na + nb - differing(wa, wb)) // 2
            return a, b, near.den * most >= near.num * (na + nb - most)

        return row

    return map_rows(both, ["a", "b", "na", "nb", "wa", "wb"], "a long, b long, ok boolean", start).where("ok").select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose whole texts are close enough."""
    ids = pairs.selectExpr("explode(array(a, b)) AS id").distinct()
    texts = texts_of(docs, ids)
    both = pairs.join(texts.selectExpr("doc_id AS b", "text AS tb"), "b").join(texts.selectExpr("doc_id AS a", "text AS ta"), "a")

    def start():
        last: list = [None, None]

        def row(a, b, ta, tb):
            if last[0] != ta:
                last[:] = ta, shingle_set(ta, near.words)
            x, y = last[1], shingle_set(tb, near.words)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return a, b, near.den * both >= near.num * (len(x) + len(y) - both) and both > 0

        return row

    return map_rows(both, ["a", "b", "ta", "tb"], "a long, b long, ok boolean", start).where("ok").select("a", "b").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, str | None]:
    """(v, comp) for each end of an edge: the least id that is reachable. Labels spread and jump until none changes."""
    both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    labels, path = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).selectExpr("v", "least(v, m) AS comp"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.selectExpr("v AS b", "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        spread = labels.join(near, "v").selectExpr("v", "comp AS was", "least(comp, m) AS comp")
        jumped = spread.alias("x").join(spread.selectExpr("v AS w", "comp AS root").alias("y"), F.col("x.comp") == F.col("y.w")).selectExpr("v", "was", "root AS comp")
        after, new = stored(jumped, "labels")
        drop_path(edges.sparkSession, path)
        labels, path = after.select("v", "comp"), new
        if after.where("was != comp").isEmpty():
            return labels, path
    raise RuntimeError("labels did not settle")


def linked(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, _ = stored(measured(docs, near, frequencies(docs, near.words)), "sets")
    reps = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"))
    members, own, paths = _members(spark, sets, reps)
    final = None
    for k in range(HUB_ROUNDS + 1):
        pairs = _hub_pairs(members, own, near, ("lo", "hi")[k % 2]) if k < HUB_ROUNDS else _cross_pairs(members, own, near)
        pairs, path = stored(narrowed(pairs, own, near), "pairs")
        paths.append(path)
        if pairs.isEmpty():
            if k < HUB_ROUNDS:
                continue
            break
        links, path = stored(verified(docs, pairs, near), "links")
        paths.append(path)
        if links.isEmpty():
            continue
        of = members.select("rep", "comp").distinct()
        edges = links.join(of.selectExpr("rep AS a", "comp AS ca"), "a").join(of.selectExpr("rep AS b", "comp AS cb"), "b").where("ca != cb").selectExpr("ca AS a", "cb AS b").distinct()
        edges, path = stored(edges, "edges")
        paths.append(path)
        if edges.isEmpty():
            continue
        labels, path = components(edges)
        paths.append(path)
        moved = members.join(labels.selectExpr("v AS comp", "comp AS to"), "comp", "left")
        members, path = stored(moved.select("key", "band", "rep", F.coalesce("to", "comp").alias("comp")), "members")
        paths.append(path)
        final = members.where("comp != rep").select("rep", "comp").distinct()
    out = _classed(sets, reps if final is None else reps.join(final, "rep", "left"))
    for path in paths:
        drop_path(spark, path)
    return out.unionByName(sets.where("n = 0").selectExpr("doc_id", "n AS n_shingles", "doc_id AS component_id"))


def _classed(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """Documents with words and their component.

    Only classes of several documents, or linked to others, need a lookup. Of classes that hold more than one
    HOT_SHARE-th of all documents there are fewer than HOT_SHARE: these are broadcast, the others joined by set.
    """
    comp = F.coalesce("comp", "rep") if "comp" in reps.columns else F.col("rep")
    own = "c > 1 OR comp IS NOT NULL" if "comp" in reps.columns else "c > 1"
    classes, _ = stored(reps.where(own).select("set_id", "c", comp.alias("to")), "classes")
    many = max(1, sets.count() // HOT_SHARE)
    hot, cold = F.broadcast(classes.where(f"c > {many}").drop("c")), classes.where(f"c <= {many}").drop("c")
    rows = sets.where("n > 0").select("doc_id", "n", "set_id")
    found = rows.join(hot, "set_id").unionByName(rows.join(hot, "set_id", "left_anti").join(cold, "set_id", "left"), allowMissingColumns=True)
    return found.selectExpr("doc_id", "n AS n_shingles", "coalesce(to, doc_id) AS component_id")


def _members(spark: SparkSession, sets: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of tiles with two or more members (key, band of the tile, representative and its component), and the representatives.

    Sizes and bitmaps stay with the representatives until a round compares them, as a set is in many tiles.
    """
    own = sets.where("size(prefix) > 0").join(reps.selectExpr("rep AS doc_id", "set_id AS s"), "doc_id").where("s = set_id")
    own = own.groupBy("doc_id").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("wide").alias("wide"), F.any_value("prefix").alias("prefix"), F.any_value("band").alias("band"))
    own, path = stored(own, "own")
    entries = own.selectExpr("doc_id AS rep", "band AS own", "explode(prefix) AS key")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    kept, kept_path = stored(entries.join(shared, "key"), "entries")
    banded = kept.selectExpr("key", "explode(array(own, own + 1)) AS band", "rep", "rep AS comp")
    alive = banded.groupBy("key", "band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "band")
    members, members_path = stored(banded.join(alive, ["key", "band"]), "members")
    drop_path(spark, kept_path)
    return members, own, [members_path, path]


def _bound(near: Near) -> str:
    """SQL: the bitmaps of x and y let enough overlap through."""
    differ = " + ".join(f"bit_count(x.bits[{k}] ^ y.bits[{k}])" for k in range(LONGS))
    return near.close(f"(x.n + y.n - ({differ})) div 2", "x.n", "y.n")


def _active(members: DataFrame) -> DataFrame:
    """Tiles that hold two or more components, with the ends of the order of (component, representative) and the number of blocks."""
    pair = F.struct("comp", "rep")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    return members.groupBy("key", "band").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"), blocks).where("lo.comp < hi.comp")


def _hub_pairs(members: DataFrame, own: DataFrame, near: Near, end: str) -> DataFrame:
    """For each member one hub of another component: that of the most tiles. A tile's hub is the first or last of its order."""
    hubs = _active(members).selectExpr("key", "band", f"{end}.comp AS hub_comp", f"{end}.rep AS hub")
    found = members.join(hubs, ["key", "band"]).where("comp != hub_comp").groupBy("hub", "rep").agg(F.count(F.lit(1)).alias("c"))
    both = found.join(own.selectExpr("doc_id AS hub", "n AS hn", "bits AS hbits"), "hub").join(own.selectExpr("doc_id AS rep", "n", "bits"), "rep")
    both = both.selectExpr("struct(hn AS n, hbits AS bits) AS x", "struct(n, bits) AS y", "hub", "rep", "c").where(_bound(near))
    best = both.groupBy("rep").agg(F.max_by("hub", F.struct("c", (-F.col("hub")).alias("h"))).alias("hub"))
    return best.selectExpr("hub AS a", "rep AS b")


def _cross_pairs(members: DataFrame, own: DataFrame, near: Near) -> DataFrame:
    """All pairs of a tile in different components that the bound lets through. Each row of a tile is in one block and meets all other rows there."""
    alive = _active(members).select("key", "band", "blocks")
    rows = members.join(alive, ["key", "band"]).join(own.selectExpr("doc_id AS rep", "n", "bits"), "rep")
    x = rows.withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) AS int)")).alias("x")
    y = rows.withColumn("block", F.expr("explode(sequence(0, blocks - 1))")).alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "band", "block")] + [F.col("x.rep") < F.col("y.rep"), F.col("x.comp") != F.col("y.comp"), F.expr(_bound(near))]
    return x.join(y, on).selectExpr("x.rep AS a", "y.rep AS b").distinct()
