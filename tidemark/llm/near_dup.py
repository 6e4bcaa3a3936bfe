"""MinHash near-duplicates with tensored banding.

Each document keeps COLLECTIONS small collections of ROWS minhashes. A table key joins two
collections, so 20 collections of 3 (60 minhashes) give 190 tables of 6 rows, for which plain banding
would compute 1,140 minhashes. A pair of similarity 0.75 meets in some table unless fewer than two of
its 20 collections agree, which happens for about 3 pairs in 10,000, and less the closer they are.

Steps, each distributed:
1. one pass turns texts into set identity, set size and minhashes; equal sets become one class;
2. class representatives are dealt to table keys, buckets of one are dropped;
3. every member is compared with its bucket's leader (first in one fixed random order), a number of
   pairs linear in the members; minhashes discard pairs that can't reach the threshold, the rest are
   confirmed on full shingle sets; components are taken;
4. in buckets that still hold several components each block of members is compared with its most
   central one (an original, rather than one of its copies); confirmed links join components;
5. in buckets that still hold several components all blocks are compared pair by pair, only across
   components, by sketches of 1,024 bytes, each pair in the first table where it meets; survivors are
   confirmed on full sets, and components are taken again.
No bucket is capped and no group's pairs are listed: links inside a component already known are not
looked for.

Defined results: null or wordless text gives n_shingles 0, its own component, kept true. Fewer than
five words make one shingle. Rows that repeat a doc_id count once (the smallest text wins). A null
doc_id is dropped. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, runs, shingle_set

COLLECTIONS, ROWS = 20, 3
HASHES = COLLECTIONS * ROWS
NUM, DEN = 75, 100
#: At similarity 0.75 the 60 minhashes agree 45 times on average, deviation 3.4; fewer than 30 is 4.5 deviations away.
LEAST_AGREE = 30
#: Only a first guess at what to link: the last step misses nothing for it.
CENTRAL_AGREE = 42
#: At similarity 0.75 the 1,024 bytes agree 769 times on average, deviation 14; fewer than 706 is 4.5 deviations away.
WIDE, WIDE_AGREE = 1024, 706
CENTRAL_BLOCK, BLOCK = 256, 1024
PARTNERS, SKETCHES_A_TASK = 64, 4_096

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_W = np.random.default_rng(8).integers(1, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _RNG.integers(1, 2**63, (COLLECTIONS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_I, _J = np.triu_indices(COLLECTIONS, 1)
_TABLE = _RNG.integers(1, 2**63, len(_I), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(x: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(x), 4096):
        out = np.minimum(out, ((x[None, k : k + 4096] * _A[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def table_keys(mh: np.ndarray) -> np.ndarray:
    """190 keys a document from its 20 collections; mh: documents x 60."""
    m = mh.astype(np.uint64).reshape(len(mh), COLLECTIONS, ROWS)
    half = (m * _KEY[None, :, :ROWS]).sum(2, dtype=np.uint64)
    half ^= half >> np.uint64(31)
    half *= _KEY[None, :, ROWS]
    key = (half[:, _I] ^ (half[:, _J] * np.uint64(0xD6E8FEB86659FD93))) + _TABLE[None, :]
    key ^= key >> np.uint64(32)
    return (key * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def first_key(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Key of the first table in which a document meets each of the others (any value where they meet in none)."""
    same = (others == one).reshape(len(others), COLLECTIONS, ROWS).all(2)
    c1 = same.argmax(1)
    same[np.arange(len(same)), c1] = False
    c2 = np.maximum(same.argmax(1), c1 + 1) % COLLECTIONS
    table = np.full((COLLECTIONS, COLLECTIONS), -1)
    table[_I, _J] = np.arange(len(_I))
    return table_keys(one[None, :])[0][table[c1, c2]]


def wide_sketch(x: np.ndarray) -> bytes:
    """Low bytes of WIDE further minhashes: only documents that share a bucket get one."""
    out = np.full(WIDE, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(x), 1024):
        out = np.minimum(out, ((x[None, k : k + 1024] * _W[:, None]) >> np.uint64(32)).min(1))
    return (out & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _sign(batches):
    pa.default_memory_pool().release_unused()  # what the worker's earlier tasks held
    for b in batches:
        ids, n, s1, s2, mh = [], [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = shingle_set(t)
            d = xxhash.xxh3_128_intdigest(x.tobytes()) if len(x) else 0
            ids.append(i)
            n.append(len(x))
            s1.append((d >> 65) & 0x7FFFFFFFFFFFFFFF)
            s2.append(d & 0x7FFFFFFFFFFFFFFF)
            mh.append(minhashes(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(mh, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "mh"])


def _keys(batches):
    for b in batches:
        for k in range(0, b.num_rows, 500):
            c = b.slice(k, 500)
            mh = np.frombuffer(b"".join(c.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = table_keys(mh)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["rep", "key"])


def _sets(batches):
    for b in batches:
        out = [shingle_set(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in out], pa.binary()), pa.array([wide_sketch(x) for x in out], pa.binary())], ["rep", "set", "wide"])


def _agree(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
        keep = pa.array((x == y).sum(1) >= LEAST_AGREE)
        yield b.select([0, 1]).filter(keep)


def _confirm(batches):
    """Rows of one (a, block) follow each other, the row with a's own set (b null) first."""
    at, own = None, None
    for batch in batches:
        va, vb = [], []
        for a, block, b, s in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(s, np.uint64)
            if b is None:
                at, own = (a, block), x
            else:
                assert at == (a, block), "a pair came without the set of its first document"
                both = len(np.intersect1d(own, x, assume_unique=True))
                if DEN * both >= NUM * (len(own) + len(x) - both):
                    va.append(a)
                    vb.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(va, pa.int64()), pa.array(vb, pa.int64())], ["a", "b"])


def _central(batches):
    """The most central member of each block of a bucket, by its minhashes, paired with the members of other components near it."""
    for t, starts, ends in runs(batches, ["key", "block"]):
        x = np.frombuffer(b"".join(t.column("mh").to_pylist()), np.uint32).reshape(-1, HASHES)
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        oa, ob, near = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(starts.tolist(), ends.tolist()):
            own = x[s:e]
            m = s + int(np.argmax([(own == v).sum() for v in own])) if e - s > 2 else s
            j = np.arange(s, e)[(comp[s:e] != comp[m]) & ((own == x[m]).sum(1) >= CENTRAL_AGREE)]
            oa.append(np.full(len(j), rep[m]))
            ob.append(rep[j])
            near.append((own[j - s] == x[m]).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(oa)), pa.array(np.concatenate(ob)), pa.array(np.concatenate(near))], ["a", "b", "agree"])


def _across(batches):
    """Members of a block pair of one bucket, the first block's with side 0 and the second's with side 1: pairs of unlike components whose sketches agree, each in the first table where it meets."""
    for t, starts, ends in runs(batches, ["key", "i", "j"]):
        x = np.frombuffer(b"".join(t.column("mh").to_pylist()), np.uint32).reshape(-1, HASHES)
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint8).reshape(-1, WIDE)
        key, side, rep, comp = (t.column(c).to_numpy() for c in ("key", "side", "rep", "comp"))
        oa, ob = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(starts.tolist(), ends.tolist()):
            cut = s + int((side[s:e] == 0).sum())  # sorted by side
            inside = cut == e
            for i in range(s, cut):
                j = np.arange(i + 1 if inside else cut, e)
                j = j[comp[j] != comp[i]]
                j = j[(wide[j] == wide[i]).sum(1) >= WIDE_AGREE] if len(j) else j
                if len(j):
                    j = j[first_key(x[i], x[j]) == key[i]]
                    oa.append(np.minimum(rep[i], rep[j]))
                    ob.append(np.maximum(rep[i], rep[j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(oa)), pa.array(np.concatenate(ob))], ["a", "b"])


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, scratch: Scratch, sketched: bool) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, written. The set of a is sent once for each PARTNERS of its pairs, that of b once a pair."""
    if not sketched:
        pairs = (
            pairs.join(sketches.select(F.col("rep").alias("a"), F.col("mh").alias("ma")), "a")
            .join(sketches.select(F.col("rep").alias("b"), F.col("mh").alias("mb")), "b")
            .select("a", "b", "ma", "mb")
            .mapInArrow(_agree, "a long, b long")
        )
    pairs = scratch.put(pairs.select("a", "b"), "pairs")
    partners = scratch.put(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks")), "partners")
    dealt = scratch.put(pairs.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "dealt")
    scratch.drop(pairs, partners)
    own = dealt.select("a", "block").distinct().join(sets.select(F.col("rep").alias("a"), "set"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "set")
    other = dealt.join(sets.select(F.col("rep").alias("b"), "set"), "b").select("a", "block", "b", "set")
    rows = own.union(other).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    confirmed = scratch.put(rows.mapInArrow(_confirm, "a long, b long"), "links")
    scratch.drop(dealt)
    return confirmed


def _mixed(met: DataFrame, comp: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Bucket members with their components; the keys of buckets with several, and their number of blocks."""
    placed = met.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    return placed, mixed.select("key", F.ceil(F.col("n") / block).alias("blocks"))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """key, rep, comp, block, other: each member of a bucket once for every block of the bucket that it is to be compared with.

    A component of more members than a block takes blocks of its own, which are not compared with each other; all other members
    share the first blocks. So a bucket that is nearly one component costs its members times the few blocks of the rest.
    """
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") > block, F.col("comp"))
    parts = sizes.groupBy("key", own.alias("own")).agg(F.ceil(F.sum("n") / block).alias("parts"))
    # One row for each large component of a bucket, and one for the rest, is what these windows see.
    before = Window.partitionBy("key").orderBy(F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "own", "parts", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("first"), F.sum("parts").over(Window.partitionBy("key")).alias("total"))
    large = parts.where("own is not null").withColumnRenamed("own", "comp")
    rest = parts.groupBy("key").agg(F.max("total").alias("total"), F.max(F.when(F.col("own").isNull(), F.col("parts"))).alias("shared"))
    found = members.join(large.select("key", "comp", "parts", "first"), ["key", "comp"], "left").join(rest, "key")
    at = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("rep"), F.coalesce("parts", "shared"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda x: F.col("parts").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("parts")))
    return found.select("key", "rep", "comp", at.alias("block"), F.explode(others).alias("other"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (it is that id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = one_row_an_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null"), "doc_id", "text", scratch)
    signed = scratch.put(src.mapInArrow(_sign, "doc_id long, n_shingles long, s1 long, s2 long, mh binary"), "signed")
    one = signed.select("doc_id", "n_shingles", "s1", "s2")
    rep = one.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    rep = scratch.put(rep, "rep")
    sketches = scratch.put(signed.join(rep.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), "mh"), "sketches")
    # A sketch is small and becomes 190 rows: tasks get so many that their partial aggregates stay small.
    tasks = max(1, -(-sketches.count() // SKETCHES_A_TASK))
    keys = sketches.repartition(tasks, "rep").mapInArrow(_keys, "rep long, key long")
    # A bucket's count and leader are partial aggregates; the join back can be split where one bucket is large.
    buckets = scratch.put(keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("rep")).alias("lead")).where("n > 1").select("key", "lead"), "buckets")
    met = scratch.put(keys.join(buckets, "key").select("key", "rep", "lead"), "met")
    scratch.drop(buckets)
    leads = met.where(F.xxhash64("rep") == F.col("lead")).select(F.col("rep").alias("a"), "lead").distinct()
    involved = met.select("rep").distinct()
    sets = scratch.put(src.join(involved.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text").mapInArrow(_sets, "rep long, set binary, wide binary"), "sets")
    stars = met.select("lead", F.col("rep").alias("b")).distinct().join(leads, "lead").where("a <> b").select("a", "b")
    links = _verified(stars, sketches, sets, scratch, False)
    comp = scratch.put(components(links, scratch), "comp")
    scratch.drop(links)
    # Buckets that hold several components: first their most central members, which link most of what is near them.
    star = F.col("id").alias("a"), F.col("root").alias("b")
    placed, mixed = _mixed(met, comp, CENTRAL_BLOCK)
    members = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks"))).join(sketches, "rep").select("key", "block", "rep", "comp", "mh")
    pairs = members.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_central, "a long, b long, agree long")
    # Of the central members that a document met, the two it resembles most.
    best = F.slice(F.sort_array(F.collect_set(F.struct("agree", "a")), False), 1, 2)
    pairs = pairs.groupBy("b").agg(best.alias("x")).select(F.explode("x.a").alias("a"), "b")
    more = _verified(pairs, sketches, sets, scratch, True)
    # A component is a star now, so its members and the new links are the whole graph.
    before, comp = comp, scratch.put(components(comp.select(*star).union(more), scratch), "comp")
    scratch.drop(before, more)
    # What is left: every pair across components, block by block.
    placed, mixed = _mixed(met, comp, BLOCK)
    members = (
        _blocks(placed.join(mixed.select("key"), "key"), BLOCK)
        .select("key", "rep", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
        .join(sketches, "rep")
        .join(sets.select("rep", "wide"), "rep")
    )
    pairs = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(_across, "a long, b long").distinct()
    more = _verified(pairs, sketches, sets, scratch, True)
    before, comp = comp, scratch.put(components(comp.select(*star).union(more), scratch), "comp")
    scratch.drop(before, more, met, sets, sketches)
    out = (
        one.join(rep, ["n_shingles", "s1", "s2"], "left")
        .join(comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
    )
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_row_an_id(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Of the rows that repeat an id the one with the smallest text stays (of those, the one with the smallest other
    columns); all other rows, and those without an id, as they are. Only rows of repeated ids are shuffled with their texts."""
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    again = scratch.put(again, "again")
    if again.isEmpty():
        return docs
    same = F.col(id_col) == F.col("__id")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    kinds = dict(docs.dtypes)
    # Columns that have no order are compared as text.
    order = F.struct(F.col(text_col), *[F.col(f"`{c}`").cast("string") if "map<" in kinds[c] or "variant" in kinds[c] else F.col(f"`{c}`") for c in rest])
    picked = docs.join(again, same, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("__row"))
    return docs.join(again, same, "left_anti").unionByName(picked.select("__row.*"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One input row for each document that stays; rows without an id stay too."""
    found = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone"))
    docs = one_row_an_id(docs, id_col, text_col, Scratch(docs.sparkSession))
    return docs.join(found, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
