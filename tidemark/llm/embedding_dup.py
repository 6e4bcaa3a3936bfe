"""Embedding near-duplicates: a navigable small-world graph per shard, queried by every vector of its label.

Equal vectors of a label form one class. The classes of a label are dealt at random to shards of about
SHARD; a shard's graph (layers, neighbour lists chosen for diversity) is built in one task and written
out. Every class queries every shard of its label: the task of (shard, block of queries) searches with
a beam, doubles it for queries whose whole beam lies above the threshold, and audits a share of the
queries against a scan of the shard; when queries whose links fit the beam find less than AUDIT of them on
average, the block is searched again with twice the beam, at last with one as wide as the shard. Blocks hold
QUERY_SHARDS shards' vectors, so a graph is sent once for each of these. Links are confirmed by
cosine in double precision. A task returns for each query the number of vectors linked and, for the
links it saw, a spanning forest - never the pairs - whose union over tasks gives the components.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing; vectors of unlike length never link; rows that repeat a vec_id
count once (the smallest label and vector stand); null vec_ids are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

COSINE = 0.93
SHARD, QUERY_SHARDS = 8192, 4
DEGREE, DEGREE_0, BUILD_BEAM = 12, 24, 48
BEAM, WIDEST = 48, 192
AUDIT, AUDIT_EVERY = 0.999, 64
CHUNK = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # or squares overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``ef`` nodes found for each query and their similarities, descending (-1 and -inf where fewer)."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, ef), -1, np.int32)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.zeros((n, ef), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], sims[:, 0] = entry, np.einsum("nd,nd->n", x[entry], q)
    seen[rows, entry] = True
    active = rows
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        j = open_sims.argmax(1)
        going = open_sims[np.arange(len(active)), j] > -np.inf
        active, j = active[going], j[going]
        if not len(active):
            break
        cur = ids[active, j]
        done[active, j] = True
        nb = links[cur]
        ok = nb >= 0
        nb = np.where(ok, nb, 0)
        ok &= ~seen[active[:, None], nb]
        seen[np.repeat(active, ok.sum(1)), nb[ok]] = True
        s = np.where(ok, np.matmul(x[nb], q[active][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        if not ok.any():
            continue
        all_s = np.concatenate([sims[active], s], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
        sims[active] = np.take_along_axis(all_s, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(ok, nb, -1)], 1), top, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~ok], 1), top, 1)
    return ids, sims


def choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of each row's candidates: those nearer to the row than to any chosen one, then the nearest of the others."""
    out = np.full((len(cand), degree), -1, np.int32)
    for k in range(0, len(cand), CHUNK):
        c, s = cand[k : k + CHUNK], sims[k : k + CHUNK]
        order = np.argsort(-s, axis=1, kind="stable")
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        valid = (c >= 0) & (s > -np.inf)
        v = x[np.where(valid, c, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(c.shape, bool)
        for i in range(c.shape[1]):
            near = (np.where(kept, between[:, i], -np.inf) >= s[:, i, None]).any(1)
            kept[:, i] = valid[:, i] & ~near & (kept.sum(1) < degree)
        rank = np.where(kept, 0, np.where(valid, 1, 2))
        best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        got = np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(c, best, 1), -1)
        out[k : k + CHUNK, : got.shape[1]] = got
    return out


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all, each higher one a random share."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x = np.ascontiguousarray(x, np.float32)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(DEGREE)).astype(int)
        order = rng.permutation(len(x))
        self.layers: list[np.ndarray] = []  # top first
        self.top = order[:0]
        for l in range(level.max(initial=0), -1, -1):
            nodes = order[level[order] >= l]
            upper = order[level[order] >= l + 1]
            if l and len(nodes) <= 4 * DEGREE:
                self.top = nodes
                continue
            if not len(self.top):
                self.top = nodes[: 4 * DEGREE]
            self._add_layer(nodes, upper, DEGREE if l else DEGREE_0)

    def entries(self, q: np.ndarray) -> np.ndarray:
        at = self.top[(q @ self.x[self.top].T).argmax(1)]
        for links in self.layers:
            at = beam_search(self.x, links, q, at, 4)[0][:, 0]
        return at

    def _add_layer(self, nodes: np.ndarray, upper: np.ndarray, degree: int) -> None:
        x = self.x
        links = np.full((len(x), degree), -1, np.int32)
        first = upper if len(upper) else self.top
        rest = nodes[~np.isin(nodes, first)]
        nodes = np.concatenate([first, rest])
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + int(np.clip(done // 2, 2 * degree, CHUNK))]
            q = x[batch]
            inside = q @ q.T
            np.fill_diagonal(inside, -np.inf)
            near = np.argsort(-inside, axis=1)[:, :degree]
            cand, sims = batch[near], np.take_along_axis(inside, near, 1)
            if done:
                # The first nodes of a layer are those of the layer above, where the search starts.
                entry = self.entries(q) if done >= len(first) else nodes[(q @ x[nodes[:done]].T).argmax(1)]
                ids, s = beam_search(x, links, q, entry, BUILD_BEAM)
                cand, sims = np.concatenate([ids, cand], 1), np.concatenate([s, sims], 1)
            links[batch] = choose(x, cand, sims, degree)
            # Links back, chosen anew where a node has too many.
            src, dst = np.repeat(batch, degree), links[batch].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            to, at, n = np.unique(dst, return_index=True, return_counts=True)
            width = min(int(n.max(initial=0)), 4 * degree)
            col = np.arange(len(dst)) - np.repeat(at, n)
            keep = col < width
            more = np.full((len(to), width), -1, np.int32)
            more[np.repeat(np.arange(len(to)), n)[keep], col[keep]] = src[keep]
            both = np.concatenate([links[to], more], 1)
            both_s = np.where(both >= 0, np.matmul(x[np.where(both >= 0, both, 0)], x[to][:, :, None])[:, :, 0], -np.inf)
            dup = both[:, degree:, None] == both[:, None, :degree]
            both_s[:, degree:][dup.any(2)] = -np.inf
            links[to] = choose(x, np.where(both_s > -np.inf, both, -1), both_s, degree)
            done += len(batch)
        self.layers.append(links)

    def near(self, q: np.ndarray, q64: np.ndarray, x64: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of cosine >= COSINE that a search with this beam finds."""
        todo = np.arange(len(q))
        qs, ns = [], []
        entry = self.entries(q) if beam < len(self.x) else None
        while len(todo):
            if beam >= min(len(self.x), WIDEST + 1):
                a, b = np.nonzero(q64[todo] @ x64.T >= COSINE)
                qs.append(todo[a])
                ns.append(b)
                break
            ids, sims = beam_search(self.x, self.layers[-1], q[todo], entry[todo], beam)
            full = sims[:, -1] >= COSINE - 1e-3
            a, col = np.nonzero((sims >= COSINE - 1e-3) & ~full[:, None])
            a, b = todo[a], ids[a, col]
            ok = np.einsum("nd,nd->n", q64[a], x64[b]) >= COSINE
            qs.append(a[ok])
            ns.append(b[ok])
            todo, beam = todo[full], beam * 2
        return (np.concatenate(qs), np.concatenate(ns)) if qs else (todo, todo)


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    import pickle

    pdf = pdf.sort_values("rep", ignore_index=True)
    x = unit(_stack(pdf["embedding"]))
    g = Graph(x)
    blob = pickle.dumps((pdf["rep"].to_numpy(), pdf["n"].to_numpy(), x, g), protocol=5)
    return pd.DataFrame({"label": [pdf["label"][0]], "dim": [pdf["dim"][0]], "shard": [pdf["shard"][0]], "blocks": [pdf["blocks"][0]], "graph": [blob]})


def _query(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    import pickle

    out = {"rep": [], "n_links": [], "root": []}
    if len(left) and len(right):
        reps, sizes, x, g = pickle.loads(left["graph"][0])
        right = right.sort_values("rep", ignore_index=True)
        own = right["rep"].to_numpy()
        q64 = unit(_stack(right["embedding"]))
        q = q64.astype(np.float32)
        audit = np.arange(0, len(q), AUDIT_EVERY)
        parts = [audit[k : k + CHUNK] for k in range(0, len(audit), CHUNK)]
        links = lambda a, b, p: np.bincount(a[own[p][a] != reps[b]], minlength=len(p))
        truth = np.concatenate([links(*np.nonzero(q64[p] @ x.T >= COSINE), p) for p in parts])
        beam = BEAM
        while beam <= WIDEST:
            # Queries with more links than the beam holds are scanned anyway, so they prove nothing.
            fair = (truth > 0) & (truth < beam)
            if not fair.any():
                break
            got = np.concatenate([links(*g.near(q[p], q64[p], x, beam), p) for p in parts])
            if (got[fair] / truth[fair]).mean() >= AUDIT:
                break
            beam *= 2
        beam = beam if beam <= WIDEST else len(x)
        vertex = np.unique(np.concatenate([reps, own]))
        vi, vq = np.searchsorted(vertex, reps), np.searchsorted(vertex, own)
        label, count = np.arange(len(vertex)), np.zeros(len(own), np.int64)
        for k in range(0, len(q), CHUNK):
            a, b = g.near(q[k : k + CHUNK], q64[k : k + CHUNK], x, beam)
            a, b = a + k, b
            other = own[a] != reps[b]
            a, b = a[other], b[other]
            count += np.bincount(a, sizes[b], len(own)).astype(np.int64)
            _join(label, vq[a], vi[b])
        changed = np.flatnonzero(label != np.arange(len(vertex)))
        out["rep"] = np.concatenate([own, vertex[changed]])
        out["n_links"] = np.concatenate([count, np.zeros(len(changed), np.int64)])
        out["root"] = np.concatenate([own, vertex[label[changed]]])
    return pd.DataFrame(out, columns=["rep", "n_links", "root"]).astype("int64")


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Label every vertex with the smallest of its component, given more links; in place."""
    while len(a):
        la, lb = label[a], label[b]
        unlike = la != lb
        if not unlike.any():
            return
        a, b, la, lb = a[unlike], b[unlike], la[unlike], lb[unlike]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label[:] = jump


def near_duplicates(vectors: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """``vectors``: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    one = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    one = scratch.put(one, "vectors")
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = one.where(F.col("label").isNotNull() & F.coalesce(fit, F.lit(False))).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0).cast("float")))  # -0.0 is 0.0
    classes = scratch.put(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    sized = classes.withColumn("dim", F.size("embedding"))
    shards = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_size).alias("shards"), F.ceil(F.count("*") / (QUERY_SHARDS * shard_size)).alias("blocks"))
    sized = sized.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")))
    sized = scratch.put(sized.select(F.col("label").cast("string").alias("label"), "dim", "shards", "blocks", "shard", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).alias("block"), "rep", "n", "embedding"), "sharded")
    graphs = sized.groupBy("label", "dim", "shard").applyInPandas(_build, "label string, dim int, shard long, blocks long, graph binary")
    graphs = scratch.put(graphs, "graphs")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = graphs.select("label", "dim", "shard", every("blocks").alias("block"), "graph")
    right = sized.select("label", "dim", every("shards").alias("shard"), "block", "rep", "embedding")
    key = ["label", "dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_query, "rep long, n_links long, root long")
    found = scratch.put(found, "found")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    per = found.groupBy("rep").agg(F.sum("n_links").alias("found")).join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    per = classes.select("rep", "n", "label", "embedding").join(per, "rep", "left").select("label", "embedding", "rep", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    members = good.join(per, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = one.select("vec_id").join(members, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
