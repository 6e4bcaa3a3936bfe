"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end per text. A token's context is the whole word before it (the
end, for the first token): every word has its own restaurant, all of which share the unigram restaurant
as parent, whose base is even over the V words seen in training and one class of unseen words.

Seating is sampled by Gibbs sweeps. A sweep draws the number of tables of every dish of every restaurant
anew from its conditional given the other dishes' tables: generalised Stirling numbers times the weights
of new tables (table sizes do not matter to any prediction). All dishes are drawn against the totals of
the sweep before, with random numbers that hang on the words and the sweep alone, so neither the number
of tasks nor the order of rows changes a draw. Up to EXACT customers the conditional is exact; above that
its Stirling numbers come from the saddle point of their generating function, on a grid around the mode.
The root's discount and the strength of the words' restaurants are those of DISCOUNTS and STRENGTHS that
best predict each training token from the others; the restaurants' discount is n1 / (n1 + 2 n2) of the
pairs' counts. Tables are averaged over the sweeps after BURN_IN.

Steps, each written to the scratch folder; arrays travel packed, one row a block and part:

1. one pass over the texts cuts partitions into blocks of about BLOCK_BYTES and writes for each its
   distinct words and its tokens as places among them;
2. a block marks its distinct pairs of words with 30 bits each, dealt by the pair's hash to parts of about
   PART_BYTES of text; a part tells which marks may stand for a pair that training holds twice, or once
   while a held-out text asks for it. All other training pairs are one customer at one table;
3. blocks send words and counts of the pairs told, parts sum them to the dishes of the restaurants;
4. blocks and parts name their words to owners, dealt by the word's hash, which hold counts and totals;
5. in a sweep owners redraw the root's tables and answer parts with totals and unigram probabilities,
   and parts redraw the pairs' tables and tell their sums by word;
6. blocks get back what they named, in the order in which they named it, and score their documents.

A common word or pair is summed in its block before it travels and is one entry of one part, and no
vocabulary is collected or broadcast. A task holds one block or one part.

Defined results: null text is empty (the end alone); repeated rows are scored, and counted, each; a null
doc_id is in no fold, so its held_out is null and it teaches nothing; an empty table gives no rows; without
training rows N is 0 and every token is of the unseen class, whose probability is then 1; a very long text
makes a block of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, portions, word_hashes, words

SWEEPS, BURN_IN = 5, 2
EXACT, GRID, SCALE = 48, 64, 1e6
STRENGTH = 1.0
STRENGTHS = np.geomspace(0.01, 50_000, 24)
DISCOUNTS = np.linspace(0.05, 0.95, 19)
BLOCK_BYTES, PART_BYTES, SLICE_BYTES = 9_000_000, 44_000_000, 1_000_000
#: Blocks are scored in so many rounds, which bounds what the answers take of the disk.
ROUNDS = 2
SEED = 17
END = np.int64(-0x5BD1E995_5BD1E995)


# Rows of packed arrays


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows under a schema of "name type" fields; arrays become binary."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "doubles": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    pack = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x
    return pa.table({n: pa.array([pack(r[i]) for r in rows], kinds[k.replace("array<double>", "doubles")]) for i, (n, k) in enumerate(fields)})


def _sorted_rows(t: pa.Table, by: str) -> list[int]:
    return np.argsort(t.column(by).to_numpy(), kind="stable").tolist()


def _array(t: pa.Table, column: str, kind: str, row: int = 0) -> np.ndarray:
    return np.frombuffer(t.column(column)[row].as_buffer(), kind)


def _squeezed(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences behind their count."""
    return np.int64(len(x)).tobytes() + pa.compress(np.diff(x.view(np.uint64), prepend=np.uint64(0)), "zstd", asbytes=True)


def _numbers(t, column: str, row: int = 0) -> np.ndarray:
    """What ``_squeezed`` made."""
    data = t.column(column)[row].as_buffer()
    n = int(np.frombuffer(data[:8], np.int64)[0])
    return np.cumsum(np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint64), dtype=np.uint64).view(np.int64) if n else np.empty(0, np.int64)


def _share(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n takes a hash: ranges of its upper half, so that what is sorted by hash is sorted by taker."""
    return (((h.view(np.uint64) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _cuts(takers: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(taker, start, end) of the takers that get something."""
    at = np.searchsorted(takers, np.arange(n + 1)).tolist()
    return [(p, at[p], at[p + 1]) for p in range(n) if at[p + 1] > at[p]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of context and word."""
    return _mixed((_mixed(u.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) + w.view(np.uint64))


def uniform(key: np.ndarray, sweep: int) -> np.ndarray:
    """A number in (0, 1) for each key, another one in each sweep."""
    x = _mixed(key.view(np.uint64) + np.uint64((SEED + 2 * sweep + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


# Blocks


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, each with its end, and where each text's tokens end."""
    ids, n = [np.empty(0, np.int64)], []
    for t in texts:
        w = words(t)
        ids += [word_hashes(w).view(np.int64), np.array([END])]
        n.append(len(w) + 1)
    return np.concatenate(ids), np.cumsum(n, dtype=np.int64)


BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, ends binary, local binary, words binary"


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out, text -> a row for each block."""
    first, made = TaskContext.get().partitionId() << 32, 0
    docs, held, ids, ends, size = [], [], [], [], 0

    def row():
        found, local = np.unique(np.concatenate(ids), return_inverse=True)
        shift = np.cumsum([0] + [e[-1] for e in ends[:-1]])
        all_ends = np.concatenate([e + s for e, s in zip(ends, shift)])
        cells = [pa.array([first + made], pa.int64()), pa.array([[x for d in docs for x in d]], pa.list_(pa.int64())), pa.array([[x for h in held for x in h]], pa.list_(pa.bool_()))]
        cells += [pa.array([x], pa.binary()) for x in (all_ends.tobytes(), pa.compress(local.astype(np.uint32), "zstd", asbytes=True), _squeezed(found))]
        return pa.RecordBatch.from_arrays(cells, ["block", "doc_id", "held_out", "ends", "local", "words"])

    for b in batches:
        for c in portions(b, 2, SLICE_BYTES):
            x, e = encode(c.column(2).to_pylist())
            docs.append(c.column(0).to_pylist())
            held.append(c.column(1).to_pylist())
            ids.append(x)
            ends.append(e)
            size += pc.sum(pc.binary_length(c.column(2))).as_py() or 0
            if size >= BLOCK_BYTES:
                yield row()
                made += 1
                docs, held, ids, ends, size = [], [], [], [], 0
    if docs:
        yield row()


def _local(t, row: int) -> np.ndarray:
    """A block's tokens as places among its words."""
    size = int(_array(t, "ends", "<i8", row)[-1])
    return np.frombuffer(pa.decompress(t.column("local")[row].as_buffer(), 4 * size, "zstd"), np.uint32)


def _learned(t, row: int) -> np.ndarray:
    """Whether a block's tokens are training tokens."""
    held = np.array([h is not False for h in t.column("held_out")[row].as_py()], bool)
    return np.repeat(~held, np.diff(_array(t, "ends", "<i8", row), prepend=0))


class Block:
    """A block's tokens and its distinct pairs of words, by the part that takes them, then by context and word."""

    def __init__(self, t, n_parts: int, row: int = 0):
        self.id = t.column("block")[row].as_py()
        self.ends, self.local, self.words = _array(t, "ends", "<i8", row), _local(t, row), _numbers(t, "words", row)
        self.learned, n = _learned(t, row), np.diff(self.ends, prepend=0)
        #: The word before is the token before; before a text's first one stands the end, its last one.
        self.back = np.arange(-1, len(self.local) - 1, dtype=np.int32)
        self.back[self.ends - n] = self.ends - 1
        codes = self.local.astype(np.int64)
        codes, self.pair = np.unique(codes[self.back] * len(self.words) + codes, return_inverse=True)
        u, w = self.words[codes // len(self.words)], self.words[codes % len(self.words)]
        del codes  # blocks are large, and a worker keeps what it once took
        key = pair_key(u, w)
        part = _share(key, n_parts)
        order = np.argsort(part, kind="stable")
        self.u, self.w, self.key, self.parts = u[order], w[order], key[order], _cuts(part[order], n_parts)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        del u, w, key, part, order
        self.pair = rank[self.pair]
        self.count = np.bincount(self.pair[self.learned], minlength=len(rank))


MARKS = "part int, block long, marks binary"


def _marks(n: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = Block(b, n, r)
                mark = ((x.key & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2)) | np.minimum(x.count, 2).astype(np.uint32)
                yield from _table(MARKS, [(p, x.id, mark[s:e]) for p, s, e in x.parts]).to_batches()

    return run


TOLD = "block long, part int, told binary"


def _told(t: pa.Table) -> pa.Table:
    """Which marks of each block may stand for pairs that need counting together."""
    marks = [_array(t, "marks", "<u4", r) for r in range(t.num_rows)]
    every = np.concatenate(marks)
    every.sort()
    own, count = every >> np.uint32(2), every & np.uint32(3)
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    total, asked = np.add.reduceat(count.astype(np.int64), start), count[start] == 0
    needed = own[start][(total >= 2) | ((total == 1) & asked)]
    out = []
    for r, m in enumerate(marks):
        m = m >> np.uint32(2)
        at = np.minimum(np.searchsorted(needed, m), max(len(needed) - 1, 0))
        out.append((t.column("block")[r].as_py(), t.column("part")[r].as_py(), np.packbits(needed[at] == m if len(needed) else np.zeros(len(m), bool))))
    return _table(TOLD, out)


PAIRS = "part int, block long, told binary, u binary, w binary, n binary"


def _pairs(n: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the worker's earlier tasks held
        if not block.num_rows:
            return _table(PAIRS, [])
        x = Block(block, n)
        bits = {p: r for r, p in enumerate(told.column("part").to_pylist())}
        rows = []
        for p, s, e in x.parts:
            packed = _array(told, "told", "u1", bits[p])
            has = np.flatnonzero(np.unpackbits(packed, count=e - s)) + s
            rows.append((p, x.id, packed, _squeezed(x.u[has]), x.w[has], pa.compress(x.count[has], "zstd", asbytes=True)))
        return _table(PAIRS, rows)

    return run



# Parts and owners: a row with their state, and rows with the places of what a block or part named.

PART = "part int, block long, told binary, at binary, words binary, iu binary, iw binary, c binary, t binary, kept binary, stats array<double>"
PART_STATE, PART_ASKS = ("part", "words", "iu", "iw", "c", "t", "kept", "stats"), ("part", "block", "told", "at")


def _gathered(t: pa.Table) -> pa.Table:
    pa.default_memory_pool().release_unused()
    order = _sorted_rows(t, "block")
    us = [_numbers(t, "u", r) for r in order]
    count = lambda r, size: np.frombuffer(pa.decompress(t.column("n")[r].as_buffer(), 8 * size, "zstd"), np.int64) if size else np.empty(0, np.int64)
    u, w, n = np.concatenate(us), np.concatenate([_array(t, "w", "<i8", r) for r in order]), np.concatenate([count(r, len(x)) for r, x in zip(order, us)])
    key = pair_key(u, w)
    by = np.argsort(key, kind="stable")
    new = np.append(True, key[by][1:] != key[by][:-1])[: len(key)]
    start = np.flatnonzero(new)
    c = np.add.reduceat(n[by], start) if len(start) else np.empty(0, np.int64)
    held = c > 0  # the rest is asked for by held-out texts only
    at = np.empty(len(key), np.int32)
    at[by] = np.where(held, np.cumsum(held) - 1, -1)[np.cumsum(new) - 1]
    first = by[start][held]
    u, w, c = u[first], w[first], c[held]
    ids, inverse = np.unique(np.concatenate([u, w]), return_inverse=True)
    part, i = t.column("part")[0].as_py(), inverse.astype(np.int32)
    stats = [float((c == 1).sum()), float((c == 2).sum()), float(c.sum()), float(len(c))]
    rows, k = [(part, None, None, None, ids, i[: len(u)], i[len(u) :], c, np.ones(len(c), np.int64), np.zeros(len(c), np.int64), stats)], 0
    for r, size in zip(order, map(len, us)):
        rows.append((part, t.column("block")[r].as_py(), _array(t, "told", "u1", r), at[k : k + size], *[None] * 7))
        k += size
    return _table(PART, rows)


NAMED = "owner int, frm long, is_part int, words binary, a binary, b binary, tables_u binary, tables_w binary"


def _by_owner(found: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(owner, places of its words), always in the same order."""
    owner = _share(_mixed(found.view(np.uint64)), n)
    order = np.argsort(owner, kind="stable")
    return [(q, order[s:e]) for q, s, e in _cuts(owner[order], n)]


def _words_of_blocks(n: int):
    """Words of a block, and how often training has each."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                local, found, learned = _local(b, r), _numbers(b, "words", r), _learned(b, r)
                c = np.bincount(local[learned], minlength=len(found))
                yield from _table(NAMED, [(q, b.column("block")[r].as_py(), 0, found[at], c[at], None, None, None) for q, at in _by_owner(found, n)]).to_batches()

    return run


def _by_word(size: int, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bincount(i, x, size).astype(np.int64)


def _words_of_parts(n: int):
    """Words of a part, with the customers and tables of its dishes by context and by word."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, iu, iw, c, t = (_array(b, x, k, r) for x, k in (("words", "<i8"), ("iu", "<i4"), ("iw", "<i4"), ("c", "<i8"), ("t", "<i8")))
                sums = [_by_word(len(ids), i, x) for x in (c, t) for i in (iu, iw)]
                yield from _table(NAMED, [(q, b.column("part")[r].as_py(), 1, ids[at], *(x[at] for x in sums)) for q, at in _by_owner(ids, n)]).to_batches()

    return run


OWNER = "owner int, frm long, is_part int, at binary, words binary, c binary, alone binary, tables_of binary, dishes binary, t0 binary, kept_own binary, kept_tables binary, stats array<double>"
OWNER_STATE, OWNER_ASKS = ("owner", "words", "c", "alone", "tables_of", "dishes", "t0", "kept_own", "kept_tables", "stats"), ("owner", "frm", "is_part", "at")


def _owners(t: pa.Table) -> pa.Table:
    q = t.column("owner")[0].as_py()
    named = [_array(t, "words", "<i8", r) for r in range(t.num_rows)]
    is_part, frm = t.column("is_part").to_pylist(), t.column("frm").to_pylist()
    ids = np.unique(np.concatenate(named))
    c, by_u, by_w, tables_of, dishes = (np.zeros(len(ids), np.int64) for _ in range(5))
    asked = []
    for r, w in enumerate(named):
        at = np.searchsorted(ids, w)
        for total, column in ((by_u, "a"), (by_w, "b"), (tables_of, "tables_u"), (dishes, "tables_w")) if is_part[r] else ((c, "a"),):
            total[at] += _array(t, column, "<i8", r)
        asked.append((q, frm[r], is_part[r], at.astype(np.int32), *[None] * 9))
    # What no part counts is a pair found once: one customer, one table.
    alone = c - by_u
    tables_of, dishes = tables_of + alone, dishes + c - by_w
    size, times = np.unique(dishes[dishes > 1], return_counts=True)
    left_out = [float((times * size * np.log(size - 1 - d)).sum()) for d in DISCOUNTS]
    stats = [float(c.sum()), float((c > 0).sum()), float((dishes == 1).sum()), *left_out]
    zero = np.zeros(len(ids))
    return _table(OWNER, [(q, None, None, None, ids, c, alone, tables_of, dishes, np.minimum(dishes, 1), zero, zero, stats), *asked])


# Sweeps. Owners' rows for a part, parts' rows for an owner.

TO_PART = "owner int, part int, total binary, p0 binary, customers binary, words binary, c binary, alone binary, tables_of binary, dishes binary, t0 binary, kept_own binary, kept_tables binary, stats array<double>"
TO_OWNER = "part int, owner int, by_u binary, by_w binary, words binary, iu binary, iw binary, c binary, t binary, kept binary, stats array<double>"


def _root(d0: float, d: float, base: float, root: float, customers: float, keep: bool, sweep: int):
    """Owners: take in what changed, redraw the root's tables (not in sweep 0), answer the parts."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        owner, frm = own.column("owner")[0].as_py(), own.column("frm").to_pylist()
        s = frm.index(None)
        ids, c, alone, t0 = (_array(own, x, "<i8", s) for x in ("words", "c", "alone", "t0"))
        tables_of, dishes = (_array(own, x, "<i8", s).copy() for x in ("tables_of", "dishes"))
        places = {f: _array(own, "at", "<i4", r) for r, f in enumerate(frm) if r != s}
        for r, p in enumerate(told.column("part").to_pylist()):
            tables_of[places[p]] += _array(told, "by_u", "<i8", r)
            dishes[places[p]] += _array(told, "by_w", "<i8", r)
        if sweep:
            t0 = tables(dishes, np.full(len(ids), base), root - t0, d0, STRENGTH, uniform(_mixed(ids.view(np.uint64)), sweep))
        share = np.maximum(dishes - d0 * t0, 0) / (STRENGTH + customers)
        p0 = share + (STRENGTH + d0 * root) / (STRENGTH + customers) * base
        some = (alone > 0) & (c > 1)
        left_out = [] if sweep else [float((alone[some] * np.log((k + d * (tables_of[some] - 1)) / (k + c[some] - 1))).sum()) for k in STRENGTHS]
        kept = _array(own, "kept_own", "<f8", s) + keep * share, _array(own, "kept_tables", "<f8", s) + keep * tables_of
        state = (owner, None, None, None, None, ids, c, alone, tables_of, dishes, t0, *kept, [float(t0.sum()), *left_out])
        return _table(TO_PART, [state, *((owner, p, tables_of[at], p0[at], None if sweep else c[at], *[None] * 9) for p, at in places.items())])

    return run


class Part:
    """A part's dishes with what the owners answered."""

    def __init__(self, state: pa.Table, got: pa.Table, n: int):
        self.id = state.column("part")[0].as_py()
        self.ids, self.c, self.t, self.kept = (_array(state, x, "<i8") for x in ("words", "c", "t", "kept"))
        self.iu, self.iw = _array(state, "iu", "<i4"), _array(state, "iw", "<i4")
        self.owned, rows = _by_owner(self.ids, n), {q: r for r, q in enumerate(got.column("owner").to_pylist())}
        join = lambda name, kind: self._placed([_array(got, name, kind, rows[q]) for q, _ in self.owned], kind)
        self.total, self.p0 = join("total", "<i8")[self.iu], join("p0", "<f8")[self.iw]
        if got.num_rows and got.column("customers")[0].as_py() is not None:
            self.customers = join("customers", "<i8")[self.iu]

    def _placed(self, parts: list[np.ndarray], kind: str) -> np.ndarray:
        out = np.empty(len(self.ids), kind)
        for (_, at), x in zip(self.owned, parts):
            out[at] = x
        return out


def _left_out(n: int, d: float):
    """Parts: by each of STRENGTHS, the log-likelihood of every customer given the others."""

    def run(state: pa.Table, got: pa.Table) -> pa.Table:
        x = Part(state, got, n)
        sums = [0.0] * len(STRENGTHS)
        if len(x.c):
            left = np.minimum(x.t, x.c - 1)
            own, shared = x.c - 1 - d * left, d * (x.total - (x.t - left))
            sums = [float((x.c * np.log((own + (k + shared) * x.p0) / (k + x.customers - 1))).sum()) for k in STRENGTHS]
        return _table("part int, stats array<double>", [(x.id, sums)])

    return run


def _seated(n: int, d: float, strength: float, keep: bool, sweep: int):
    """Parts: redraw the tables of every pair, tell the owners what changed."""

    def run(state: pa.Table, got: pa.Table) -> pa.Table:
        x = Part(state, got, n)
        t = tables(x.c, x.p0, x.total - x.t, d, strength, uniform(pair_key(x.ids[x.iu], x.ids[x.iw]), sweep))
        by_u, by_w = (_by_word(len(x.ids), i, t - x.t) for i in (x.iu, x.iw))
        mine = (x.id, None, None, None, x.ids, x.iu, x.iw, x.c, t, x.kept + keep * t, [float(t.sum())])
        return _table(TO_OWNER, [mine, *((x.id, q, by_u[at], by_w[at], *[None] * 7) for q, at in x.owned)])

    return run


_STIRLING: dict[float, np.ndarray] = {}
_SADDLE: dict[float, tuple[np.ndarray, ...]] = {}


def log_stirling(d: float) -> np.ndarray:
    """[c, t]: log of the summed weights of the ways to seat c customers at t tables, new tables counted 1."""
    if d not in _STIRLING:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[1, 1] = 0
        for c in range(1, EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                s[c + 1, t] = np.logaddexp(s[c, t - 1], np.log(np.maximum(c - d * t, 1e-300)) + s[c, t])
        _STIRLING[d] = s
    return _STIRLING[d]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x."""
    y = x + 8.0
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(below)


def _few_tables(c: float, t: np.ndarray, d: float) -> np.ndarray:
    """The log of S(c, t) / c! by its alternating sum, which is exact while t is below c^d."""
    j, t = np.arange(1.0, 81), t[:, None]
    there = j <= t
    log = log_gamma(t + 1) - log_gamma(j + 1) - log_gamma(np.where(there, t - j, 0) + 1) + log_gamma(1 + j * d) + log_gamma(c - j * d) - log_gamma(np.float64(c + 1)) - np.log(np.pi)
    sign = np.where(there, (-1) ** (j + 1) * np.sin(np.pi * j * d), 0)
    total = (sign * np.exp(log - log[:, :1])).sum(1)
    return log[:, 0] + np.log(total) - (t * np.log(d) + log_gamma(t + 1))[:, 0]


def log_stirling_large(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The log of S(c, t) / c!, for 1 <= t < c: t tables of Sibuya sizes hold c customers with the probability that
    stands at z^c in (1 - (1 - z)^d)^t, here by its saddle point. Above d = 0.5 that fails for tables fewer than c^d
    by what depends on t / c^d alone, as the sum nears a stable law; this is measured once, against the exact
    sum at SCALE customers. The result is off by less than 0.2, and by 0.35 for less than five tables below d = 0.5."""
    if d not in _SADDLE:
        odds = np.linspace(-300, 60, 20_001)  # log of y / (1 - y), where y = 1 - z
        log_y, rest = -np.log1p(np.exp(-odds)), 1 / (1 + np.exp(odds))
        with np.errstate(divide="ignore", invalid="ignore"):
            m = d * rest * np.exp((d - 1) * log_y) / -np.expm1(d * log_y) - 1
        m = np.where(rest < 1e-5, (1 - d) / 2 * rest, m)
        _SADDLE[d] = np.log(m)[::-1], odds[::-1], np.array([0.0]), np.array([0.0])
        if d > 0.5:
            few = np.unique(np.round(np.geomspace(1, SCALE**d, 60)))
            off = _few_tables(SCALE, few, d) - log_stirling_large(np.full(len(few), SCALE), few, d)
            _SADDLE[d] = *_SADDLE[d][:2], np.append(np.log(few) - d * np.log(SCALE), np.log(3)), np.append(off, 0)
    logs, odds, ratio, off = _SADDLE[d]
    more = c / t - 1
    odds = np.interp(np.log(more), logs, odds)
    log_y = -np.logaddexp(0, -odds)
    spread = c * ((1 - d) * np.exp(-odds) - more)
    near = t * np.log(-np.expm1(d * log_y)) + c * np.logaddexp(0, odds) - 0.5 * np.log(np.maximum(2 * np.pi * spread, 1e-300))
    return near - t * np.log(d) - log_gamma(t + 1) + np.interp(np.log(t) - d * np.log(c), ratio, off)


def tables(c: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, strength: float, draw: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with c customers each, given the parent's probability, the other tables there and a number in (0, 1)."""
    t = np.minimum(c, 1)
    others = np.maximum(others, 0)
    stirling = log_stirling(d)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for size in range(2, EXACT + 1):
        for k in range(edges[size - 2], edges[size - 1], 100_000):
            at = order[k : min(k + 100_000, edges[size - 1])]
            new = np.log(strength + d * (others[at, None] + np.arange(size))) + np.log(parent[at, None])
            logs = np.cumsum(new, 1) + stirling[size, 1 : size + 1]
            weight = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            t[at] = 1 + (weight < draw[at, None] * weight[:, -1:]).sum(1)
    for k in range(edges[-1], len(order), 10_000):
        at = order[k : k + 10_000]
        t[at] = _many(c[at].astype(float), parent[at], others[at], d, strength, draw[at])
    return t


def _many(c: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, strength: float, draw: np.ndarray) -> np.ndarray:
    """The same draw for many customers: on the whole numbers around the mode, or on GRID points among them."""
    start = strength / d + others

    def log_weight(t, col=False):
        x = (lambda v: v[:, None]) if col else (lambda v: v)
        return log_stirling_large(x(c), t, d) + t * np.log(d * x(parent)) + log_gamma(x(start) + t) - log_gamma(x(start))

    lo, hi = np.ones(len(c)), c - 1
    while (hi - lo).max() > 1:
        third = (hi - lo) / 3
        left = log_weight(lo + third) < log_weight(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    mode = np.clip((lo + hi) / 2, 2, c - 2)
    step = np.minimum(np.maximum(1, mode / 50), np.minimum(mode - 1, c - 1 - mode))
    bend = (2 * log_weight(mode) - log_weight(mode - step) - log_weight(mode + step)) / step**2
    wide = 8 / np.sqrt(np.maximum(bend, 1 / c**2))
    lo, hi = np.maximum(1, np.floor(mode - wide)), np.minimum(c - 1, np.ceil(mode + wide))
    grid = lo[:, None] + np.arange(GRID) * np.maximum(1, (hi - lo) / (GRID - 1))[:, None]
    logs = np.where(grid <= hi[:, None] + 0.5, log_weight(np.minimum(grid, c[:, None] - 1), True), -np.inf)
    weight = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
    want = draw * weight[:, -1]
    cell = np.minimum((weight < want[:, None]).sum(1), GRID - 1)
    row = np.arange(len(c))
    before = np.where(cell > 0, weight[row, cell - 1], 0.0)
    inside = np.clip((want - before) / np.maximum(weight[row, cell] - before, 1e-300), 0, 1) - 0.5
    apart = grid[:, 1] - grid[:, 0]
    return np.clip(np.round(grid[row, cell] + np.where(apart > 1, inside * apart, 0)), 1, c).astype(np.int64)


# Answers and scores

ANSWER = "block long, frm int, is_part int, told binary, x binary, p0 binary, tables_of binary"


def _part_answers(d: float, kept: int):
    def run(state: pa.Table, asks: pa.Table) -> pa.Table:
        own = np.append(_array(state, "c", "<i8") - d * _array(state, "kept", "<i8") / kept, 0).astype(np.float32)  # -1: none
        part = state.column("part")[0].as_py()
        return _table(ANSWER, [(asks.column("block")[r].as_py(), part, 1, _array(asks, "told", "u1", r), own[_array(asks, "at", "<i4", r)], None, None) for r in range(asks.num_rows)])

    return run


def _owner_answers(kept: int, backoff: float):
    def run(state: pa.Table, asks: pa.Table) -> pa.Table:
        c = _array(state, "c", "<i8")
        p0 = (_array(state, "kept_own", "<f8") / kept + backoff).astype(np.float32)
        tables_of = (_array(state, "kept_tables", "<f8") / kept).astype(np.float32)
        owner = state.column("owner")[0].as_py()
        return _table(ANSWER, [(asks.column("frm")[r].as_py(), owner, 0, None, c[at], p0[at], tables_of[at]) for r in range(asks.num_rows) for at in [_array(asks, "at", "<i4", r)]])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(n: int, d: float, strength: float, n_train: int, seen: int):
    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        x = Block(block, n)
        rows = {k: r for r, k in enumerate(zip(got.column("is_part").to_pylist(), got.column("frm").to_pylist()))}
        own = (x.count > 0) * (1 - d)
        for p, s, e in x.parts:
            has = np.flatnonzero(np.unpackbits(_array(got, "told", "u1", rows[1, p]), count=e - s)) + s
            own[has] = _array(got, "x", "<f4", rows[1, p])
        c, p0, tables_of = np.empty(len(x.words), np.int64), np.empty(len(x.words)), np.empty(len(x.words))
        for q, at in _by_owner(x.words, n):
            c[at], p0[at], tables_of[at] = _array(got, "x", "<i8", rows[0, q]), _array(got, "p0", "<f4", rows[0, q]), _array(got, "tables_of", "<f4", rows[0, q])
        base = np.log10((c + 1.0) / (n_train + seen + 1.0))
        before = x.local[x.back]
        p = (own[x.pair] + (strength + d * tables_of[before]) * p0[x.local]) / (strength + c[before])
        start = np.append(0, x.ends[:-1])
        sums = [np.add.reduceat(v, start) for v in ((c > 0).astype(np.int64)[x.local], base[x.local], np.log10(p))]
        held = block.column("held_out")[0].as_py()
        return pa.table(
            {
                "doc_id": pa.array(block.column("doc_id")[0].as_py(), pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": np.diff(x.ends, prepend=0), "n_known": sums[0],
                "train_tokens": np.full(len(held), n_train, np.int64), "base_score": sums[1], "score": sums[2],
            }
        )

    return run


def _stats(rows: DataFrame, n: int) -> list[float]:
    """Sums of what parts or owners report."""
    return list(rows.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0.0)) for k in range(n)]).first())


def score(docs: DataFrame, folds: int = 7, held: int = 2, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from rows whose crc32(doc_id) mod folds is not ``held``."""
    scratch = Scratch(docs.sparkSession)
    put = lambda df, name: scratch.put(df, name, "zstd")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held).alias("held_out"), "text")
    blocks = put(src.mapInArrow(_blocks, BLOCKS), "blocks")
    told = put(blocks.select("block", "held_out", "ends", "local", "words").mapInArrow(_marks(n), MARKS).groupBy("part").applyInArrow(_told, TOLD), "told")
    pairs = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_pairs(n), PAIRS)
    first = put(pairs.groupBy("part").applyInArrow(_gathered, PART), "parts")
    scratch.drop(told)
    parts, part_asks = first.where("block is null").select(*PART_STATE), put(first.where("block is not null").select(*PART_ASKS), "asks")
    named = blocks.select("block", "held_out", "ends", "local", "words").mapInArrow(_words_of_blocks(n), NAMED).union(parts.mapInArrow(_words_of_parts(n), NAMED))
    owned = put(named.groupBy("owner").applyInArrow(_owners, OWNER), "owners")
    owners, asks = owned.where("frm is null").select(*OWNER_STATE), put(owned.where("frm is not null").select(*OWNER_ASKS), "asks")
    # What no part holds was found once: one table each.
    once, twice, counted, dishes = _stats(parts, 4)
    n_train, seen, single, *many = _stats(owners, 3 + len(DISCOUNTS))
    alone = n_train - counted
    d = float(np.clip((once + alone + 0.5) / (once + alone + 2 * twice + 1), 0.1, 0.9))
    d0 = float(DISCOUNTS[np.argmax(np.add(many, single * np.log(STRENGTH + DISCOUNTS * max(seen - 1, 0))))])
    base, root, customers = 1 / (seen + 1), seen, alone + dishes
    sweeps, strength, kept, backoff, seated, rooted = max(1, sweeps), STRENGTH, 0, 0.0, first, owned
    changes = docs.sparkSession.createDataFrame([], TO_OWNER)
    for s in range(sweeps + 1):
        keep = s > min(BURN_IN, sweeps - 1)
        if s:
            new = put(parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_seated(n, d, strength, keep, s), TO_OWNER), "seated")
            parts, changes = new.where("owner is null").select(*PART_STATE), new.where("owner is not null").select("part", "owner", "by_u", "by_w")
            scratch.drop(seated)
            seated = new
            customers = alone + _stats(parts, 1)[0]
        left = owners.unionByName(asks.where("is_part = 1").drop("is_part"), allowMissingColumns=True)
        new = put(left.groupBy("owner").cogroup(changes.groupBy("owner")).applyInArrow(_root(d0, d, base, root, customers, keep, s), TO_PART), "root")
        owners, answers = new.where("part is null").select(*OWNER_STATE), new.where("part is not null").select("owner", "part", "total", "p0", "customers")
        scratch.drop(rooted)
        rooted = new
        root, *likelihood = _stats(owners, 1 + len(STRENGTHS))
        if not s:
            more = _stats(parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_left_out(n, d), "part int, stats array<double>"), len(STRENGTHS))
            strength = float(STRENGTHS[np.argmax(np.add(likelihood, more))])
        if keep:
            kept, backoff = kept + 1, backoff + (STRENGTH + d0 * root) / (STRENGTH + customers) * base
    run, out = _scored(n, d, strength, int(n_train), int(seen)), None
    for k in range(ROUNDS):
        mine = lambda df, by="block": df.where(F.pmod(F.xxhash64(by), F.lit(ROUNDS)) == k)  # noqa: B023, E731
        found = parts.groupBy("part").cogroup(mine(part_asks).groupBy("part")).applyInArrow(_part_answers(d, kept), ANSWER)
        found = found.union(owners.groupBy("owner").cogroup(mine(asks.where("is_part = 0"), "frm").groupBy("owner")).applyInArrow(_owner_answers(kept, backoff / kept), ANSWER))
        part = put(mine(blocks).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, SCORED), "scored")
        out = part if out is None else out.union(part)
    scratch.drop(blocks, part_asks, asks, seated, rooted)
    return out
