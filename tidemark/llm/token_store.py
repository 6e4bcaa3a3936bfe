"""Content-addressed store of token ids.

Each document's ids, ended by END_ID, are cut where a rolling hash of the last WINDOW ids has its low
bits zero, so equal passages give equal chunks wherever they stand. A chunk is kept once under the
SHA-256 of its bytes. A store is a folder of Parquet tables:

* ``chunks``: key, data, width (bytes an id, little-endian);
* ``recipes``: part, doc_id, row, n_tokens, start, node (SHA-256 of the chunk keys), keys - ascending
  by doc_id over the parts, ``start`` being the ids of all documents before it;
* ``manifest``: level, segment, node - a Merkle tree over the recipes in order, FAN_IN children a
  node, the root in the row of the highest level.

``verify_manifest`` recomputes the tree from the recipes' nodes; ``read_store`` checks every document's
node against its keys and every chunk against its key and returns counts and checksums, so the three
levels together verify what is read; ``tokenize`` does both. ``reconstruct`` returns the ids.

Defined results: null text is encoded as empty (the end id alone); rows that repeat a doc_id are
documents of their own, ordered by doc_id, then node, then row; a null doc_id comes first; other
columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, portions, runs, setting

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WINDOW, MASK, LEAST, MOST = 8, (1 << 10) - 1, 64, 8192
FAN_IN = 4096
CODEC = "zstd"
#: Bytes of text that are encoded at once.
PORTION = 4_000_000

_GEAR = np.random.default_rng(3).integers(0, 2**63, 1 << 16, dtype=np.uint64)
#: Classes of bytes, by which texts are cut where the byte-level pre-tokenizer cuts whatever stands around. A byte
#: inside a character has the class of its first byte.
_ODD, _LETTER, _DIGIT, _MARK, _QUOTE, _WIDE, _BLANK, _LINE, _INSIDE = range(9)


def _classes() -> np.ndarray:
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _MARK
    kind[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
    kind[0x30:0x3A] = _DIGIT
    kind[[0x27, 0x20, 0x0A]] = _QUOTE, _BLANK, _LINE
    kind[0x80:0xC0] = _INSIDE
    kind[0xC3:0xCA] = _LETTER  # U+00C0 to U+024F; the signs for times and divided are put right where they occur
    kind[0xCA:0xE1] = kind[0xE4:0xF5] = _WIDE  # no white space among these
    return kind


def _between() -> np.ndarray:
    """[16 * a + b]: whether there always is a cut between bytes of classes a and b; a line end's are found apart."""
    cut = np.zeros((16, 16), bool)
    run = [_LETTER, _DIGIT, _MARK]
    for a in run:
        cut[a, [b for b in run if b != a]] = True
    cut[[_LETTER, _DIGIT], _QUOTE] = True
    for b in (_BLANK, _LINE):
        cut[[*run, _QUOTE, _WIDE], b] = True
    return cut.ravel()


_KIND, _CUT = _classes(), _between()
_SOLID = np.isin(np.arange(16), [_LETTER, _DIGIT, _MARK, _QUOTE, _WIDE])
#: Pieces that the pre-tokenizer leaves whole.
_WHOLE = r"^(?: ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n)$"


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and the bounds of the texts in them."""
    at = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset) if len(x) else np.zeros(1, np.int32)
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(data)])


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts in pieces that the pre-tokenizer treats alike wherever they stand, an empty one behind each text, and the places of these."""
    data, at = _bytes(texts)
    kind = _KIND[data]
    inside = np.flatnonzero(kind == _INSIDE)
    for _ in range(3 if len(inside) else 0):
        kind[inside] = kind[inside - 1]
    sign = inside[(data[inside - 1] == 0xC3) & ((data[inside] == 0x97) | (data[inside] == 0xB7))]
    kind[sign] = kind[sign - 1] = _WIDE
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT[(kind[:-1] << 4) + kind[1:]]
    # Between solid characters a line end stands by itself.
    line = np.flatnonzero(kind == _LINE)
    line = line[(line > 0) & (line < len(data) - 1)]
    cut[line[_SOLID[kind[line - 1]] & _SOLID[kind[line + 1]]] + 1] = True
    cut[at[:-1][at[:-1] < at[1:]]] = True
    first, ends = np.flatnonzero(cut), at[1:]
    before = np.searchsorted(first, ends)
    return _binary(data, np.append(np.insert(first, before, ends), len(data)), pa.string()), before + np.arange(len(ends))


class Encoder:
    """Texts -> ids; the tokenizer sees each distinct piece once while it is remembered.

    Pieces and their ids are two Arrow arrays: ``known`` and ``ids``. A batch's pieces are numbered together with the
    known ones, so that what gets a number beyond these is new.
    """

    LIMIT, LONGEST = 300_000, 80

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tok = _tokenizer(name)
        self.type = _id_type(self.tok)
        #: The same merges without the search for cuts, for pieces that have none.
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.end = np.array([END_ID], self.type).tobytes()
        #: Bytes that each id stands for: as many as its name has characters in a byte-level vocabulary.
        self.lengths = np.zeros(self.tok.get_vocab_size(), np.int64)
        for name, i in self.tok.get_vocab().items():
            self.lengths[i] = len(name)
        #: How the vocabulary writes each byte.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.names = np.arange(256, dtype="<u4")
        self.names[np.setdiff1d(np.arange(256), plain)] = np.arange(256, 512 - len(plain))
        assert {chr(c) for c in self.names} == set(ByteLevel.alphabet())
        self.known, self.ids, self.used, self.turn = pa.array([""]), pa.array([self.end], pa.binary()), np.zeros(1, np.int32), 0

    def _raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by itself, encoded as one with a special token between them, which the tokenizer takes out before anything else."""
        encode = lambda x: [np.array(e.ids, self.type) for e in self.tok.encode_batch_fast(x, add_special_tokens=False)]
        if not self.special:
            return [x.tobytes() for x in encode(texts)]
        mark = self.special[0]
        ids = encode([mark.join(texts)])[0] if texts else np.empty(0, self.type)
        size = self.type.itemsize
        at = np.flatnonzero(ids == self.tok.token_to_id(mark))
        whole = ids.tobytes()
        return [whole[s:e] for s, e in zip([0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(whole)])][: len(texts)]

    def _merged(self, words: pa.Array) -> pa.Array:
        """Ids of pieces that have no cut: encoded as one text, told apart by their lengths in bytes."""
        data, at = _bytes(words)
        text = np.insert(self.names[data], at[1:-1], 0x20).tobytes().decode("utf-32-le")
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), at[1:]) + 1
        return _binary(ids.view(np.uint8), np.append(0, ends) * self.type.itemsize, pa.binary())

    def _learn(self, new: pa.Array) -> pa.Array:
        """Ids of pieces, in their order."""
        whole = pc.match_substring_regex(new, _WHOLE).to_numpy(zero_copy_only=False)
        words, rest = new.filter(pa.array(whole)), new.filter(pa.array(~whole))
        parts = [self._merged(words.slice(k, 8192)) for k in range(0, len(words), 8192)]
        parts += [pa.array(self._raw(rest.slice(k, 8192).to_pylist()), pa.binary()) for k in range(0, len(rest), 8192)]
        at = np.empty(len(new), np.int64)
        at[np.append(np.flatnonzero(whole), np.flatnonzero(~whole))] = np.arange(len(new))
        return pa.concat_arrays(parts).take(pa.array(at)) if parts else pa.array([], pa.binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with its end, and where each text's ids end."""
        if not len(texts):
            return np.empty(0, self.type), np.empty(0, np.int64)
        texts = texts.cast(pa.string()).fill_null("")
        # A text that holds a special token is encoded by itself and stands in the place of its end.
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        cut, ends = pieces(pc.if_else(pa.array(marked), "", texts) if marked.any() else texts)
        coded = pa.chunked_array([self.known, cut]).dictionary_encode()
        piece, names = coded.chunk(1).indices, coded.chunk(1).dictionary
        ids = pa.concat_arrays([self.ids, self._learn(names.slice(len(self.known)))])
        self._remember(names, ids, piece.to_numpy())
        if marked.any():
            own = [np.array(self.tok.encode(t, add_special_tokens=False).ids, self.type).tobytes() + self.end for t in texts.filter(pa.array(marked)).to_pylist()]
            place = piece.to_numpy().copy()
            place[ends[marked]] = len(ids) + np.arange(len(own))
            piece, ids = pa.array(place), pa.concat_arrays([ids, pa.array(own, pa.binary())])
        data, at = _bytes(ids.take(piece))
        return data.view(self.type), at[ends + 1].astype(np.int64) // self.type.itemsize

    def _remember(self, names: pa.Array, ids: pa.Array, piece: np.ndarray) -> None:
        """Pieces that are not too long; of too many, the half of the limit that was used last."""
        self.turn += 1
        used = np.append(self.used, np.empty(len(names) - len(self.used), np.int32))
        used[piece] = self.turn
        used[0] = self.turn
        keep = pc.binary_length(names).to_numpy() <= self.LONGEST
        if keep.sum() > self.LIMIT:
            least = np.sort(used[keep])[-self.LIMIT // 2]
            keep &= used > min(least, self.turn - 1)
        if not keep.all():
            names, ids, used = names.filter(pa.array(keep)), ids.filter(pa.array(keep)), used[keep]
        self.known, self.ids, self.used = names, ids, used


def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


def _id_type(tok) -> np.dtype:
    return np.dtype("<u2") if tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


#: Ids that are hashed at once.
_BLOCK = 1 << 18


def _marks(ids: np.ndarray, start: int, end: int) -> np.ndarray:
    """Places behind ids from start to end where the rolling hash has its low bits zero."""
    lead = min(start, WINDOW - 1)
    g = _GEAR[ids[start - lead : end] & 0xFFFF]
    h = g.copy()
    for j in range(1, WINDOW):
        h[j:] += g[:-j] << np.uint64(j)
    h ^= h >> np.uint64(31)
    return np.flatnonzero((h[lead:] & np.uint64(MASK)) == 0) + start + 1


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, given all texts' ids in a row and where each text ends.

    A cut lies at least LEAST ids behind a text's start, so no window that counts reaches into the text before.
    """
    found = np.concatenate([np.empty(0, np.int64), *(_marks(ids, s, s + _BLOCK) for s in range(0, len(ids), _BLOCK))])
    starts = np.append(0, ends[:-1])
    lo, hi = np.searchsorted(found, starts + LEAST), np.searchsorted(found, ends)
    out = []
    for s, e, i, j in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist()):
        own, last = [], s
        for c in found[i:j].tolist() if j > i else ():
            while c - last > MOST:
                last += MOST
                own.append(last)
            if c - last >= LEAST:
                own.append(c)
                last = c
        while e - last > MOST:
            last += MOST
            own.append(last)
        own.append(e)
        out.append(own)
    return out


def _chunked(name: str):
    def run(batches):
        enc = encoder(name)
        kind, width = pa.list_(pa.binary()), enc.type.itemsize
        for b in batches:
            for c in portions(b, 2, PORTION):
                ids, ends = enc.encode(c.column(2))
                raw = ids.tobytes()
                keys, datas, node, start = [], [], [], 0
                for own in cuts(ids, ends):
                    data = [raw[s * width : e * width] for s, e in zip([start, *own], own)]
                    key = [hashlib.sha256(d).digest() for d in data]
                    keys.append(key)
                    datas.append(data)
                    node.append(hashlib.sha256(b"".join(key)).digest())
                    start = own[-1]
                n = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(3), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, kind), pa.array(datas, kind), pa.array(np.full(len(n), width, np.int32))], ["row", "doc_id", "place", "n_tokens", "node", "keys", "data", "width"])
        pa.default_memory_pool().release_unused()

    return run


def _node(keys):
    """SHA-256 over an array of binary nodes, in order."""
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(keys, F.hex), "")), 256))


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, order: Column | None = None) -> None:
    """Encode doc_id, text and write the store under ``path``, in ascending order of ``order``, then of doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(0) if order is None else order).alias("place"))
    kind = src.schema["place"].dataType.simpleString()
    cut = src.mapInArrow(_chunked(tokenizer), f"row long, doc_id long, place {kind}, n_tokens long, node binary, keys array<binary>, data array<binary>, width int")
    # A batch goes to Python when it holds as much text as is encoded at once, not only after so many rows.
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(PORTION)):
        cut = scratch.put(cut, "cut", CODEC)
    chunks = cut.select("width", F.explode(F.arrays_zip("keys", "data")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.data").alias("data"), "width")
    chunks.dropDuplicates(["key"]).write.option("compression", CODEC).parquet(f"{path}/chunks")
    recipe = cut.select("place", "doc_id", "row", "n_tokens", "keys", "node")
    by = "place", F.col("doc_id").asc_nulls_first(), "node", "row"
    ordered = recipe.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    ordered = scratch.put(ordered, "ordered")
    scratch.drop(cut)
    # Two levels of running totals: of the parts, then inside each part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("rows")).select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy(*by)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    recipes = (
        ordered.join(parts, ordered.part == parts.p)
        .withColumn("start", F.col("ids_before") + F.coalesce(F.sum("n_tokens").over(prior), F.lit(0)))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(inside) - 1)
        .select("part", "rank", "doc_id", "row", "n_tokens", "start", "node", "keys")
    )
    recipes.sortWithinPartitions("part", "rank").write.parquet(f"{path}/recipes")
    scratch.drop(ordered)
    _tree(spark, path, scratch).write.parquet(f"{path}/manifest")


def _tree(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    below = spark.read.parquet(f"{path}/recipes").select(F.col("rank").alias("at"), "node")
    levels, level = None, 0
    while True:
        level += 1
        nodes = below.groupBy(F.floor(F.col("at") / FAN_IN).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("x")).select(F.lit(level).alias("level"), "segment", _node(F.col("x.node")).alias("node"))
        nodes = scratch.put(nodes, "nodes")
        levels = nodes if levels is None else levels.union(nodes)
        if nodes.count() <= 1:
            return levels
        below = nodes.select(F.col("segment").alias("at"), "node")


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """The tree over the recipes equals the one that was written."""
    mine = _tree(spark, path, Scratch(spark))
    kept = spark.read.parquet(f"{path}/manifest")
    return mine.exceptAll(kept).isEmpty() and kept.exceptAll(mine).isEmpty()


def _digested(batches):
    """Each chunk's ids counted and hashed, and its bytes checked against its key."""
    for b in batches:
        key, data, width = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist()
        n, crc, ok = [], [], []
        for k, d, w in zip(key, data, width):
            ids = np.frombuffer(d, f"<u{w}").astype("<u4")
            n.append(len(ids))
            crc.append(zlib.crc32(ids.tobytes()))
            ok.append(hashlib.sha256(d).digest() == k)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())], ["key", "n", "crc", "ok"])


def _crc_powers(bits: int) -> np.ndarray:
    """[k]: the 32 columns of the matrix that carries a CRC-32 past 4 * 2^k zero bytes."""
    one = np.empty(32, np.uint32)  # past one zero bit
    one[0], one[1:] = 0xEDB88320, np.uint32(1) << np.arange(31, dtype=np.uint32)
    m, out = one, []
    for k in range(5 + bits):
        if k >= 5:
            out.append(m)
        m = _carry(m, m)
    return np.array(out)


def _carry(m: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for j in range(32):
        out ^= np.where((crc >> np.uint32(j)) & np.uint32(1), m[j], np.uint32(0))
    return out


_POWERS = _crc_powers(40)


def carried(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """What a chunk's CRC-32 adds to that of a text in which so many 4-byte ids follow: the text's is the XOR of these."""
    crc = crc.astype(np.uint32)
    for k in range(int(ids_after.max(initial=0)).bit_length()):
        go = np.flatnonzero((ids_after >> k) & 1)
        crc[go] = _carry(_POWERS[k], crc[go])
    return crc


def _joined(batches):
    """Rows of a document follow each other in order: its ids counted, the CRC-32 of all of them, and whether all is as the recipe says."""
    for t, starts, ends in runs(batches, ["row"]):
        n, crc, ok = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "crc", "ok"))
        before = np.append(0, np.cumsum(n))
        after = np.repeat(before[ends], ends - starts) - before[1:]
        key, node = t.column("key").to_pylist(), t.column("node").take(pa.array(starts)).to_pylist()
        same = [hashlib.sha256(b"".join(key[s:e])).digest() == d for s, e, d in zip(starts.tolist(), ends.tolist(), node)]
        good = np.logical_and.reduceat(ok, starts) & np.array(same)
        whole = np.bitwise_xor.reduceat(carried(crc, after), starts)
        yield pa.RecordBatch.from_arrays([pa.array(t.column("row").to_numpy()[starts]), pa.array(before[ends] - before[starts]), pa.array(whole.astype(np.int64)), pa.array(good)], ["row", "n_tokens", "ids_crc32", "verified"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all ids, verified: from the files, without moving their bytes.

    Chunks are counted, hashed and checked where they are read; a document's CRC-32 is put together
    from its chunks' (CRC-32 is linear), so only digests are shuffled.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    wanted = recipes.select("row", "node", F.posexplode("keys").alias("seq", "key"))
    chunks = spark.read.parquet(f"{path}/chunks").select("key", "width", "data").mapInArrow(_digested, "key binary, n long, crc long, ok boolean")
    pieces = wanted.join(chunks, "key").select("row", "seq", "node", "key", "n", "crc", "ok")
    found = pieces.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(_joined, "row long, n_tokens long, ids_crc32 long, verified boolean")
    return recipes.select("row", "doc_id", "start").join(found, "row").select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the whole list of ids of every document."""
    recipes = spark.read.parquet(f"{path}/recipes")
    wanted = recipes.select("row", F.posexplode("keys").alias("seq", "key"))
    pieces = wanted.join(spark.read.parquet(f"{path}/chunks").select("key", "width", "data"), "key").select("row", "seq", "width", "data")
    ids = pieces.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(_rebuilt, "row long, ids array<int>")
    return recipes.select("row", "doc_id", "start").join(ids, "row").select("doc_id", "start", "ids")


def _rebuilt(batches):
    for t, starts, ends in runs(batches, ["row"]):
        data, width = t.column("data").to_pylist(), t.column("width").to_pylist()
        ids = [np.frombuffer(b"".join(data[s:e]), f"<u{width[s]}").astype(np.int32) for s, e in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(t.column("row").to_numpy()[starts]), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])


def tokenize(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, order: Column | None = None) -> DataFrame:
    """Write the store (to ``path`` or the scratch folder), recompute its Merkle tree from the files, and read it back."""
    path = path or Scratch(docs.sparkSession).path("store")
    write_store(docs, path, tokenizer, order)
    if not verify_manifest(docs.sparkSession, path):
        raise ValueError(f"the recipes under {path} are not those of its manifest")
    return read_store(docs.sparkSession, path)
