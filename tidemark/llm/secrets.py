"""Secret scans: patterns of known shapes, and random strings by token efficiency.

A byte-pair vocabulary packs what people write into long tokens and leaves random strings in short ones. So of
every run of key characters that has the length of a key, the characters per token of a public tiktoken
vocabulary tell words and names (about 3 and more, invented words above 2) from keys (1.2 to 1.8). Before that,
what is random by nature but no secret is left out: digests of known lengths (hex, or in base 64 behind the name of
their hash), UUIDs, plain numbers, and identifiers (words, CamelCase and names joined by separators).

The patterns' spans are whole matches, found leftmost and apart from each other by kind; a match whose key is too
short is dropped after it has taken its text. The token test adds spans of kind ``token`` where no other span lies.

Defined results: null and empty texts have no spans; offsets are code points of the whole text, end exclusive;
repeated rows are scanned each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .common import portions

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer digits holds no such match
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

#: What the token test looks at: runs that may be keys.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))  # hex digits of the MD and SHA families
HEX_ONLY = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
NAMED_DIGEST = re.compile(r"(?:md5|sha-?\d{1,3})[-:=]\Z", re.I | re.A)
NAMED_INSIDE = re.compile(r"(?:md5|sha-?\d{1,3})[-=][A-Za-z0-9+/=]+", re.I | re.A)
SEPARATORS = re.compile(r"[+/_=-]+")
WORD_OR_NUMBER = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|\d+|[A-Za-z]{1,12}\d{1,8}|\d{2,8}T\d{2,6}Z?)")
HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
CHARS_PER_TOKEN = 2.0


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The vocabulary of a ``.tiktoken`` file, by default the public byte-level one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def is_digest(run: str, before: str) -> bool:
    """A digest by its length, a UUID, or what follows the name of a hash."""
    bare = run.replace("-", "")
    hexes = HEX_ONLY.fullmatch(bare) is not None and len(bare) in DIGEST_LENGTHS
    return hexes or UUID.fullmatch(run) is not None or NAMED_INSIDE.fullmatch(run) is not None or NAMED_DIGEST.search(before) is not None


def is_identifier(run: str) -> bool:
    """Words, numbers and CamelCase, joined by separators."""
    for part in SEPARATORS.split(run):
        if part and not WORD_OR_NUMBER.fullmatch(part):
            humps = HUMPS.findall(part)
            if "".join(humps) != part or len(part) < 3.5 * len(humps):
                return False
    return True


def random_spans(text: str, taken: list[tuple[int, int, str]], chars_per_token: float = CHARS_PER_TOKEN, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, ``token``) of runs that the vocabulary packs badly and that are no known digest or identifier."""
    out = []
    for m in CANDIDATE.finditer(text):
        run, s, e = m.group(), m.start(), m.end()
        if any(a < e and s < b for a, b, _ in taken) or is_identifier(run) or is_digest(run, text[max(0, s - 10) : s]):
            continue
        if len(run) < chars_per_token * len(encoder(vocabulary).encode_ordinary(run)):
            out.append((s, e, "token"))
    return out


def spans_of(text: str, chars_per_token: float = CHARS_PER_TOKEN, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, chars_per_token, vocabulary), key=lambda x: (x[0], KINDS.index(x[2])))


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(documents: DataFrame, chars_per_token: float = CHARS_PER_TOKEN, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, by start) of every row. No shuffle."""
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]

    def each(batches):
        for whole in batches:
            for b in portions(whole, 1, 8_000_000):
                found = [spans_of(t, chars_per_token, vocabulary) if t else [] for t in b.column(1).to_pylist()]
                base = [[x for x in f if x[2] != "token"] for f in found]
                cols = [b.column(0), *[pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in KINDS[:3]]]
                cols += [pa.array([hashlib.sha256(_told(f).encode()).hexdigest() for f in base]), pa.array([_told(f) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
