"""What the text operators share: cutting lineage, checked broadcasts, word and n-gram hashes."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.session import discard, materialize, shared_dir

__all__ = ["discard", "materialize", "shared_dir"]

#: Rows of at most a few numbers each that are broadcast without hesitation (about 32 MB).
BROADCAST_ROWS = 1_000_000


#: Rows of an Arrow batch.
ARROW_ROWS = 1000


#: Bytes that a broadcast may take, by its rows and the widths of its columns, and what a column of each kind counts as.
BROADCAST_BYTES = 256 << 20
WIDTHS = {"string": 64, "binary": 64, "array": 256, "map": 512}


def row_bytes(df: DataFrame) -> int:
    """What a row of df counts as in a broadcast."""
    return sum(WIDTHS.get(f.dataType.typeName(), 16) for f in df.schema.fields)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast only if it has at most max_rows rows, and no more than BROADCAST_BYTES by its columns; else a join of
    it shuffles. df must be materialized; one that materialize() returned is not counted again."""
    most = min(max_rows, BROADCAST_BYTES // row_bytes(df))
    rows = getattr(df, "table_rows", None)
    return F.broadcast(df) if (df.limit(most + 1).count() if rows is None else rows) <= most else df


def release() -> None:
    """Gives back the memory that this process no longer uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than in the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, an Arrow batch function, which at its end gives back the memory that the worker no longer uses: the worker
    stays for later tasks, beside an executor that may then need it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df through run in Arrow batches of ARROW_ROWS rows at most, unless the session has another setting than the default:
    batches are held on both sides, and those of 10,000 texts took hundreds of MB of an executor."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(tidy(run), schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- numpy over the UTF-8 bytes of Arrow string columns -------------------------------------------------

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[str, list] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Two primes below 2**31, and a base for each: sums of 2**32 products fit into 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (1540483477, 1103515245)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, powers of its base and of the base's inverse."""
    if "powers" not in _POWERS or len(_POWERS["powers"][0][0]) < n:
        out = []
        for prime, base in zip(PRIMES, BASES, strict=True):
            both = []
            for x in (base, pow(base, -1, prime)):
                got = np.ones(1, np.uint64)
                while len(got) < max(n, 1 << 16):
                    got = np.concatenate([got, got * _U(pow(x, len(got), prime)) % _U(prime)])
                both.append(got)
            out.append((both[0], both[1]))
        _POWERS["powers"] = out
    return _POWERS["powers"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other (null: empty), and its n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int, rows: int = 1 << 30) -> list[tuple[int, int]]:
    """Runs of texts (first, last + 1) of about limit bytes and of rows texts at most, so that working memory follows
    these and the longest text."""
    out, a = [], 0
    while a < len(offsets) - 1:
        b = min(a + rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
        out.append((a, b))
        a = b
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last and text of each word, a word being a run without ASCII white space."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Spans of more bytes are hashed and compared one by one.
LONG = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The number that the 8 bytes from each place on make, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, eight bytes at a time through a mixing of all bits, or by BLAKE2 if they are long. There is no
    sum of powers in it, which repetitive strings could cancel out; where equality decides alone, compare with same_bytes()."""
    n, eights = ends - starts, _eights(data)
    out = mix64(n.astype(np.uint64) + _BASE)
    live = np.flatnonzero((n > 0) & (n <= LONG))
    for k in range(0, LONG, 8):
        live = live[n[live] > k]
        if not len(live):
            break
        out[live] = mix64(out[live] ^ (eights[starts[live] + k] & _MASKS[np.minimum(n[live] - k, 8)]))
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def span_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ascending spans that are not empty and do not overlap, as an Arrow array."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1  # one span may end where another begins
    joined = np.ascontiguousarray(data[np.cumsum(edge[:-1], dtype=np.int8) > 0])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, equal for equal bytes only, and the spans' bytes by number."""
    coded = span_array(data, starts, ends).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def run_key() -> str:
    """A key for keyed_hash(), drawn on the driver for a run of its own."""
    return secrets.token_hex(8)


def keyed_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: str) -> np.ndarray:
    """64-bit SipHash of spans. Nobody can choose texts whose hashes meet without knowing the key, which no run keeps."""
    import pandas as pd

    if not len(starts):
        return np.zeros(0, np.uint64)
    which, held = numbered(data, starts, ends)
    return pd.util.hash_array(held.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)[which]


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, o_starts: np.ndarray, o_ends: np.ndarray) -> bool:
    """Whether each span of data has the bytes of its counterpart in others."""
    n = ends - starts
    if not np.array_equal(n, o_ends - o_starts):
        return False
    mine, theirs = _eights(data), _eights(others)
    live = np.flatnonzero(n <= LONG)
    for k in range(0, LONG, 8):
        live = live[n[live] > k]
        if (((mine[starts[live] + k] ^ theirs[o_starts[live] + k]) & _MASKS[np.minimum(n[live] - k, 8)]) != 0).any():
            return False
    return all(np.array_equal(data[starts[i] : ends[i]], others[o_starts[i] : o_ends[i]]) for i in np.flatnonzero(n > LONG).tolist())


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums, a row for each prime, from which span_hash() takes the hash of any span of fewer than 2**31 bytes."""
    sums = np.zeros((len(PRIMES), len(data) + 1), np.uint64)
    for row, prime, (up, _), table in zip(sums, PRIMES, _powers(len(data) + 1), (_TABLE >> _U(33), _TABLE & _U(0x3FFFFFFF)), strict=True):
        np.cumsum(table[data] * up[: len(data)] % _U(prime), out=row[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hashes of spans, mixed; equal bytes have equal hashes wherever they stand. Arithmetic is modulo primes: modulo
    a power of two such sums cancel out on Thue-Morse strings for every base."""
    first, second = (
        (row[ends] - row[starts]) % _U(prime) * down[starts] % _U(prime) for row, prime, (_, down) in zip(sums, PRIMES, _powers(sums.shape[1]), strict=True)
    )
    return mix64((first << _U(32) | second) + (ends - starts).astype(np.uint64) * _BASE)


def ngrams(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words of a text, and that text."""
    if len(hashes) < n:
        return hashes[:0], texts[:0]
    whole = texts[: len(texts) - n + 1] == texts[n - 1 :]
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out + hashes[k : len(hashes) - n + 1 + k] + _U(k + 1))
    return out[whole], texts[: len(whole)][whole]
