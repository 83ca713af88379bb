"""SentencePiece encoding without a merge queue, and decoding.

A sequence of pieces is what merging makes of a text exactly if merging makes of each two neighbours' joint text these two
again: merges inside two neighbours come in the same order whatever surrounds them, so that the first merge across an edge
would also come in the joint text alone. So the encoder takes the longest piece that stands at a place (Aho-Corasick),
asks whether it goes with the piece before (memo of re-merged pairs), else takes the piece's next shorter prefix, and goes
back over the last piece when none is left; places from which nothing followed are marked in a bitfield and never tried twice.

Texts are cut wherever no piece holds the two bytes beside the cut (before blanks, between most signs), which no merge can
cross. Arrow tells the different chunks of a block apart by their bytes; each is encoded once and remembered by its worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logsift.llm.common import arrow_map, pieces, text_bytes

#: Bytes of text encoded at a time.
BLOCK = 1 << 21
#: Chunks of at most LONG_CHUNK bytes, and pairs of pieces, that a worker remembers before it forgets all.
MEMO_CHUNKS, MEMO_PAIRS, LONG_CHUNK = 500_000, 500_000, 64
#: The sign that stands for a blank in pieces, what is shown for the unknown piece and for a byte that is no character.
BLANK, UNKNOWN, BAD = "▁", " ⁇ ", "�"
#: Piece types of a model file: fixed values of its format.
NORMAL, UNKNOWN_TYPE, CONTROL, BYTE = 1, 2, 3, 6

_NEVER = float("inf")


@dataclass(frozen=True)
class Vocabulary:
    """pieces and their types by id; order: a piece's place in merging, less is earlier; whole: symbols that merging makes
    of their own text; byte_ids: by byte; begin and end: ids; key: digest of the model file."""

    key: str
    pieces: tuple[str, ...]
    types: tuple[int, ...]
    order: dict[str, float]
    whole: frozenset[str]
    byte_ids: tuple[int, ...]
    begin: int
    end: int


def remerge(text: str, order: dict[str, float]) -> list[str]:
    """Pieces of a short text by definition: of neighbours whose joint text is a piece, the first in order are joined, the
    leftmost of equals, until there are none."""
    parts = list(text)
    ranks = [order.get(a + b, _NEVER) for a, b in zip(parts[:-1], parts[1:], strict=True)]  # of what stands at a place and the next
    while ranks and (best := min(ranks)) != _NEVER:
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at:
            ranks[at - 1] = order.get(parts[at - 1] + parts[at], _NEVER)
        if at < len(ranks):
            ranks[at] = order.get(parts[at] + parts[at + 1], _NEVER)
    return parts


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a model file on the driver. Models must merge (BPE), fall back to bytes, add a leading blank and change nothing
    else in a text, and have no pieces of the user's own; others raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        raw = f.read()
    model.ParseFromString(raw)
    n, t = model.normalizer_spec, model.trainer_spec
    kept = n.add_dummy_prefix and n.escape_whitespaces and not (n.remove_extra_whitespaces or n.precompiled_charsmap or n.normalization_rule_tsv)
    types = tuple(p.type for p in model.pieces)
    if not (kept and t.byte_fallback and t.model_type == t.BPE and not t.treat_whitespace_as_suffix and set(types) <= {NORMAL, UNKNOWN_TYPE, CONTROL, BYTE}):
        raise ValueError(f"{path} is not a byte-fallback BPE model that leaves texts as they are")
    names = tuple(p.piece for p in model.pieces)
    order = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
    signs = {c for p in order for c in p}
    whole = frozenset(signs | {p for p in order if remerge(p, order) == [p]})
    ids = {p: i for i, p in enumerate(names)}
    byte_ids = tuple(ids[f"<0x{b:02X}>"] for b in range(256))
    return Vocabulary(hashlib.sha256(raw).hexdigest(), names, types, order, whole, byte_ids, ids[t.bos_piece or "<s>"], ids[t.eos_piece or "</s>"])


class Encoder:
    """Encodes and decodes with a vocabulary; a worker keeps one for each."""

    held: ClassVar[dict[str, Encoder]] = {}

    def __init__(self, v: Vocabulary) -> None:
        import ahocorasick

        self.v = v
        self.signs = frozenset(s for s in v.whole if len(s) == 1)
        self.longest = ahocorasick.Automaton()
        for symbol in v.whole:
            self.longest.add_word(symbol, symbol)
        if v.whole:
            self.longest.make_automaton()
        self.ids = {p: (i,) for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t == NORMAL}
        self.shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[bytes, tuple[int, ...]] = {}
        shown = [p.replace(BLANK, " ").encode() if t == NORMAL else UNKNOWN.encode() if t == UNKNOWN_TYPE else b"" for p, t in zip(v.pieces, v.types, strict=True)]
        for b, i in enumerate(v.byte_ids):
            shown[i] = bytes([b])
        self.shown = pa.array(shown, pa.large_binary())
        self.width = np.array([len(s) for s in shown], np.int64)
        self.joined = np.zeros((256, 256), bool)  # pairs of bytes that a piece or a character holds
        self.joined[:, 128:192] = True
        for p in v.order:
            raw = p.replace(BLANK, " ").encode()
            self.joined[list(raw[:-1]), list(raw[1:])] = True
        self.is_byte = np.array([t == BYTE for t in v.types])
        self.is_control = np.array([t == CONTROL for t in v.types])

    @classmethod
    def of(cls, v: Vocabulary) -> Encoder:
        if v.key not in cls.held:
            cls.held.clear()
            cls.held[v.key] = cls(v)
        return cls.held[v.key]

    def _prefix(self, symbol: str) -> str | None:
        """The longest symbol that a symbol begins with, itself excepted."""
        if symbol not in self.shorter:
            self.shorter[symbol] = next((symbol[:k] for k in range(len(symbol) - 1, 0, -1) if symbol[:k] in self.v.whole), None)
        return self.shorter[symbol]

    def _together(self, pair: tuple[str, str]) -> bool:
        """Whether merging makes of the joint text of two these two again."""
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = remerge("".join(pair), self.v.order) == [*pair]
        return known

    def symbols(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters occur in the vocabulary, as merging would make them."""
        out = [s for _, s in self.longest.iter_long(text)]
        wrong = next((k for k, pair in enumerate(zip(out[:-1], out[1:], strict=True), 1) if not self._together(pair)), 0)
        if not wrong:
            return out
        symbol: str | None = out[wrong]
        del out[wrong:]
        at, failed = sum(map(len, out)), bytearray(len(text) // 8 + 1)
        matches, following = iter(()), False  # whether the iterator stands behind the symbol
        while symbol is not None:
            last, longest = out[-1] if out else None, symbol
            while symbol is not None:
                end = at + len(symbol)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self._together((last, symbol))):
                    break
                symbol = self._prefix(symbol)
            if symbol is None:
                failed[at >> 3] |= 1 << (at & 7)
                symbol = out.pop()  # the place before is tried again, up to here no more
                at, following = at - len(symbol), False
                continue
            out.append(symbol)
            at += len(symbol)
            if at == len(text):
                break
            if not following or symbol is not longest:
                matches, following = self.longest.iter_long(text, at), True
            symbol = next(matches)[1]
        return out

    def _encode(self, chunk: bytes) -> tuple[int, ...]:
        text = chunk.decode().replace(" ", BLANK)
        runs = [(True, text)] if self.signs.issuperset(text) else ((known, "".join(run)) for known, run in groupby(text, self.signs.__contains__))
        out: list[int] = []
        for known, run in runs:
            for s in self.symbols(run) if known else run:
                out += self.ids.get(s) or [self.v.byte_ids[b] for b in s.encode()]
        return tuple(out)

    def _ids_of(self, chunk: bytes) -> tuple[int, ...]:
        got = self.chunks.get(chunk)
        if got is None:
            got = self._encode(chunk)
            if len(chunk) <= LONG_CHUNK:
                if len(self.chunks) >= MEMO_CHUNKS:
                    self.chunks.clear()
                self.chunks[chunk] = got
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, begin and end included, and where each text's begin (n + 1 places)."""
        n = len(texts)
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), BLANK, " ")
        blank = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, offsets = text_bytes(pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())))
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.joined[data[:-1], data[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        bounds = np.append(np.flatnonzero(begins), len(data)).astype(np.int64)
        first = np.searchsorted(bounds, offsets)  # of a text's chunks
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = spans.dictionary_encode()
        got = [self._ids_of(chunk) for chunk in coded.dictionary.to_pylist()]
        sizes = np.array([len(g) for g in got], np.int64)
        table = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), pa.array(np.array([i for g in got for i in g], np.int32)))
        which = coded.indices.to_numpy()
        flat = table.take(coded.indices).flatten().to_numpy()
        upto = np.append(0, np.cumsum(sizes[which]))[first]  # ids before each text
        starts = upto + 2 * np.arange(n + 1)
        ids = np.empty(starts[-1], np.uint32)
        inside = np.ones(len(ids), bool)
        inside[starts[:-1]] = inside[starts[1:] - 1] = False
        ids[inside], ids[starts[:-1]], ids[starts[1:] - 1] = flat, self.v.begin, self.v.end
        return ids, starts

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts of sequences of ids, one after the other from starts on: blanks for their sign, without a leading one; control
        pieces show nothing, a byte that is part of no character shows BAD."""
        data = self.shown.take(pa.array(ids.astype(np.int64)))
        raw = memoryview(data.buffers()[2] or b"")
        ends = np.append(0, np.cumsum(self.width[ids]))[starts].tolist()
        bytes_before = np.append(0, np.cumsum(self.is_byte[ids]))[starts]
        out = []
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            text, mine = bytes(raw[a:b]), ids[starts[k] : starts[k + 1]]
            if bytes_before[k + 1] > bytes_before[k] and (self.is_control[mine[1:-1]].any() or not _valid(text)):  # a control piece parts bytes
                text = self._mended(mine)
            if text.startswith(b" "):
                seen = mine[~self.is_control[mine]][:1]
                text = text[1:] if len(seen) and self.v.pieces[seen[0]].startswith(BLANK) else text
            out.append(text)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """Shown bytes, with BAD for each byte of a run of byte pieces that no character holds."""
        out = []
        for is_byte, run in groupby(ids.tolist(), self.is_byte.__getitem__):
            raw = b"".join(self.shown[i].as_py() for i in run)
            while is_byte and raw and not _valid(raw):
                try:
                    raw.decode()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start] + BAD.encode())
                    raw = raw[e.start + 1 :]
            out.append(raw)
        return b"".join(out)


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode_and_decode(docs: DataFrame, v: Vocabulary, text_col: str = "text") -> DataFrame:
    """docs with sp_ids (ids with begin and end, each as four bytes, least first) and sp_text (what they decode to).

    A null or empty text has begin and end only, and decodes to an empty text. All rows and other columns stay, columns of
    those names are replaced; repeated rows give repeated rows; an empty table gives an empty one. Texts are never cut: memory
    follows the longest one.
    """
    added = ["sp_ids", "sp_text"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    at, names = docs.columns.index(text_col), [*docs.columns, *added]
    held = docs.sparkSession.sparkContext.broadcast(v)  # one model's pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(held.value)
        for batch in batches:
            column, packed, shown = batch.column(at), [], []
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in pieces(np.append(0, np.cumsum(lengths)), BLOCK):
                ids, starts = encoder.encode(column.slice(a, b - a))
                raw = ids.astype("<u4").tobytes()
                packed += [raw[4 * i : 4 * j] for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                shown += encoder.decode(ids, starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(shown, pa.binary()).cast(pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, sp_ids binary, sp_text string")
