"""Best-fit packing of documents into token sequences of fixed capacity.

The lengths' histogram (at most ``capacity`` rows, however large the corpus) goes to the driver. There a configuration
linear program is solved by multiplicative weights: a knapsack dynamic program prices the best configuration of lengths
under the present weights, which fall for lengths as they are covered, until all are. The fractions are rounded down; what is left
is packed best fit, longest first, into the room of these sequences and into new ones, on the histogram too. Tokenizing, ranking and placing the pieces run on the executors.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import materialize, pieces, release, same_bytes, text_bytes, arrow_map, word_hash, word_spans

#: Bytes of text tokenized at a time.
BLOCK = 1 << 19
#: Words, and lower-case parts of them, whose tokens a worker remembers (about 50 and 400 bytes each), and how many of
#: the words wait in a dictionary until they are sorted in. Two workers stand beside a JVM that fills its heap; a million words
#: took 65 MB more of each.
MEMO_WORDS, MEMO_PARTS, MEMO_FRESH = 250_000, 50_000, 25_000
#: What a tokenizer has to be so that its ids of a text are those of the text's words: fixed values of its definition.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: A word of Latin letters, and the signs after it; the tokenizer never joins the two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level tokenizers write for each byte: printable bytes as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def by_words(definition: str) -> bool:
    """Whether the tokenizer lower-cases, splits as SPLIT says and knows BPE over bytes: then no token spans white space."""
    d = json.loads(definition)
    norm, pre, model = (d.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in norm.get("normalizers", [])]
    split, signs = [*pre.get("pretokenizers", []), {}, {}][:2]
    return (
        steps == NORMALIZERS and split.get("type") == "Split" and split["pattern"] == {"Regex": SPLIT} and split["invert"]
        and split["behavior"] == "Removed" and signs.get("type") == "ByteLevel" and not signs["add_prefix_space"] and not signs["use_regex"]
        and model.get("type") == "BPE" and not model.get("dropout") and len(pre["pretokenizers"]) == 2 and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"])
    )


class _Grown:
    """An array that is appended to. Room doubles where it ends: an array joined anew for each block of text left holes of
    its size behind, which took as much memory as all words."""

    def __init__(self, first: list, kind: type) -> None:
        self.held, self.n = np.array(first, kind), len(first)

    def add(self, more: np.ndarray) -> None:
        upto = self.n + len(more)
        if upto > len(self.held):
            grown = np.empty(max(upto, 2 * len(self.held)), self.held.dtype)
            grown[: self.n] = self.now
            self.held = grown
        self.held[self.n : upto] = more
        self.n = upto

    @property
    def now(self) -> np.ndarray:
        return self.held[: self.n]


class _Encoder:
    """Token ids of whole texts. With a tokenizer that by_words() accepts, a text's ids are those of its words; these are
    found by a 64-bit hash, compared by their bytes, and each is tokenized once by a worker. Where hashes of different
    words are equal, and with other tokenizers, whole texts are tokenized."""

    held: ClassVar[dict[int, _Encoder]] = {}

    def __init__(self, definition: str, worded: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.signs, self.worded = self.tokenizer.model, _byte_signs(), worded
        self.forget()

    def forget(self) -> None:
        self.known, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and their words' numbers
        self.fresh: dict[int, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.ids, self.starts = _Grown([], np.uint32), _Grown([0], np.int64)
        self.text, self.at = _Grown([], np.uint8), _Grown([0], np.int64)  # the words' bytes

    @classmethod
    def of(cls, definition: str, worded: bool) -> _Encoder:
        key = zlib.crc32(definition.encode())
        if key not in cls.held:
            cls.held[key] = cls(definition, worded)
        return cls.held[key]

    def _part(self, part: str) -> list[int]:
        """Ids of lower-case letters, straight from the BPE model, or of signs."""
        if part.isalpha():
            return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.signs))]
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        parts, out, n = self.parts, [], []
        for word in words:
            ids: list[int] = []
            plain = _PLAIN(word)
            for part in (plain[1].lower(), plain[2]) if plain else (word,):
                if part:
                    got = parts.get(part) if plain else self.tokenizer.encode(part, add_special_tokens=False).ids
                    if got is None:
                        got = parts[part] = self._part(part)
                    ids = ids + got if ids else got
            out += ids
            n.append(len(ids))
        self.ids.add(np.array(out, np.uint32))
        self.starts.add(self.starts.now[-1] + np.cumsum(np.array(n, np.int64)))

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        got = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words that are remembered, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[at] == hashes
            out[hit] = self.index[at[hit]]
        miss = np.flatnonzero(out < 0)
        out[miss] = [self.fresh.get(h, -1) for h in hashes[miss].tolist()]
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if not self.worded:
            return self._plainly(data, offsets)
        starts, ends, texts = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        hashes, first, which = np.unique(word_hash(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        if self.starts.n > MEMO_WORDS:
            self.forget()
        index = self._numbers(hashes)
        old, new = np.flatnonzero(index >= 0), np.flatnonzero(index < 0)
        known = same_bytes(data, a[old], b[old], self.text.now, self.at.now[index[old]], self.at.now[index[old] + 1])
        if not known or not same_bytes(data, starts, ends, data, a[which], b[which]):
            return self._plainly(data, offsets)
        raw, number = data.tobytes(), self.starts.n - 1
        words = [raw[x:y] for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)]
        self._learn([w.decode() for w in words])
        self.text.add(np.frombuffer(b"".join(words), np.uint8))
        self.at.add(self.at.now[-1] + np.cumsum(b[new] - a[new]))
        index[new] = np.arange(number, number + len(new))
        self.fresh.update(zip(hashes[new].tolist(), index[new].tolist(), strict=True))
        if len(self.fresh) > MEMO_FRESH:
            known = np.concatenate([self.known, np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))])
            order = np.argsort(known)
            self.index = np.concatenate([self.index, np.fromiter(self.fresh.values(), np.int32, len(self.fresh))])[order]
            self.known, self.fresh = known[order], {}
        index = index[which]
        starts = self.starts.now
        at, n = starts[index], starts[index + 1] - starts[index]
        upto = np.cumsum(n)
        ids = self.ids.now[np.repeat(at - (upto - n), n) + np.arange(upto[-1])]
        return ids, np.bincount(texts, n, len(offsets) - 1).astype(np.int64)


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece; ``part`` and ``nth``: the task that made it, and its rank among the task's of its length."""
    definition = Path(tokenizer).read_text()
    definition, worded = docs.sparkSession.sparkContext.broadcast(definition), by_words(definition)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _PIECES.format(id=docs.schema["doc_id"].dataType.simpleString())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = _Encoder.of(definition.value, worded), TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for x, y in pieces(offsets, BLOCK):
                ids, n = encode(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                raw, at = ids.astype("<u4").tobytes(), 0
                owner, piece, start, length, crc = [], [], [], [], []
                for row, many in enumerate(n.tolist(), x):
                    own = raw[at : at + 4 * many] + end
                    at += 4 * many
                    for k, a in enumerate(range(0, len(own), 4 * capacity)):
                        cut = own[a : a + 4 * capacity]
                        owner.append(row)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                nth = []
                for many in length:
                    nth.append(counts[many])
                    counts[many] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc)), pa.array([part] * len(length), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )
                release()  # arrays of many sizes come and go; what they leave would add up to the size of the memory of words

    return arrow_map(docs, run, schema)


#: How far below the best price a configuration may be, and the part of a length's copies that a step covers at most.
SLACK, STEP = 0.02, 0.5
#: Room that a configuration may leave to be rounded down; those that leave more are rounded to 0, since best fit can do better.
ROOM = 0


def _prices(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The value of the best multiset of lengths for each room: unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for w in range(int(lengths[0]), capacity + 1):
        best[w] = max(best[w - 1], (best[w - lengths[: upto[w]]] + values[: upto[w]]).max())
    return best


def _filled(lengths: np.ndarray, values: np.ndarray, best: np.ndarray, seed: int, worst: float, covered: np.ndarray) -> dict[int, int]:
    """A multiset (index: copies) with the length ``seed``, of lengths still to be covered, worth ``worst`` at least; the least
    covered ones that the prices allow come first. Empty, if none is found."""
    out, w, got = {seed: 1}, len(best) - 1 - int(lengths[seed]), float(values[seed])
    while n := int(np.searchsorted(lengths, w, "right")):
        able = np.flatnonzero((got + values[:n] + best[w - lengths[:n]] >= worst) & (covered[:n] < 1) & (values[:n] > 0))
        if not len(able):
            break
        k = int(able[covered[able] == covered[able].min()][-1])
        out[k] = out.get(k, 0) + 1
        w, got = w - int(lengths[k]), got + float(values[k])
    return out if got >= worst else {}


def fractions(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """The configuration linear program, by multiplicative weights: how many sequences of each configuration ((index, copies), ...)
    cover all lengths. A length's weight falls with its cover and is 0 when that is whole. In a round one knapsack table
    prices a configuration around each length; those of about the best price are taken, until every length is covered."""
    covered, chosen = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        values = np.where(covered < 1, lengths * np.exp(-3 * covered), 0.0)
        if not values.any():
            break
        best = _prices(lengths, values, capacity)
        worst = (1 - SLACK) * float(best[-1])
        near = np.flatnonzero((values > 0) & (values + best[capacity - lengths] >= worst))
        for i in near[np.lexsort((-lengths[near], covered[near]))].tolist():
            config = _filled(lengths, values, best, i, worst, covered) if covered[i] < 1 else {}
            if not config:
                continue
            k, a = np.array(list(config)), np.array(list(config.values()))
            step = float((np.minimum(STEP, 1 - covered[k]) * counts[k] / a).min())
            covered[k] += a * step / counts[k]
            covered[k[covered[k] > 1 - 1e-9]] = 1.0
            key = tuple(sorted(config.items()))
            chosen[key] = chosen.get(key, 0.0) + step
    return chosen


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, copies), ...]) whose copies add up to counts; lengths ascend, all from 1 to capacity."""
    left = counts.astype(np.int64).copy()
    bins: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # by room left: (sequences, contents)
    open_at = np.zeros(capacity + 1, bool)

    def put(room: int, n: int, contents: tuple) -> None:
        if n:
            bins[room].append((n, contents))
            open_at[room] = True

    for config, x in fractions(lengths, counts, capacity, rounds).items() if len(lengths) else ():
        room = capacity - sum(int(lengths[k]) * a for k, a in config)
        if room > ROOM:
            continue
        n = min(int(x + 1e-6), *[int(left[k]) // a for k, a in config])
        put(room, n, tuple((int(lengths[k]), a) for k, a in config))
        for k, a in config:
            left[k] -= n * a

    for n, length in zip(left[::-1].tolist(), lengths[::-1].tolist(), strict=True):
        while n:
            room = length + int(open_at[length:].argmax())
            have, contents = bins[room].pop() if open_at[room] else (n, ())
            if not contents:
                room = capacity
            else:
                open_at[room] = bool(bins[room])
            each = room // length
            full = min(have, n // each)
            put(room - each * length, full, (*contents, (length, each)))
            n -= full * each
            have -= full
            if n and have and n < each:
                put(room - n * length, 1, (*contents, (length, n)))
                n, have = 0, have - 1
            if contents:
                put(room, have, contents)
    return [(n, list(contents)) for at in bins for n, contents in at]


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, rounds: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs the token ids of every text, each followed by end_id, into sequences of at most capacity tokens.

    Returns a row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset); offsets of a sequence
    run from 0 without gaps. Texts of more than capacity ids are cut into pieces of capacity, the last may be shorter.
    A null or empty text has end_id alone. Repeated rows and null ids are packed like others; other columns are
    ignored; an empty table gives an empty one. rounds: of the multiplicative weights.
    """
    spark = docs.sparkSession
    made = materialize(tokenized(docs, tokenizer, capacity, end_id, id_col, text_col))
    dealt = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = dealt.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # capacity rows at most
    lengths, counts = (np.array([r[k] for r in histogram], np.int64) for k in ("length", "n"))

    slots, first = [], 0
    for n, contents in configurations(lengths, counts, capacity, rounds):
        at = 0
        for length, copies in contents:
            slots.append((length, n * copies, copies, first, at))
            at += length * copies
        first += n
    slots.sort(key=lambda s: s[0])
    table = np.array(slots, np.int64).reshape(-1, 5).T
    before = np.cumsum(table[1]) - table[1]  # ranks of all lengths in a row: those of a length begin at starts[length]
    starts = np.zeros(capacity + 2, np.int64)
    starts[1:] = np.cumsum(np.bincount(lengths, counts, capacity + 1).astype(np.int64))
    placed = spark.sparkContext.broadcast((before, table[2], table[3], table[4], starts))

    rows = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.select("part", "length", F.coalesce(F.sum("n").over(rows), F.lit(0)).alias("ahead"))
    ranked = made.join(ahead, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, copies, first, at, starts = placed.value
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            rank = rank + starts[length]
            k = np.searchsorted(before, rank, "right") - 1
            inside = rank - before[k]
            sequence, offset = first[k] + inside // copies[k], at[k] + inside % copies[k] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    out = [f for f in ranked.schema.fields if f.name != "rank"]
    return arrow_map(ranked, place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
