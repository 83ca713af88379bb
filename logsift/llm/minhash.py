"""Near-duplicate documents by circulant MinHash over word shingles, with exact verification.

Two permutations make the whole signature: the first scatters shingles over the ring of 2**32 places, the second, shifted
along the ring by one place for each coordinate, orders them. Bands of a few coordinates propose links; a link counts only
if the full shingle sets confirm it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, SPACE, broadcast_if_small, materialize, mix64, ngrams, pieces, text_bytes, arrow_map, keyed_hash, run_key, word_spans
from logsift.llm.components import connected_components


#: Longs of one-bit coordinates, and how far the similarity that they estimate may fall short of the limit: at a
#: similarity of 0.8 or 0.85 that is over six standard deviations, less than once in a billion linked pairs, where the
#: bands themselves lose 2 in 10 million and 4 in 100,000.
WORDS, SLACK = 16, 0.12
#: Rounds in which the members of a bucket are compared with one or two of them, before pairs of members are compared.
ROUNDS = 2
#: Shingles of a set that goes with its row to its buckets, where pairs are verified as they meet; larger ones are fetched for each
#: pair. A row of such a set has at most 8 kB, and PROFILES of them are broadcast.
CARRIED, PROFILES = 1000, 20_000


@dataclass(frozen=True)
class Near:
    """shingle: words. percent: least intersection per union. bands of rows coordinates: a pair of similarity s meets in
    a band with probability 1 - (1 - s**rows)**bands, 0.9999998 at s = 0.85 and 0.99996 at s = 0.8."""

    shingle: int = 5
    percent: int = 80
    bands: int = 26
    rows: int = 5


def word_sequences(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits (two rows of longs) that name each text's words in their order, whatever stands between them."""
    inside = ~SPACE[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one blank after each word
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    joined, at = np.where(inside, raw, np.uint8(32))[keep].tobytes(), at[offsets].tolist()
    digests = b"".join(hashlib.blake2b(joined[a:b].strip(b" "), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True))
    return np.frombuffer(digests, np.int64).reshape(-1, 2).T


def named_sets(column: pa.Array, n: int, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct shingle hashes of some texts one after the other, their n + 1 offsets, word_sequences). Words
    are hashed under the key, which shingles' hashes inherit."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets, 1 << 19):
        raw, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, texts = word_spans(raw, at)
        words = keyed_hash(raw, starts, ends, key)
        grams, owners = ngrams(words, texts, n)
        count = np.bincount(texts, minlength=b - a)
        for k in range(1, n):  # the whole sequence, of fewer words than a shingle
            short = np.flatnonzero(count[texts] == k)[::k]
            if len(short):
                value = np.full(len(short), np.uint64(k))
                for j in range(k):
                    value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + words[short + j])
                grams, owners = np.concatenate([grams, value]), np.concatenate([owners, texts[short]])
        order = np.argsort(owners, kind="stable")
        grams, owners = grams[order], owners[order]
        cut = np.searchsorted(owners, np.arange(b - a + 1))
        sets = [np.unique(grams[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        out = np.zeros(b - a + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=out[1:])
        yield a, np.concatenate(sets) if sets else grams, out, word_sequences(raw, at)


def shingle_sets(column: pa.Array, n: int, key: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return ((a, grams, offsets) for a, grams, offsets, _ in named_sets(column, n, key))


def signatures(grams: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash, a row of coordinates for each set; sets must not be empty."""
    out = np.empty((coordinates, len(offsets) - 1), np.uint32)
    for a, b in pieces(offsets, 1 << 15):
        ring = (grams[offsets[a] : offsets[b]] >> np.uint64(32)).astype(np.uint32)  # the first permutation
        x, y, starts = np.empty_like(ring), np.empty_like(ring), offsets[a:b] - offsets[a]
        for k in range(coordinates):  # the second one, shifted by k
            np.add(ring, np.uint32(k), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x85EBCA6B), out=x)
            np.right_shift(x, np.uint32(13), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0xC2B2AE35), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.minimum.reduceat(x, starts, out=out[k, a:b])
    return out.T


def _sketched(docs: DataFrame, p: Near, key: str) -> DataFrame:
    """(id, n, h1, h2, keys): the set's size, 128 bits that name the words, and a key for each band (none for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, grams, offsets, names in named_sets(batch.column(1), p.shingle, key):
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                starts = offsets[:-1][some]
                keys = np.zeros((len(some), p.bands), np.uint64)
                if len(some):
                    signs = signatures(grams, np.append(starts, offsets[-1]), p.bands * p.rows).astype(np.uint64)
                    for band in range(p.bands):
                        met = np.full(len(some), np.uint64(band + 1))
                        for row in range(p.rows):
                            met = mix64(met * np.uint64(0x9E3779B97F4A7C15) + signs[:, band * p.rows + row])
                        keys[:, band] = met
                at = np.zeros(len(n) + 1, np.int32)
                np.cumsum((n > 0) * p.bands, out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(n)), pa.array(n), pa.array(names[0]), pa.array(names[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))],
                    names=["id", "n", "h1", "h2", "keys"],
                )

    return arrow_map(docs, run, "id long, n long, h1 long, h2 long, keys array<long>")


def _full_sets(docs: DataFrame, shingle: int, key: str) -> DataFrame:
    """(id, grams): a row's sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, grams, offsets in shingle_sets(batch.column(1), shingle, key):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(offsets) - 1), lists], names=["id", "grams"])

    return arrow_map(docs, run, "id long, grams array<long>")


def _profiles(texts: DataFrame, ids: DataFrame, shingle: int, key: str) -> DataFrame:
    """(id, size, core, held, s0, s1, ...): the size of an id's set, how many of its shingles another of the ids has too, which
    these are (null if more than CARRIED), and the last bits of WORDS * 64 circulant coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            grams = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits = signatures(grams, offsets - offsets[0], WORDS * 64) & np.uint32(1)
            words = np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=1)).view(np.int64)
            size = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), size, *(pa.array(np.ascontiguousarray(w)) for w in words.T)], names=["id", "size", *(f"s{k}" for k in range(WORDS))])

    sets = materialize(_full_sets(texts.join(broadcast_if_small(ids), "id", "left_semi"), shingle, key))
    each = sets.select("id", F.explode("grams").alias("g"))
    both = each.join(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "g", "left_semi")
    few = materialize(both.groupBy("id").agg(F.count("*").alias("core")))
    short = broadcast_if_small(few.where(F.col("core") <= CARRIED))
    held = both.join(short.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_list("g").alias("held"))  # at most CARRIED
    signed = arrow_map(sets, run, "id long, size long, " + ", ".join(f"s{k} long" for k in range(WORDS)))
    out = signed.join(few, "id", "left").join(held, "id", "left")
    return materialize(out.withColumn("core", F.coalesce("core", F.lit(0))))


def near_duplicates(docs: DataFrame, p: Near | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Words are runs without ASCII white space of the text with A-Z lower-cased; a set has the distinct shingles of
    p.shingle words, or the whole sequence if there are fewer. Rows whose sets reach p.percent are linked; component_id
    is the smallest id reachable, and kept says that it is the row's own.

    Words are hashed under a key of the run, so that texts cannot be made for different words to meet; results do not depend
    on it. Rows of equal words become one node first, so copies are never compared. Then, in each band's bucket, all are
    compared with the member that meets most others in all its buckets: of a text and its edited copies that is the text
    itself. Where a bucket still holds several components, in another round those outside the largest are compared with its
    first member, and all of other components with the first of the rest; a member compared with all others leaves the bucket. Where
    several are still left, each member outside the bucket's largest component is compared with all of other components, but for
    pairs which cannot reach the limit even if they share all shingles that any other of these rows has, and for pairs
    which 1024 one-bit coordinates put far below it (SLACK). No bucket is capped. A row without words (or with a null text) links with nothing. Rows of a null id link with nothing, have a
    null component_id and are kept. Rows of one id count as one document. Extra columns are ignored; an empty table
    gives an empty one.
    """
    p, key = p or Near(), run_key()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = materialize(_sketched(texts, p, key))
    known = sketch.where("id IS NOT NULL AND n > 0")
    nodes = materialize(known.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = materialize(keyed.join(broadcast_if_small(shared), "key").distinct())
    met = materialize(members.groupBy("node").agg(F.sum("m").alias("met")))
    members = materialize(members.select("key", "node").join(broadcast_if_small(met), "node"))

    def compare(asked: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose full sets reach the limit."""
        asked = materialize(asked.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        wanted = materialize(asked.select(F.col("a").alias("id")).unionByName(asked.select(F.col("b").alias("id"))).distinct())
        sets = materialize(_full_sets(texts.join(broadcast_if_small(wanted), "id", "left_semi"), p.shingle, key))
        both = asked.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        both = both.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        common, total = F.size(F.array_intersect("ga", "gb")), F.size("ga") + F.size("gb")
        return both.where(100 * common >= p.percent * (total - common)).select("a", "b")

    def still_open(links: DataFrame, members: DataFrame, done: DataFrame) -> DataFrame:
        """Members, but for those of done (key, b), of buckets that hold several components: (key, node, met, component)."""
        labels = materialize(connected_components(links))
        left = members.join(broadcast_if_small(materialize(done.select("key", F.col("b").alias("node")))), ["key", "node"], "left_anti")
        got = left.join(broadcast_if_small(labels), "node", "left").select("key", "node", "met", F.coalesce("component", "node").alias("component"))
        split = got.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return materialize(got.join(broadcast_if_small(materialize(split.select("key"))), "key", "left_semi"))

    first = materialize(members.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("b")))
    links = materialize(compare(members.join(broadcast_if_small(first), "key").select(F.col("node").alias("a"), "b")))
    open_ = still_open(links, members, first)
    for _ in range(1, ROUNDS):
        if not open_.table_rows:
            break
        each = materialize(open_.groupBy("key", "component").agg(F.count("*").alias("size"), F.max(F.struct("met", "node")).alias("top")))
        order = F.struct("size", "component")
        main = materialize(each.groupBy("key").agg(F.max_by("component", order).alias("of"), F.max_by("top", order)["node"].alias("b")))
        rest = each.join(broadcast_if_small(main).select("key", "of"), "key").where("component <> of")
        rest = materialize(rest.groupBy("key").agg(F.max_by("component", "top").alias("of"), F.max("top")["node"].alias("b")))
        asked = [open_.join(broadcast_if_small(p), "key").where("component <> of").select(F.col("node").alias("a"), "b") for p in (main, rest)]
        links = materialize(links.unionByName(compare(asked[0].unionByName(asked[1]))))
        open_ = still_open(links, open_.drop("component"), main.unionByName(rest))
    if open_.table_rows:
        sizes = open_.groupBy("key", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
        still = materialize(open_.select(F.col("node").alias("id")).distinct())
        keys = nodes.select(F.col("node").alias("id"), "keys").join(broadcast_if_small(still), "id", "left_semi")
        profiles = broadcast_if_small(materialize(_profiles(texts, still, p.shingle, key).join(keys, "id")), PROFILES)
        sized = open_.withColumnRenamed("node", "id").join(profiles, "id").withColumnRenamed("component", "c").drop("met")
        outside = sized.join(broadcast_if_small(materialize(main)), "key").where("c <> main").drop("main")
        a, b = outside.alias("a"), sized.alias("b")
        most = F.least("a.core", "b.core")  # shingles that the two can share
        differ = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(WORDS)), F.lit(0))
        can = 100 * most >= p.percent * (F.col("a.size") + F.col("b.size") - most)
        near = differ <= int(WORDS * 64 * (1 - (p.percent / 100 - SLACK)) / 2)
        before = F.array_position("a.keys", F.col("a.key")).cast("int") - 1
        met = F.exists(F.zip_with(F.slice("a.keys", 1, before), F.slice("b.keys", 1, before), lambda x, y: x == y), lambda x: x)
        first = F.when(before > 0, ~met).otherwise(True)  # a pair is asked in the first bucket that it shares
        carried = F.col("a.held").isNotNull() & F.col("b.held").isNotNull()
        common = F.size(F.array_intersect("a.held", "b.held"))
        linked = F.when(carried, 100 * common >= p.percent * (F.col("a.size") + F.col("b.size") - common)).otherwise(True)
        asks = F.when(can & near, F.when(first, linked).otherwise(False)).otherwise(False)  # in this order
        found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & asks)
        found = materialize(found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), carried.alias("sure")))
        links = links.unionByName(found.where("sure").select("a", "b"))
        if found.where("NOT sure").limit(1).count():
            links = links.unionByName(compare(found.where("NOT sure")))
        links = materialize(links)

    labels = connected_components(links)
    named = nodes.join(labels, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    moved = materialize(named.join(known.groupBy("h1", "h2", "n").agg(F.count("*").alias("rows"), F.min("id").alias("low")), ["h1", "h2", "n"]).where("rows > 1 OR component <> low").drop("rows", "low"))
    linked = (F.col("sketch.n") > 0) & F.col("sketch.id").isNotNull()
    on = [F.col(f"sketch.{c}") == F.col(f"moved.{c}") for c in ("h1", "h2", "n")]
    out = sketch.alias("sketch").join(broadcast_if_small(moved).alias("moved"), on, "left")
    component = F.when(linked, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("sketch.n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
