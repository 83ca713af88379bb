"""Fuzzy line dedup by MinHash over character shingles. DataFrame functions only."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import broadcast_if_small, discard, materialize
from logsift.llm.components import connected_components, near_labels

#: Characters of a shingle, and bytes of each: lines are encoded in UTF-32, where the i-th character is found at once.
LENGTH, WIDE = 9, 4
#: Shingles of a row where signatures are made: rows and lookups of their lines cost more than the shingles.
STEP = 32
#: White space around a line that does not count.
BLANKS = " \t\r\f\x0b"
#: Least intersection per union, in percent. A pair at the limit would share a band with probability 1 - (1 - 0.8**ROWS)**BANDS,
#: 0.997, if coordinates were independent; with the permutations below it was measured 0.983 to 0.993 for 10 to 80 shingles, 0.997 for 160.
PERCENT, BANDS, ROWS = 80, 8, 3
#: Rounds in which the members of a bucket are compared with one of them, before pairs are sought by rare shingles.
ROUNDS = 3
#: Bits of a shingle's hash that name it among open lines, below its frequency; more frequent ones than fit count as equally frequent.
#: Every byte of a name is shuffled for each shingle of each open line.
NAME_BITS = 40
#: First bits of least hashes that are shuffled: equal hashes stay equal, others that meet only make more lines be compared.
SIGNED_BITS = 24
#: Rarer shingles of a line that go with each of its rare ones, so that a pair is mostly asked for once; all of them took most of that shuffle.
RARER = 4
#: Documents whose lists of dropped lines are broadcast.
LIST_ROWS = 200_000
#: A permutation of hashes for each coordinate: exclusive or with a random number.
_RANDOM = random.Random(20240229)
PERMUTED = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(BANDS * ROWS)]


def _encoded(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def _places(encoded: Column) -> Column:
    """First bytes of all shingles; a shorter line is its only shingle."""
    return F.sequence(F.lit(1), F.greatest(F.length(encoded) - (LENGTH * WIDE - 1), F.lit(1)), F.lit(WIDE))


def _shingle(encoded: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(encoded, place, F.lit(LENGTH * WIDE)))


def dense(line: Column) -> Column:
    """Hashes of the shingles at every character."""
    return F.element_at(F.transform(F.array(_encoded(line)), lambda e: F.transform(_places(e), lambda i: _shingle(e, i))), 1)


def _lines(texts: DataFrame) -> DataFrame:
    """(id, uid, pos, norm, l1, l2): lines with a word, as they are compared; l1 and l2 name the content."""
    out = texts.select("id", "uid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    out = out.where(F.ltrim("line", F.lit(BLANKS)) != "")  # stops at the first character that counts
    padded = reduce(Column.__or__, [test(c) for c in BLANKS for test in (line.startswith, line.endswith)])
    out = out.withColumn("norm", F.lower(F.when(padded, F.btrim("line", F.lit(BLANKS))).otherwise(line))).drop("line")
    return out.withColumns({"l1": F.xxhash64("norm"), "l2": F.xxhash64(F.lit("line"), "norm")})


def _signed(lines: DataFrame) -> DataFrame:
    """(l1, keys): a key for each band of each distinct line. Shingles become rows of STEP, the last one repeated where
    they end, that are reduced to their least hashes in the task that reads the text; texts and shingles are not shuffled.
    Lines that share l1 with another one are left out."""
    rows = lines.select("l1", "l2", _encoded(F.col("norm")).alias("e"))
    rows = rows.select("l1", "l2", "e", F.greatest(F.length("e") - (LENGTH * WIDE - 1), F.lit(1)).alias("z"))
    rows = rows.select("l1", "l2", "e", "z", F.explode(F.sequence(F.lit(1), F.col("z"), F.lit(WIDE * STEP))).alias("i"))
    cut = 64 - SIGNED_BITS
    rows = rows.select("l1", "l2", *[F.shiftright(_shingle(F.col("e"), F.least(F.col("i") + WIDE * j, F.col("z"))), cut).alias(f"h{j}") for j in range(STEP)])
    mixed = [F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(c >> cut)) for j in range(STEP)]) for c in PERMUTED]
    least = rows.groupBy("l1", "l2").agg(*[F.min(m).alias(f"m{k}") for k, m in enumerate(mixed)])
    return least.select("l1", F.array(*[F.xxhash64(F.lit(j), *[F.col(f"m{ROWS * j + r}") for r in range(ROWS)]) for j in range(BANDS)]).alias("keys"))


def _verified(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of line names whose full shingle sets reach the limit. Texts are shuffled, not their larger sets,
    and of the second lines, few beside the first ones, only those that pairs name; pairs whose sets differ too much in size to reach it need no comparison."""
    asked = materialize(asked.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = broadcast_if_small(asked)
    firsts = sets.select(F.col("l1").alias("a"), F.col("n").alias("na"), F.col("norm").alias("ta"))
    seconds = sets.select(F.col("l1").alias("b"), F.col("n").alias("nb"), F.col("norm").alias("tb")).join(pairs.select("b"), "b", "left_semi")
    both = firsts.join(pairs, "a").join(seconds, "b")
    both = both.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    common = F.size(F.array_intersect(dense(F.col("ta")), dense(F.col("tb"))))
    out = materialize(both.where((100 + PERCENT) * common >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b"))
    discard(asked)
    return out


def _rarest(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """open_ with n, the size of a line's set, core, how many of it others have too, and rare, its rarest of those, as
    numbers in the order of their frequency. Two lines whose sets reach the limit have one of these in common: fewer than the
    rest could not hold what they share. Shingles of one number only make more pairs be compared."""
    held = sets.join(broadcast_if_small(open_).select("l1"), "l1", "left_semi").select("l1", "n", F.explode(F.array_distinct(dense(F.col("norm")))).alias("g"))
    held = held.withColumn("g", F.col("g").bitwiseAND(F.lit((1 << NAME_BITS) - 1)))
    many = held.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    often = F.shiftleft(F.least("df", F.lit((1 << (63 - NAME_BITS)) - 1)), NAME_BITS)
    ranked = held.join(many, "g").groupBy("l1", "n").agg(F.count("*").alias("core"), F.sort_array(F.collect_list(often.bitwiseOR(F.col("g")))).alias("r"))  # a line's shingles
    own = F.col("n") - F.col("core")
    first = F.slice("r", 1, F.greatest(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - own, F.lit(0)).cast("int"))
    return open_.join(ranked.select("l1", "n", "core", first.alias("rare")), "l1")


def _asked(ranked: DataFrame) -> DataFrame:
    """(l1, c, n, core, pos, key, main, rarer): the rare shingles of ranked lines that lines of several components have, a row each, with
    the largest of these components, and the first RARER of the line's own such shingles that are rarer still. A table to be discarded."""
    keyed = ranked.select("l1", "c", "n", "core", F.posexplode("rare").alias("pos", "key"))
    main = keyed.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("components"))
    main = materialize(main.where("components > 1").drop("components"))
    line = Window.partitionBy("l1").orderBy("pos")  # a line's shingles
    first = F.when(F.row_number().over(line) <= RARER, F.col("key"))
    rows = keyed.join(broadcast_if_small(main), "key").withColumn("first", first)
    out = materialize(rows.withColumn("rarer", F.collect_list("first").over(line.rowsBetween(Window.unboundedPreceding, -1))).drop("first"))
    discard(main)
    return out


def _links(signed: DataFrame, lines: DataFrame) -> DataFrame:
    """Verified links between different lines. Each bucket's lines are compared with the one of them that meets most lines
    in all its buckets: of a line and its edited copies that is the line itself. Where that leaves several components, those
    outside the largest are compared with its first, and all of other components with the first of the rest, for some rounds; a
    line that was compared with all others of a bucket leaves it.
    Of the lines in buckets which still hold several, those that share a rare shingle are compared: each one outside the largest component that has the shingle with all of other components that
    can reach the limit at all, in the first shingle that they share and now and then in a later one. signed is discarded when it was read."""
    keyed = signed.select("l1", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = materialize(keyed.join(broadcast_if_small(shared), "key"))
    discard(signed)
    met = materialize(members.groupBy("l1").agg(F.sum("m").alias("met")))
    members = materialize(members.select("key", "l1").join(broadcast_if_small(met), "l1"))
    found = lines.select("l1", "l2", "norm").join(broadcast_if_small(met).select("l1"), "l1", "left_semi")
    found = found.groupBy("l1").agg(F.first("norm").alias("norm"), F.min("l2").alias("x"), F.max("l2").alias("y")).where("x = y")
    sets = materialize(found.select("l1", F.size(F.array_distinct(dense(F.col("norm")))).alias("n"), "norm"))
    first = materialize(members.groupBy("key").agg(F.max_by("l1", F.struct("met", "l1")).alias("b")))
    links = _verified(members.join(broadcast_if_small(first), "key").select(F.col("l1").alias("a"), "b"), sets)

    def still_open(links: DataFrame, members: DataFrame, done: DataFrame, last: bool) -> DataFrame:
        """Members, but for those of done (key, b), of buckets that hold several components without these: (key, l1, met, c).
        Only at last are the components whole; before, some pairs of one component may be asked again."""
        done = materialize(done.select("key", F.col("b").alias("l1")))
        labels = materialize(connected_components(links)) if last else near_labels(links)
        members = members.join(broadcast_if_small(done), ["key", "l1"], "left_anti")
        got = members.join(broadcast_if_small(labels).withColumnRenamed("node", "l1"), "l1", "left")
        got = got.select("key", "l1", "met", F.coalesce("component", "l1").alias("c"))
        split = materialize(got.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key"))
        out = materialize(got.join(broadcast_if_small(split), "key", "left_semi"))
        discard(done, labels, split)
        return out

    open_ = still_open(links, members, first, False)
    discard(shared, members, met, first)
    for k in range(2, ROUNDS + 1):
        if not open_.table_rows:
            return links
        each = open_.groupBy("key", "c").agg(F.count("*").alias("size"), F.max(F.struct("met", "l1")).alias("top"))
        each, order = materialize(each), F.struct("size", "c")
        pivots = each.groupBy("key").agg(F.max_by("c", order).alias("of"), F.max_by("top", order)["l1"].alias("b")).select("key", "of", "b")
        main = materialize(pivots)
        rest = each.join(broadcast_if_small(main).select("key", "of"), "key").where("c <> of")
        rest = materialize(rest.groupBy("key").agg(F.max_by("c", "top").alias("of"), F.max("top")["l1"].alias("b")))
        asked = [open_.join(broadcast_if_small(p), "key").where("c <> of").select(F.col("l1").alias("a"), "b") for p in (main, rest)]
        links = materialize(links.unionByName(_verified(asked[0].unionByName(asked[1]), sets)))
        before, open_ = open_, still_open(links, open_.drop("c"), main.unionByName(rest), k == ROUNDS)
        discard(before, each, main, rest)
    if not open_.table_rows:
        return links
    names = materialize(open_.select("l1", "c").distinct())
    ranked = materialize(_rarest(names, sets))
    rows = _asked(ranked)
    a, b = rows.where("c <> main").alias("a"), rows.alias("b")
    # in the order of their frequency, two sets share nothing before the first shingle that they share
    most = F.least(F.col("a.core") - F.col("a.pos"), F.col("b.core") - F.col("b.pos"))
    once = (F.col("b.c") == F.col("b.main")) | (F.col("a.l1") < F.col("b.l1"))
    apart = once & (F.col("a.c") != F.col("b.c")) & (100 * most >= PERCENT * (F.col("a.n") + F.col("b.n") - most))
    asked = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & ~F.arrays_overlap("a.rarer", "b.rarer")).select(F.col("a.l1").alias("a"), F.col("b.l1").alias("b"))
    more = _verified(asked, sets)
    discard(open_, names, ranked, rows, sets)
    return links.unionByName(more)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each line dropped that is equal or near to another one which stays; adds n_lines and n_dropped.

    Lines are parts between newlines; they are compared without regard to case and outer white space. Equal
    lines are one node; different ones are linked if their sets of LENGTH-character shingles reach PERCENT; of each connected
    component the occurrence with the smallest (id, text hash, position) stays, null ids last. Lines without a word always stay. Rows of
    equal id and text keep the same lines. A null text stays null and has no lines; a text that loses all its lines is
    empty. All rows and other columns stay, columns of those names are replaced; an empty table gives an empty one.
    """
    mine = ["n_lines", "n_dropped"]
    rest = [c for c in docs.columns if c not in mine]
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("uid"), F.col(text_col).alias("text"))
    lines = _lines(texts)
    spots = materialize(lines.select("l1", "l2", F.col("id").isNull().alias("no"), "id", "uid", "pos"))

    signed = materialize(_signed(lines))
    labels = materialize(connected_components(_links(signed, lines)))
    labels = broadcast_if_small(labels).withColumnRenamed("node", "l1")
    place = F.struct("no", "id", "uid", "pos")
    first = spots.groupBy("l1", "l2").agg(F.min(place).alias("at"), F.count("*").alias("n")).join(labels, "l1", "left")
    first = materialize(first.where("n > 1 OR component IS NOT NULL"))
    kept = first.where("component IS NOT NULL").groupBy("component").agg(F.min("at").alias("owner"))
    owners = first.where("component IS NOT NULL").join(kept, "component").select("l1", "l2", "owner")
    owners = owners.unionByName(first.where("component IS NULL").select("l1", "l2", F.col("at").alias("owner")))
    owners = broadcast_if_small(materialize(owners.select("l1", "l2", *[F.col(f"owner.{c}").alias(f"o_{c}") for c in ("id", "uid", "pos")])))
    stays = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("uid") == F.col("o_uid")) & (F.col("pos") == F.col("o_pos"))
    dropped = spots.join(owners, ["l1", "l2"]).where(~stays).groupBy("id", "uid").agg(F.collect_set("pos").alias("_drop"))
    dropped = materialize(dropped.withColumnsRenamed({"id": "_id", "uid": "_uid"}))

    parts = F.split(text_col, "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_drop")), lambda i: F.col("_parts")[i])
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_uid"))
    out = docs.select(*rest).withColumn("_parts", parts).join(broadcast_if_small(dropped, LIST_ROWS), on, "left")
    text = F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in rest],
        F.coalesce(F.size("_parts"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )
