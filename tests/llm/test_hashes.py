"""Strings on which sums of powers modulo 2**64 cancel out, whatever the base: equal hashes must not decide alone."""

import zlib

import numpy as np

from logsift.llm import common, minhash, packing, quality_rules, suffix_dedup
from logsift.llm.queries import tokenizer_file


def thue_morse(n, one="a", other="b"):
    return "".join(one if i.bit_count() % 2 == 0 else other for i in range(n))


A, B = thue_morse(1024), thue_morse(1024, "b", "a")


def test_word_hash_parts_them_and_does_not_depend_on_place():
    data = np.frombuffer((A + " " + B + " " + A).encode(), np.uint8)
    h = common.word_hash(data, np.array([0, 1025, 2050]), np.array([1024, 2049, 3074]))
    assert h[0] == h[2] != h[1]
    for n in (1, 7, 8, 9, 16, 63, 64, 65):
        data = np.frombuffer(("x" + A[:n] + A[:n] + B[:n]).encode(), np.uint8)
        at = np.array([1, 1 + n, 1 + 2 * n])
        h = common.word_hash(data, at, at + n)
        assert h[0] == h[1] != h[2]
        assert common.same_bytes(data, at[:1], at[:1] + n, data, at[1:2], at[1:2] + n)
        assert not common.same_bytes(data, at[:1], at[:1] + n, data, at[2:], at[2:] + n)


def test_pack_gives_the_ids_of_the_tokenizer(spark, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    texts = [f"{A} {B}", f"{B} one {A}", "one two one"]
    want = [zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["ids_crc32"] for r in packing.pack(docs, tokenizer_file()).orderBy("doc_id").collect()] == want
    encode = packing._Encoder(open(tokenizer_file()).read(), True)
    monkeypatch.setattr(packing, "word_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))  # all words collide
    for _ in range(2):
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            ids, n = encode(data, np.array([0, len(data)]))
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def test_other_tokenizers_are_asked_for_whole_texts():
    definition = open(tokenizer_file("byte_bpe_50k.json")).read()
    encode, text = packing._Encoder(definition, packing.by_words(definition)), "Two words,  and\nmore 123"
    assert packing.by_words(open(tokenizer_file()).read()) and not packing.by_words(definition)
    data = np.frombuffer(text.encode(), np.uint8)
    assert encode(data, np.array([0, len(data)]))[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_near_duplicates_links_equal_words_only(spark):
    docs = spark.createDataFrame([(1, f"{A} x y"), (2, f"{B} x y"), (3, f" {A}\n x\ty ")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, minhash.Near(shingle=3, percent=85)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_judge_counts_equal_lines_only(spark):
    docs = spark.createDataFrame([(1, f"{A}\n{B}"), (2, f"{A}\n{A}")], "doc_id long, text string")
    model = quality_rules.Model(None, 1.0, 0.0, quality_rules.Settings())
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.judge(docs, model).collect()} == {1: 0, 2: 1}


def test_remove_repeats_removes_equal_bytes_only(spark):
    docs = spark.createDataFrame([(1, A), (2, B), (3, "z" * 10)], "doc_id long, text string")
    windows = [t[i : i + 400] for t in (A, B) for i in range(625)]
    twice = {w for w in windows if windows.count(w) > 1}
    want = {}
    for k, t in enumerate((A, B), 1):
        gone = {j for i in range(625) if t[i : i + 400] in twice for j in range(i, i + 400)}
        want[k] = len(gone)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == want | {3: 0}


def test_many_short_rows_are_a_bounded_block():
    import pyarrow as pa

    from logsift.llm import features

    sizes = [len(o) - 1 for _, _, o in features.blocks(pa.array(["abc"] * 5000 + [None] * 300))]
    assert max(sizes) == features.BLOCK_ROWS and sum(sizes) == 5300


#: Two words with equal word_hash(), found by undoing its mixing of eight bytes.
MET = ("rs18bf38zzzzzzzz", 'frdx3rn4,"3!7t{m')


def test_words_made_to_meet_are_told_apart(spark):
    data = np.frombuffer(" ".join(MET).encode(), np.uint8)
    at = np.array([0, 17]), np.array([16, 33])
    assert len(set(common.word_hash(data, *at))) == 1 and len(set(common.keyed_hash(data, *at, common.run_key()))) == 2
    one, other = (" ".join([w, *"abc", w, *"def", w, *"ghi", w, *"jkl"]) for w in MET)
    docs = spark.createDataFrame([(1, one), (2, other), (3, one.upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, minhash.Near(shingle=3, percent=85)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    model = quality_rules.Model(None, 1.0, 0.0, quality_rules.Settings())
    tail = " a b c d e f g"
    docs = spark.createDataFrame([(1, f"{MET[0]}{tail}\n{MET[1]}{tail}"), (2, f"{MET[0]}{tail}\n{MET[0]}{tail}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(docs, model).collect()}
    assert got == {1: (0, 0), 2: (1, 16)}


def test_spans_are_numbered_by_their_bytes():
    text = "xx yy  xx\nz yy x".encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, _ = common.word_spans(data, offsets)
    which, held = common.numbered(data, starts, ends)
    assert [held[i].as_py() for i in which.tolist()] == text.split()
    assert len(common.keyed_hash(data, starts[:0], ends[:0], common.run_key())) == 0
