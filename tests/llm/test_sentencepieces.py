"""Ids and decoded texts against the sentencepiece library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import queries
from logsift.llm.sentencepieces import Encoder, encode_and_decode, remerge, vocabulary

ODD = [
    "", " ", "  ", "   a", "\t\n", "▁x ▁▁ y", "Ａ①é", "a\x00b", "<s></s><unk><0x0A>", "𝒳🙂" * 5, "é �", "a ", "日本語テキスト 漢字", "...!!!???----====",
    "0" * 77, " " * 500, "ab" * 1000, "zqxj" * 50, "́", "x▁", "\n\n\n", "ﬁ", "é",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary(queries.tokenizer_file("piece_bpe_32k.model")))


def test_ids_and_texts_are_the_librarys(encoder, library):
    rng = random.Random(1)
    pieces = list(encoder.v.order)
    texts = [*ODD, None, *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(1500))]
    texts += ["".join(rng.choices(a, k=rng.randint(1, 40))) for a in ("abcdeinorst ", "▁ aeth=-*", "\n\t ab", "été ▁", "日本の a") for _ in range(600)]
    ids, starts = encoder.encode(pa.array(texts))
    shown = encoder.decode(ids, starts)
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    for k, w in enumerate(want):
        assert ids[starts[k] : starts[k + 1]].tolist() == w, texts[k]
        assert shown[k].decode() == library.decode(w)


def test_decoding_of_any_ids(encoder, library):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 0, 1, 2, 259, 28705]) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(np.array(ids, np.uint32), np.array([0, len(ids)]))[0].decode() == library.decode(ids), ids


def test_backtracking_agrees_with_merging(encoder):
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices("thernation▁", k=rng.randint(1, 30)))
        assert encoder.symbols(text) == remerge(text, encoder.v.order)


def test_rows_stay_with_their_columns(make, library):
    rows = [(1, None), (2, ""), (3, "long " * 30_000), (4, "x" * 100_000), (5, "same"), (5, "same"), (None, "no id")]
    docs = make(rows).withColumnRenamed("score", "sp_ids")
    got = encode_and_decode(docs, vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))).collect()
    assert len(got) == len(rows) and all(r["kept"] == 7 for r in got)
    found = sorted((str(r["doc_id"]), bytes(r["sp_ids"]), r["sp_text"]) for r in got)
    want = [(str(k), np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes(), t or "") for k, t in rows]
    assert found == sorted(want)
    assert encode_and_decode(make([]), vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        vocabulary(str(tmp_path / "m.model"))


def test_query_on_all_documents(spark, library):
    import hashlib
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        digests = [hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        assert got[r["doc_id"]] == (len(ids), *digests)
