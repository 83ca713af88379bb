import random
import tracemalloc

import numpy as np
import pytest

from logsift.llm import features
from logsift.llm import language_id as li

WORDS = {"en": "the and of with house time", "fr": "le que été même où château", "de": "und nicht für über straße zeit", "xx": "zq qz zzq qqz zqz qzq"}


def sentence(rng, lang, n=25):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_learns_and_leaves_texts_without_letters(make):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang), lang) for i, lang in enumerate(list(WORDS) * 40)] + [(900, "unlabelled", None), (901, None, "en")]
    model = li.learn(make(rows).withColumnRenamed("doc_id", "id"))
    odd = [None, "", "123 !!! 456", "漢字", "ß", "the " * 20_000]
    new = [(i, sentence(rng, lang), None) for i, lang in enumerate(list(WORDS) * 10)] + [(500 + k, t, None) for k, t in enumerate(odd)] + [(0, sentence(rng, "en"), None)]
    got = li.identify(make(new).drop("score"), model).collect()
    assert len(got) == len(new)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"], r["ambiguous"]) for r in got if r["doc_id"] > 0}
    assert np.mean([pred[i][0] == list(WORDS)[i % 4] for i in range(1, 40)]) > 0.95
    assert pred[500] == pred[501] == pred[502] == ("und", 0.0, True)
    assert pred[503][0] in WORDS and pred[504][0] in WORDS and pred[505][0] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_clashing_columns_are_replaced(make):
    model = li.learn(make([(1, "aaa", "en"), (2, "bbb", "fr")]).withColumnRenamed("doc_id", "id"))
    got = li.identify(make([(1, "aaa")]), model)
    assert got.columns.count("score") == 1 and got.first()["kept"] == 7


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_too_few_languages(make, langs):
    model = li.learn(make([(i, "some text", lang) for i, lang in enumerate(langs)]).withColumnRenamed("doc_id", "id"))
    row = li.identify(make([(1, "text")]), model).first()
    assert (row["lang_pred"], row["score"]) == (("en", 1.0) if langs else ("und", 0.0))
    assert li.identify(make([]), model).count() == 0


@pytest.mark.parametrize("n", [2, 4, 6, 7, 30])
def test_codewords_are_apart_and_bits_split(n):
    code = li.codewords(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1
    assert (np.abs(code.sum(0)) < n).all()


@pytest.mark.parametrize("n", [2, 3, 7, 12])
def test_decoding_finds_the_nearest_codeword(n):
    rng = np.random.default_rng(n)
    codes = li.codewords(n)
    trust = rng.uniform(0.01, 1, codes.shape[1])
    margin = rng.normal(0, 3, (200, codes.shape[1]))
    model = li.Model(tuple(f"l{k:02}" for k in range(n)), codes, np.zeros((1, 1)), trust, li.Settings())
    best, p, doubt = li.decode(model, margin)
    for row, k, q, d in zip(margin, best, p, doubt, strict=True):
        loss = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(row, code, trust, strict=True)) / sum(trust) * 8 for code in codes]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        first, second = sorted(share)[:-3:-1]
        assert k == np.argmin(loss) and q == pytest.approx(first) and d == (first - second < model.settings.apart)


def test_many_languages(make):
    rng = random.Random(3)
    words = {f"l{k}": [f"{chr(97 + k)}{chr(97 + (k * 5 + j) % 26)}{chr(98 + k)}" for j in range(6)] for k in range(9)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    model = li.learn(make([(i, text(lang), lang) for i, lang in enumerate(list(words) * 30)]).withColumnRenamed("doc_id", "id"))
    got = li.identify(make([(i, text(lang), None) for i, lang in enumerate(list(words) * 10)]), model).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 9}" for r in got]) > 0.95


def test_features_of_a_block_hold_grams_of_one_length_at_a_time():
    import tracemalloc

    from logsift.llm.features import BLOCK, LETTERS, byte_grams, counted
    from logsift.llm.language_id import _features

    data = np.random.default_rng(3).integers(32, 123, BLOCK).astype(np.uint8)
    offsets = np.linspace(0, BLOCK, 257).astype(np.int64)
    tracemalloc.start()
    got = _features(data, offsets, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    grams = [byte_grams(LETTERS[data], offsets, n) for n in (1, 2, 3)]
    assert np.array_equal(got, counted(np.concatenate([g for g, _ in grams]), np.concatenate([t for _, t in grams]), 256, 4096))


def test_fit_holds_one_wide_copy_of_the_sample():
    rng = np.random.default_rng(3)
    x, y = rng.random((3000, 1024)).astype(np.float16), np.where(rng.random((3000, 3)) < 0.5, -1, 1)
    tracemalloc.start()
    w = features.logistic(x, y, np.ones_like(y, float), steps=2)
    features.margins_of_sample(x, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.3 * x.size * 4
    assert np.allclose(features.margins_of_sample(x, w), features.margins(x.astype(np.float32), w), atol=1e-4)
