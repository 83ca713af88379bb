"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import arrow_map, release
from logsift.llm.features import LETTERS, blocks, byte_grams, hashed_share, logistic, margins, margins_of_sample, tally, unit, vectors

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """sample: labelled texts of each language that are learned from, about (the bound of what the driver holds).
    buckets: of hashed 1- to 3-grams. A prediction is ambiguous if the best two languages' probabilities differ by less
    than apart."""

    sample: int = 800
    buckets: int = 4096
    apart: float = 0.1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # (languages, bits) of -1 and 1
    weights: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    settings: Settings


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages: all distinct splits for up to 6, else random ones chosen for distance."""
    if n <= 6:
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for i in range(n)])
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, 10 * (n - 1).bit_length()))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > most:
            best, most = code, apart
    return best


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Grams of each length are counted before the next are made, so that only one length's are held."""
    letters, rows = LETTERS[data], len(offsets) - 1
    counts = np.zeros((rows, buckets), np.int64)
    for n in (1, 2, 3):
        counts += tally(*byte_grams(letters, offsets, n), rows, buckets)
    return unit(counts)


def learn(docs: DataFrame, settings: Settings | None = None) -> Model:
    """docs: (id, text, lang); other columns are ignored. Rows with a null language or text are left out, empty texts teach
    nothing but count; with fewer than two languages there are no bits to learn."""
    s = settings or Settings()
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((1, 0)), np.zeros(0), s)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, s.sample / n))])[F.col("lang")]
    x, y = vectors(docs.where(hashed_share(F.col("id"), share, "language")), lambda d, o: _features(d, o, s.buckets), "lang")
    codes = codewords(len(languages))
    place = np.array([languages.index(lang) for lang in y])
    target = codes[place]
    weight = (1 / np.bincount(place, minlength=len(languages)).clip(1))[place][:, None] * np.ones_like(target)
    w = logistic(x, target, weight)
    right = (np.sign(margins_of_sample(x, w)) == target).mean(0)
    del x
    release()
    return Model(languages, codes, w, np.clip(2 * right - 1, 0.01, 1), s)


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by logistic loss weighted with each bit's trust: (language, its probability, ambiguous)."""
    loss = np.logaddexp(0, -margin[:, None, :] * model.codes[None]) * model.trust
    loss = loss.sum(2) / model.trust.sum() * 8
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    order = np.argsort(p, 1)
    first, second = (np.take_along_axis(p, order[:, k : k + 1], 1)[:, 0] for k in (len(model.codes) - 1, len(model.codes) - 2))
    return order[:, -1], first, first - second < model.settings.apart


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        part = data[a:b]
        low = part | 32
        out[k] = bool(((low >= 97) & (low <= 122)).any()) or bool((part >= 128).any()) and any(map(str.isalpha, part.tobytes().decode()))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous, from the text alone.

    A null text or one without a letter is ``und`` with score 0, and ambiguous; so is every text if no language was
    learned. All rows and other columns stay, columns of those names are replaced; an empty table gives an empty one.
    """
    added = ["lang_pred", "score", "ambiguous"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    at = docs.columns.index(text_col)
    names_out = [*docs.columns, *added]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            names, scores, doubts = [], [], []
            for _, data, offsets in blocks(batch.column(at)):
                some = _has_letter(data, offsets) & (len(model.languages) > 0)
                if len(model.languages) > 1:
                    best, score, doubt = decode(model, margins(_features(data, offsets, model.settings.buckets), model.weights))
                else:
                    best, score, doubt = np.zeros(len(some), int), np.ones(len(some)), np.zeros(len(some), bool)
                names += [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, some, strict=True)]
                scores.append(np.where(some, score, 0.0))
                doubts.append(doubt | ~some)
                release()
            more = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(doubts) if doubts else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names_out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, lang_pred string, score double, ambiguous boolean")
