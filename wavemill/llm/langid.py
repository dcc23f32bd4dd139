"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest ridge regression.

A text's features are which hashed n-grams of code points, of several lengths at once, are present in it. Its kernel with a
landmark is the number of features they share over the geometric mean of their own numbers. The kernel values with a
few landmarks of each language, whitened by the landmarks' own kernel matrix, go into ridge regression. Whole texts
are scored in batches, by two matrix products each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: A text without such a character has no language, neither to be learned nor told.
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Kernel:
    """grams: lengths of the n-grams. bits: of a hashed gram. rows: labelled documents of each language that are learned from,
    about; landmarks: of them, per language. all_rows, all_landmarks: what both come to together, about, so that they shrink where there are very many
    languages; each has one at least. ridge: of the regression."""

    grams: tuple[int, ...] = (1, 2, 3)
    bits: int = 14
    rows: int = 500
    landmarks: int = 40
    all_rows: int = 100_000
    all_landmarks: int = 4000
    ridge: float = 1e-2
    batch: int = 256
    seed: int = 5


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence, features by landmarks
    sizes: np.ndarray
    weights: np.ndarray  # landmarks by languages


def present(texts: list[str], how: Kernel) -> np.ndarray:
    """Rows of 0 and 1: the hashed n-grams of each whole text, in lower case."""
    out = np.zeros((len(texts), 1 << how.bits), np.float32)
    shift = U(64 - how.bits)
    for row, text in zip(out, texts, strict=True):
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        for n in how.grams:
            if len(c) >= n:
                h = c[: len(c) - n + 1] + U(n)
                for k in range(1, n):
                    h = h * U(0x100000001B3) + c[k : len(c) - n + 1 + k]
                row[(h * U(0x9E3779B97F4A7C15)) >> shift] = 1.0
    return out


def _kernel(x: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (x @ landmarks) / np.sqrt(np.maximum(x.sum(1), 1.0))[:, None] / np.sqrt(np.maximum(sizes, 1.0))[None, :]


def fit(languages: np.ndarray, x: np.ndarray, how: Kernel) -> Model:
    """A model from the presence rows x of labelled texts."""
    names = sorted(set(languages))
    chosen = np.concatenate([np.flatnonzero(languages == name)[: how.landmarks] for name in names])
    landmarks = np.ascontiguousarray(x[chosen].T)
    sizes = landmarks.sum(0)
    own = _kernel(x[chosen], landmarks, sizes).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    phi = _kernel(x, landmarks, sizes) @ white
    y = (languages[:, None] == np.array(names)[None, :]).astype(float)
    each = 1.0 / y.sum(0)[y.argmax(1)]  # languages count alike
    gram = phi.T @ (phi * each[:, None]) + how.ridge * np.eye(phi.shape[1]) / len(names)
    return Model(names, landmarks, sizes, (white @ np.linalg.solve(gram, phi.T @ (y * each[:, None]))).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by their doc_id alone; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, how: Kernel = Kernel()) -> Model | None:
    """A model from docs(doc_id, text, lang), without held-out documents; None without labelled texts.

    Which documents of a language are learned from follows a hash of the doc_id; the presence bits of those few reach the driver.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).filter(F.col("text").rlike(LETTER))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return None
    share = lambda most, whole: max(1, min(most, whole // len(counts)))
    how = replace(how, rows=share(how.rows, how.all_rows), landmarks=share(how.landmarks, how.all_landmarks))
    dice = F.pmod(F.xxhash64(F.lit(how.seed), "doc_id"), F.lit(1 << 40))
    under = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, how.rows / r["n"]) * (1 << 40)))]), F.col("lang"))
    sample = known.filter(dice < under).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text", dice.alias("dice"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), how.batch):
                part = batch.iloc[at : at + how.batch]
                x = present(list(part["text"]), how).astype(bool)
                yield part[["doc_id", "lang", "dice"]].assign(bits=[np.packbits(r).tobytes() for r in x])

    # repeated doc_ids share their dice, so more rows than meant may come under; the least are taken, the same ones every time
    found = sample.mapInPandas(bits, "doc_id string, lang string, dice long, bits binary")
    got = found.orderBy("dice", "doc_id", "lang", "bits").limit(2 * how.rows * len(counts)).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "doc_id", "bits"])
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    return fit(got["lang"].to_numpy(str), x, how)


def identify(docs: DataFrame, model: Model | None, how: Kernel = Kernel()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of docs(doc_id, text); other columns are not read.

    Texts that are null, empty or without a letter (digits, numerals and signs are none), and all texts if there is no model, are `und` with score 0. Repeated
    rows are told alike; the whole of a text counts, however long. Empty: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            texts, lettered = batch.pop("text").tolist(), batch.pop("lettered").tolist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            told = [i for i, own in enumerate(lettered) if model and own]
            for at in range(0, len(told), how.batch):
                part = told[at : at + how.batch]
                y = _kernel(present([texts[i] for i in part], how), model.landmarks, model.sizes) @ model.weights
                for i, k, s in zip(part, y.argmax(1), y.max(1), strict=True):
                    names[i], scores[i] = model.languages[k], min(1.0, max(0.0, float(s)))
            yield batch.assign(lang_pred=names, score=scores)

    # doc_ids travel as text, so that null ones do not turn the others into floating point
    rows = docs.select(F.col("doc_id").cast("string").alias("d"), held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered"))
    out = rows.mapInPandas(run, "d string, held_out boolean, lang_pred string, score double")
    return out.select(F.col("d").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
