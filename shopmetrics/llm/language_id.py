"""Language identification (operator 7): sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text go to 2^16 hashed features; a feature's value is its
share of the text's n-grams times its inverse document frequency. Document frequencies are counted over
all training documents. The classifier is fitted by follow-the-regularised-leader (per coordinate) with
L1 and L2 penalties on a bounded sample (``max_per_language``, a parameter), then calibrated by one
temperature on a part of that sample it was not fitted on. Prediction runs over every whole text.

What is in none of the languages is told by the novelty of a text: the mean idf of its n-grams. It counts as foreign if it
is nearer to the idf of an n-gram that no training document has than to the highest novelty in the part
that was not fitted on. Scores can't tell, as they only rank the known languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 16
MAX_PER_LANGUAGE = 800
UNKNOWN = "und"
PIECE_CHARS = 1 << 20  # a longer text is read in pieces; no n-gram spans two of them
_FACTORS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def features_of(text: str) -> np.ndarray:
    """The feature number of each character 1-, 2- and 3-gram of a text, whole and in order of length."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    out = []
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """``table``: for each feature the weights of the languages times its idf, then its idf; ``bias`` per language.

    A text of more than ``most_novel`` mean idf is foreign.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    most_novel: float = float("inf")

    def scores(self, text: str) -> tuple[np.ndarray, float]:
        """Linear scores and novelty; the mean of the table over the text's n-grams, in pieces so that memory is bounded."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for at in range(0, len(text), PIECE_CHARS):
            found = features_of(text[at : at + PIECE_CHARS])
            total += self.table[found].sum(0, dtype=np.float64)
            n += len(found)
        mean = total / max(n, 1)
        return mean[:-1] + self.bias, float(mean[-1])

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is foreign to all languages."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        scores, novelty = self.scores(text)
        p = softmax(scores / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), novelty > self.most_novel

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> np.ndarray:
    """Weights (features + 1 for the bias, classes) from rows (class, features, values).

    Per coordinate: z gathers gradients less sigma * weight, n their squares; the weight is 0 where |z| <= l1,
    else -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2).
    """
    z = np.zeros((FEATURES + 1, n_classes))
    n = np.zeros_like(z)

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, found, value = rows[k]
            at, x = np.append(found, FEATURES), np.append(value, 1.0)[:, None]
            w = weights(at)
            p = softmax((w * x).sum(0))
            p[label] -= 1.0
            g = x * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least cross-entropy, on a grid from 0.1 to 10.

    The true language's target is (n + 1) / (n + 2) of n rows, the rest is shared by the others, so that a sample without
    an error does not make every score 1.
    """
    n, classes = scores.shape
    target = np.full((n, classes), 1.0 / (n + 2) / max(1, classes - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2) if classes > 1 else 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(10.0), 93))
    loss = [-(target * np.log(softmax(scores / t) + 1e-300)).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature is, and how many texts there are, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.zeros(FEATURES + 1, bool)
                for at in range(0, len(text or ""), PIECE_CHARS):
                    seen[features_of(text[at : at + PIECE_CHARS])] = True
                seen[FEATURES] = True  # counts the texts
                df += seen
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["feature", "df"])

    sums = texts.mapInArrow(count, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES + 1, np.int64)
    for r in sums:
        df[r["feature"]] = r["df"]
    return df[:FEATURES], int(df[FEATURES])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """A model from the rows of ``df`` that have a language; null texts teach nothing.

    At most about ``max_per_language`` texts of each language are fitted on: of a language with more, those
    whose text hashes below the matching share. Copies of a text are one, both in the sample and in the size of the
    language (by a 64-bit hash), so a text which very many rows hold takes no place of others. Document frequencies
    cover all rows given.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    texts = rows.select("lang", F.xxhash64("text").alias("text")).distinct()
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((FEATURES, 1), np.float32), np.zeros(0))
    found, n = _document_frequencies(rows.select("text"))
    idf = np.log((1.0 + n) / (1.0 + found)) + 1.0
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_per_language / size))).otherwise(share)
    place = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(place < share).dropDuplicates(["lang", "text"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.zeros(FEATURES, np.int64)
                for at in range(0, len(text), PIECE_CHARS):
                    counts += np.bincount(features_of(text[at : at + PIECE_CHARS]), minlength=FEATURES)
                at = np.flatnonzero(counts)
                share = counts[at] / max(1, counts.sum())
                out.append((lang, at.astype("<i4").tobytes(), share.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "at", "share"])

    taken = sorted((r["lang"], bytes(r["at"]), bytes(r["share"])) for r in sample.mapInArrow(vectors, "lang string, at binary, share binary").collect())
    data = []
    for lang, at, part in taken:
        at = np.frombuffer(at, "<i4").astype(np.int64)
        data.append((languages.index(lang), at, np.frombuffer(part, "<f4") * idf[at] * SCALE))
    held = [k % 5 == 4 for k in range(len(data))]
    fitted = fit_ftrl([r for r, h in zip(data, held) if not h], len(languages))
    table = np.concatenate([fitted[:FEATURES] * SCALE, np.ones((FEATURES, 1))], axis=1) * idf[:, None]
    model = Model(languages, table.astype(np.float32), fitted[FEATURES])
    apart = [r for r, h in zip(data, held) if h]
    if apart:
        scores = np.array([(v[:, None] * fitted[at]).sum(0) + fitted[FEATURES] for _, at, v in apart])
        model.temperature = best_temperature(scores, np.array([r[0] for r in apart]))
        unseen = np.log(1.0 + n) + 1.0
        model.most_novel = (max(float(v.sum()) / SCALE for _, _, v in apart) + unseen) / 2
    return model


# The shares of a text's n-grams are small numbers; one factor brings them to the size that the steps of the fit suit.
SCALE = 20.0


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (0 to 1; 0 for ``und``).

    ``und`` if the text is null, empty or has no letter, or if the model knows no language. Ties go to
    the first language by name. Repeated rows are judged each; an empty table gives an empty result. The model
    (features times languages and one, 4 bytes each) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            said = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.0, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` whose language is known: not ``und``, not foreign to all languages, all columns stay.

    With ``least``, rows of a lower score go too; with ``languages``, rows of others. Foreign is what is nearer to an unseen
    text than to the strangest one of the held-out sample (see above), whatever the number of languages; a model without
    held-out rows (a sample under five texts) finds nothing foreign. A model of no language rejects nothing: unless
    ``languages`` are given, every text with a letter stays. Repeated rows go or stay together, an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def known(text: str | None) -> bool:
        own = shared.value
        if not own.languages and languages is None:
            return text is not None and has_letter(text)
        lang, score, foreign = own.judge(text)
        return lang != UNKNOWN and not foreign and score >= least and (languages is None or lang in languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([known(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
