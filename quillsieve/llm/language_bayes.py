"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import blocks, extend, field, text_bytes, with_columns
from quillsieve.llm.quality_cnn import split_of

ORDERS, BITS = (1, 2, 3), 15
BUCKETS = 1 << BITS
#: Languages that a model may have; the matrix that goes to the executors has BUCKETS times so many numbers.
MAX_LANGUAGES = 128
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_single = [chr(c).lower() for c in range(0x600)]
FOLD = np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(_single)], np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def letters(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    return np.array([LETTER.search(raw[a:b].decode("utf-8", "replace")) is not None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], bool)


def grams(data: np.ndarray, bounds: np.ndarray):
    """(bucket, row) of all n-grams of lower-cased code points, one order at a time; none crosses a row's end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first)).astype(np.int32)
    points = np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], points).astype(np.uint64)
    hashed = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        hashed = (hashed[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * MIX
        hashed ^= hashed >> np.uint64(31)
        if n in ORDERS:
            whole = row[: len(hashed)] == row[n - 1 :]
            yield (hashed >> np.uint64(64 - BITS)).astype(np.int32)[whole], row[: len(hashed)][whole]
        if len(points) <= n:
            return


@dataclass
class Model:
    """Log-probabilities of buckets by language, and log priors."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; ``und`` and 0 for texts without a letter."""
        rows = len(bounds) - 1
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        totals = np.tile(self.prior, (rows, 1))
        for bucket, row in grams(data, bounds):
            for k in range(len(self.languages)):
                totals[:, k] += np.bincount(row, self.matrix[k][bucket], rows)
        best = totals.argmax(1)
        share = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
        known = letters(data.tobytes(), bounds)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())], np.where(known, share, 0.0)


def count_grams(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n): n-grams of all texts by language, summed in each task first; bucket -1 counts texts."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
            held.clear()

        for batch in blocks(batches, text_col):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            names, of = np.unique(np.array(batch.column(batch.schema.get_field_index(lang_col)).to_pylist(), object), return_inverse=True)
            if len(held) + len(names) > 2 * MAX_LANGUAGES:
                yield from out()
            use = letters(data.tobytes(), bounds)
            counts = np.zeros((len(names), BUCKETS + 1), np.int64)
            np.add.at(counts[:, 0], of[use], 1)
            for bucket, row in grams(data, bounds):
                counts[:, 1:] += np.bincount(of[row].astype(np.int64) * BUCKETS + bucket, use[row].astype(float), len(names) * BUCKETS).astype(np.int64).reshape(len(names), BUCKETS)
            for k, lang in enumerate(names):
                held[lang] = held.get(lang, 0) + counts[k]
        yield from out()

    return df.select(text_col, lang_col).mapInArrow(run, "lang string, bucket int, n long")


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> Model:
    """Counts the n-grams of every row with a text and a language, and takes smoothed logarithms.

    Null texts and languages are left out, texts without a letter too; repeated rows count as often as
    they stand; an empty table gives a model that knows no language.
    At most MAX_LANGUAGES languages times BUCKETS sums come to the driver; more languages are an error.
    """
    known = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    total = count_grams(known, text_col, lang_col).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    vectors = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("v")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    languages, rows, texts = [], [], []
    for r in vectors.toLocalIterator():
        counts = np.zeros(BUCKETS + 1)
        pairs = np.array([(b, n) for b, n in r["v"]], np.int64).reshape(-1, 2)
        counts[pairs[:, 0] + 1] = pairs[:, 1]
        languages.append(r["lang"])
        texts.append(counts[0])
        rows.append(np.log((counts[1:] + smooth) / (counts[1:].sum() + smooth * BUCKETS)))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    texts = np.array(texts)
    return Model(languages, np.array(rows).reshape(-1, BUCKETS), np.log((texts + 1) / (texts.sum() + len(texts))) if len(texts) else texts)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (the posterior) from each whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Other columns
    are carried and never read; those named lang_pred or score are replaced. Repeated rows stay; an
    empty table gives an empty one.
    """
    keep = df.columns if keep is None else list(keep)
    source = df.select(list(dict.fromkeys([*keep, text_col])))

    def run(batches):
        for batch in blocks(batches, text_col):
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            langs, score = model.predict(data, bounds)
            yield with_columns(batch, keep, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score)})

    return source.mapInArrow(run, extend(source, keep, [field("lang_pred", "string"), field("score", "double")]))


def held_out(id_col: str = "doc_id"):
    return split_of(F.col(id_col), 3) == 1
