"""Language identification by known words, backing off to character n-grams.

The model has, per language, the log frequency of words and of character
n-grams (of words between marks), counted over a bounded sample of labelled
documents: at most ``SAMPLE`` per language, the first in the order of a hash
of doc_id, their whole texts. A word is known if the sample holds it
``MIN_WORD`` times. A text's words are scored one by one: a known word by
its log frequency in each language, an unseen word by the mean log
frequency of its known n-grams of the longest length that has any. The
text's language has the largest sum; ``score`` is its posterior under equal
priors.

The classifier is the one thing fitted on a sample; every text is read
whole. Neither the label, the source nor the id of a text is an input of
its prediction.

Defined cases: a null text and one without a letter get ``und`` with score
0, and so does every text where nothing is learned; ties go to the smaller
language name; repeated rows get a row each; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab.llm.common import checkpointed, give_back, ship
from churnlab.llm.shingles import mix64
from churnlab.llm.tokens import text_chunks

SAMPLE, MIN_WORD, LONGEST = 1000, 3, 5
SMOOTH = 0.5
CACHE_WORDS = 100_000
#: Characters of text handled at once, and words scored at once.
CHUNK, AT_ONCE = 1 << 20, 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; empty where there is no letter."""
    words = WORD.findall(text.lower())
    # the pattern also takes number forms such as fractions
    return words if any(map(str.isalpha, "".join(words[:8]))) or any(any(map(str.isalpha, w)) for w in words[8:]) else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, rows in frame.groupby("lang"):
            words: Counter[str] = Counter()
            for text in rows["text"]:
                words.update(words_of(text))
            parts: Counter[tuple[int, str]] = Counter({(0, w): n for w, n in words.items()})
            for word, times in words.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        parts[n, g] += times
            yield pd.DataFrame({"lang": lang, "size": [k[0] for k in parts], "part": [k[1] for k in parts], "n": list(parts.values())})


def _windows(text: str, n: int) -> np.ndarray:
    """Keys of the runs of n code points of a text: 64 bits each."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    keys = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            keys = mix64(keys * MULTIPLIER + codes[j : j + len(keys)])
    return keys


def _keys(size: int, parts: list[str]) -> np.ndarray:
    """64 bits of each part of one size."""
    if size:
        return _windows("".join(parts), size)[::size]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


class _Parts:
    """The rows of the parts of one size."""

    def __init__(self, model: Model, size: int):
        self.model, self.size = model, size

    def __getitem__(self, part: str) -> int:
        at = int(self.model.find(_keys(self.size, [part]))[0])
        if at < 0:
            raise KeyError(part)
        return at


class Model:
    """Log frequencies of words and n-grams; one column per language.

    ``rows`` is one matrix of 32-bit floats, in the order of ``keys``, a
    sorted array of 64-bit hashes of the parts, so that a worker holds and
    unpickles no strings; ``places`` has the row of a part by its size (0:
    whole words). All words of a batch are looked up at once.
    """

    def __init__(self, languages: list[str], counts: Iterable[tuple[str, int, str, int]]):
        self.languages = sorted(languages)
        column = {x: i for i, x in enumerate(self.languages)}
        cells = array("q")
        sizes, parts = array("b"), []
        for lang, size, part, n in counts:
            sizes.append(size)
            parts.append(part)
            cells.extend((column[lang], n))
        keys, of = np.zeros(len(parts), np.uint64), np.array(sizes, np.int8)
        for size in np.unique(of):
            own = np.flatnonzero(of == size)
            keys[own] = _keys(int(size), [parts[i] for i in own])
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        lang, n = np.array(cells, np.int64).reshape(-1, 2).T
        rows = np.full((len(found), len(column)), SMOOTH)
        np.add.at(rows, (at, lang), n)
        of = of[first]
        for size in np.unique(of):
            own = of == size
            rows[own] = np.log(rows[own] / rows[own].sum(axis=0))
        self.keys, self.rows = found, rows.astype(np.float32)

    @property
    def places(self) -> dict[int, _Parts]:
        return {size: _Parts(self, size) for size in range(LONGEST + 1)}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores per word: its own if known, else the mean over its
        longest known n-grams, else 0."""
        table = np.zeros((len(words), len(self.languages)), np.float32)
        at = self.find(_keys(0, words))
        table[at >= 0] = self.rows[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            marked = [f"<{words[i]}>" if n > 1 else words[i] for i in rest]
            lengths = np.fromiter(map(len, marked), np.int64, len(marked))
            grams_of = np.maximum(lengths - n + 1, 0)
            owner = np.repeat(np.arange(len(marked)), grams_of)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(grams_of) - grams_of, grams_of)
            at = self.find(_windows("".join(marked), n)[inside + (np.cumsum(lengths) - lengths)[owner]])
            known = np.bincount(owner[at >= 0], minlength=len(marked))
            some = known > 0
            if some.any():
                sums = np.add.reduceat(self.rows[at[at >= 0]], (np.cumsum(known) - known)[some])
                table[rest[some]] = sums / known[some, None].astype(np.float32)
            rest = rest[~some]
            if not len(rest):
                break
        return table

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]


class _Scores(dict):
    """word -> its row of scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows = model, array("f")

    def learn(self, words: set[str]) -> None:
        """Score the words that are not held yet, all at once."""
        fresh = list(words.difference(self))
        for i in range(0, len(fresh), AT_ONCE):
            some = fresh[i : i + AT_ONCE]
            self.rows.frombytes(self.model.words(some).tobytes())
            self.update(zip(some, range(len(self), len(self) + len(some)), strict=True))

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.float32).reshape(len(self), -1)


class Predictor:
    """Predicts texts, keeping the scores of the words met so far."""

    def __init__(self, model: Model):
        self.model, self.scores = model, _Scores(model)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, list[str], list[float]]]:
        """(first row, languages, posteriors) of chunks of a column of texts.

        The language is None where the text has words but nothing is learned.
        """
        for first, texts in text_chunks(column, CHUNK):
            if len(self.scores) > CACHE_WORDS:
                self.scores = _Scores(self.model)
            words = [words_of(text) for text in texts]
            self.scores.learn(set().union(*words))
            at = [list(map(self.scores.__getitem__, w)) for w in words]
            del words
            table = self.scores.table() if self.scores else None
            langs, values = [], []
            for words in at:
                if not words or not self.model.languages:
                    langs.append(None if words else UNKNOWN)
                    values.append(0.0)
                    continue
                total = table[words].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                langs.append(self.model.languages[best])
                values.append(float(1 / np.exp(total - total[best]).sum()))
            yield first, langs, values


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    predict = Predictor(model)
    for batch in batches:
        for first, langs, values in predict(batch.column(1)):
            doc_ids = batch.column(0).slice(first, len(langs))
            yield pa.record_batch({"doc_id": doc_ids, "lang_pred": pa.array([x or UNKNOWN for x in langs], pa.string()), "score": pa.array(values, pa.float64())})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from rows with lang and text that are not held out."""
    ship(docs.sparkSession)
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    labelled = labelled.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    totals = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a hash below this share leaves some more than `sample` rows of each language
    share = F.least(F.lit(1.0), 1.5 * sample / F.col("n") + 0.0)
    some = labelled.join(F.broadcast(totals), "lang").filter((F.col("h") / float(1 << 64) + 0.5) <= share)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    chosen = ranked.filter(F.col("rank") <= sample).select("lang", "text")
    counts = chosen.mapInPandas(_count, "lang string, size int, part string, n long")
    whole = Window.partitionBy("size", "part")
    summed = counts.groupBy("lang", "size", "part").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(whole))
    kept = summed.filter(F.col("all") >= MIN_WORD).drop("all")
    # bounded by the sample, and columns on the driver
    found = kept.orderBy("size", "part", "lang").toArrow()
    rows = zip(*(c.to_pylist() for c in found.select(["lang", "size", "part", "n"]).columns), strict=True)
    return Model([r.lang for r in totals.collect()], rows)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _with_language(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    predict = Predictor(model)
    for batch in batches:
        give_back()
        found = [x for _, langs, _ in predict(batch.column(at)) for x in langs]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "predicted"])
    del predict
    give_back()


def identified(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter; a missing ``lang`` is filled in.

    Where nothing is learned, ``lang`` stays as it is. Whole rows pass
    through the tasks as Arrow batches: nothing waits in the JVM meanwhile.
    """
    model = fit(docs)
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text, lang = (names[docs.columns.index(c)] for c in ("text", "lang"))
    schema = T.StructType([*rows.schema.fields, T.StructField("predicted", T.StringType())])
    found = rows.mapInArrow(partial(_with_language, model=model, at=names.index(text)), schema)
    kept = found.filter(F.col("predicted").isNull() | (F.col("predicted") != UNKNOWN))
    return kept.select(*(F.coalesce(lang, "predicted").alias(c) if n == lang else F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
