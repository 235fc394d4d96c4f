"""Language identification: words first, then ever shorter character n-grams for words not seen in training."""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_short_batches, table, tidy_worker

#: Labelled rows that the model is learnt from (or one a language, if those are more), which bounds its words and n-grams; characters of an n-gram.
TRAIN_ROWS, LONGEST = 4_000, 4
#: Rows are chosen in units of one over this number, fine enough for any table.
SHARES = 1 << 40
WORDS = re.compile(r"[^\W\d_]+")
#: Words whose numbers a worker keeps, and bytes of these numbers; the table is emptied when full.
CACHE_ENTRIES, CACHE_BYTES = 100_000, 16_000_000
UNKNOWN = "und"


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: str | None) -> Counter:
    return Counter(WORDS.findall(text.lower())) if text else Counter()


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between marks of its ends."""
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (n = 0) and n-grams by language, passed on whenever the words are many. N-grams are those of the words met, once for each."""
    counts: Counter = Counter()

    def flush() -> Iterator[pd.DataFrame]:
        words = sorted(counts.items())
        counts.clear()
        for k in range(0, len(words), 10_000):
            terms: Counter = Counter()
            for (lang, word), c in words[k : k + 10_000]:
                terms[lang, 0, word] += c
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        terms[lang, n, g] += c
            yield pd.DataFrame([(*t, c) for t, c in terms.items()], columns=["lang", "n", "term", "count"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for word, c in words_of(text).items():
                counts[lang, word] += c
            if len(counts) > 40_000:
                yield from flush()
    yield from flush()


class Model:
    """Log frequencies by language of words (``entries[0]``) and n-grams (``entries[n]``); ``predict`` sums them over a text's words.

    Entries are (term, language's number, log frequency); a language that lacks a term known in others has ``floors[n]``.
    What is kept grows with the entries, not with terms times languages.
    """

    def __init__(self, langs: list[str], entries: list[list[tuple[str, int, float]]], floors: list[float]):
        self.langs, self.floors = langs, np.array(floors)
        self.terms: list[dict[str, int]] = []
        sizes: list[int] = []
        of: list[tuple[int, float]] = []
        for n, some in enumerate(entries):
            at: dict[str, int] = {}
            for term, group in itertools.groupby(sorted(some), key=lambda e: e[0]):
                at[term] = len(sizes)
                of += ((lang, v - floors[n]) for _, lang, v in group)
                sizes.append(len(of))
            self.terms.append(at)
        self.ends = np.array([0, *sizes])
        self.lang_of = np.array([x for x, _ in of], dtype=np.int64)
        self.values = np.array([v for _, v in of], dtype=float)
        self._reset()

    def _reset(self) -> None:
        """Rows of numbers of the words met, filled as they come."""
        self.rows: dict[str, int] = {}
        self.cached = np.zeros((max(1, min(CACHE_ENTRIES, CACHE_BYTES // (8 * max(1, len(self.langs))))), len(self.langs)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "cached")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def evidence(self, words: list[str]) -> np.ndarray:
        """A row of languages for each word: a known word's log frequencies, or the mean of those of its longest n-grams that are known; zeros if none is."""
        found: list[int] = []
        counts, floors = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
        if self.terms:
            known = self.terms[0].get
            for i, w in enumerate(words):
                k = known(w)
                if k is not None:
                    found.append(k)
                    counts[i], floors[i] = 1, self.floors[0]
                    continue
                for n in range(len(self.terms) - 1, 0, -1):
                    get = self.terms[n].get
                    some = [k for g in grams_of(w, n) if (k := get(g)) is not None]
                    if some:
                        found += some
                        counts[i], floors[i] = len(some), self.floors[n]
                        break
        terms = np.array(found, dtype=np.int64)
        sizes = self.ends[terms + 1] - self.ends[terms]
        word = np.repeat(np.repeat(np.arange(len(words)), counts), sizes)
        at = np.arange(len(word)) + np.repeat(self.ends[terms] - (np.cumsum(sizes) - sizes), sizes)
        sums = np.bincount(word * len(self.langs) + self.lang_of[at], weights=self.values[at], minlength=len(words) * len(self.langs))
        return sums.reshape(len(words), len(self.langs)) / np.maximum(1, counts)[:, None] + floors[:, None]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > len(self.cached):
            self._reset()
            new = list(words)
        sums = np.zeros(len(self.langs))
        if len(new) > len(self.cached):  # one text alone has too many
            for k in range(0, len(new), len(self.cached)):
                some = new[k : k + len(self.cached)]
                sums += np.array([words[w] for w in some], dtype=float) @ self.evidence(some)
        else:
            if new:
                first = len(self.rows)
                self.cached[first : first + len(new)] = self.evidence(new)
                self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            at = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
            sums += np.fromiter(words.values(), dtype=float, count=len(words)) @ self.cached[at]
        # per-word evidence, sharpened by the square root of the number of words, which are not independent
        p = np.exp((sums - sums.max()) / math.sqrt(sum(words.values())))
        best = int(sums.argmax())
        return self.langs[best], float(p[best] / p.sum())


def rows_each(sizes: Iterable[int], max_rows: int) -> int:
    """The most rows to take of one language so that all take ``max_rows`` together: languages of fewer rows give all they have, any other at least one."""
    sizes = sorted(sizes)
    for k, n in enumerate(sizes):
        even = max_rows // (len(sizes) - k)
        if n > even:
            return max(1, even)
        max_rows -= n
    return max(sizes, default=0)


def sampled(rows: int, of: int) -> int:
    """The bound under which about ``rows`` of ``of`` hashes modulo SHARES lie; never 0."""
    return math.ceil(min(1.0, rows / max(1, of)) * SHARES)


def learn(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows with a language whose key is not held out, all of them or about ``max_rows`` by hash: see ``rows_each`` for how many of each language.

    A language of at most ``max_rows`` over the number of languages rows is thus learnt from all of them, and every language takes part: the row with
    its least hash is always among them. One without a word in its rows is never predicted. A term that a language lacks has one frequency for all languages, below that
    of any known term, however little a language was seen.

    All words and n-grams of these rows are kept, so the number of rows alone makes the model's size independent of the corpus.
    """
    spark = docs.sparkSession
    rows = in_short_batches(docs).filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chance = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("train")), F.lit(SHARES))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(chance).alias("least")).collect()
    if not found:
        return Model([], [], [])
    each = rows_each([r["n"] for r in found], max_rows)
    below = spark.createDataFrame([(r["lang"], max(sampled(each, r["n"]), r["least"] + 1)) for r in found], "lang string, below long")
    some = rows.join(F.broadcast(below), "lang").filter(chance < F.col("below"))
    counts = some.select("lang", "text").mapInPandas(tidy_worker(_count), "lang string, n int, term string, count long").groupBy("lang", "n", "term").agg(F.sum("count").alias("count"))
    counts = cut(counts)
    totals = {(r["lang"], r["n"]): (r["t"], r["k"]) for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("t"), F.count(F.lit(1)).alias("k")).collect()}
    langs = sorted({x for x, _ in totals})
    index = {x: k for k, x in enumerate(langs)}
    entries: list[list[tuple[str, int, float]]] = [[] for _ in range(LONGEST + 1)]
    for batch in counts.toArrow().to_batches():
        for lang, n, term, count in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "term", "count")), strict=True):
            entries[n].append((term, index[lang], math.log((count + 0.1) / sum(totals[lang, n]))))
    # of the language seen most: a language seen less must not be likelier where it knows nothing
    floors = [math.log(0.1 / max((sum(totals[x, n]) for x in langs if (x, n) in totals), default=1)) for n in range(LONGEST + 1)]
    return Model(langs, entries, floors)


def _predict(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)  # the worker is used again, so what it unpacks must end with the task
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("_text"))]
            columns = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[*columns, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], *, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred, score`` added; every whole text is read.

    A text that is null or has no letter is ``und`` with score 0; where a word ties, the language first
    in order wins. Repeated rows are predicted alike. An empty table, or a model learnt from no rows,
    gives no rows and ``und`` respectively.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    # a name of its own for the text, so that no column in ``keep`` clashes with it
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy_worker(_predict(shared)), schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _accept(shared, at: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, least: float = 0.5, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: not ``und``, and a score of at least ``least``.

    Null, empty and wordless texts go. Each row is judged by its text alone, so repeated rows stay or go together; ids may be null. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return docs.mapInArrow(tidy_worker(_accept(shared, docs.columns.index(text), least)), docs.schema)
