"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text, less exception phrases, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_short_batches, table
from .language import SHARES, held_out, sampled

#: Characters that stand for a Latin letter: Cyrillic and Greek look-alikes, digits and signs (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}
_FOLD = str.maketrans(LOOKALIKES)
_MARKS = re.compile(r"[̀-ͯ​-‏⁠﻿­]+")
_OTHER = re.compile(r"[^a-z]+")
_OTHER_UNICODE = re.compile(r"[\W\d_]+")
_FOLD_LATIN = str.maketrans({k: v for k, v in LOOKALIKES.items() if k.isascii()})

#: Labelled rows that the lexicon is learnt from at most, chosen evenly by a hash of the key; they bound its terms and exceptions too.
TRAIN_ROWS = 20_000
#: Characters of a stem.
STEM = (4, 5, 6)
#: Clean rows that a phrase must be in to be an exception.
LEAST_CLEAN = 3
#: A term's least weight (natural log of how much likelier it is in toxic rows), least share of toxic rows, least number of different neighbourhoods.
LEAST_WEIGHT, LEAST_SHARE, LEAST_PLACES = 3.0, 0.005, 5


def fold(text: str | None) -> str:
    """Lower case without invisible characters, look-alikes as Latin letters; words between single blanks, a blank at each end."""
    if not text:
        return " "
    if text.isascii():
        return f" {_OTHER.sub(' ', text.lower().translate(_FOLD_LATIN)).strip()} "
    text = _MARKS.sub("", unicodedata.normalize("NFKC", text.lower())).translate(_FOLD)
    return f" {_OTHER_UNICODE.sub(' ', text).strip()} "


def terms_of(words: Iterable[str]) -> set[str]:
    """What a lexicon can hold: whole words (" word ") and stems (" wor")."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        for n in STEM:
            if len(w) > n:
                out.add(f" {w[:n]}")
    return out


@dataclass
class Lexicon:
    """``weights`` by term, ``exceptions`` (phrases inside which no term counts), and the calibration: rate and total at which the score is 0.5."""

    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    half: float = 1.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            built = ahocorasick.Automaton()
            for term, w in self.weights.items():
                built.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                built.add_word(phrase, (len(phrase), 0.0))
            if len(built):
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def raw(self, text: str | None) -> float:
        """The weights of the matches outside exception phrases, over the square root of the number of words; of terms that begin together the heaviest counts."""
        folded = fold(text)
        automaton = self.automaton()
        if not len(automaton):
            return 0.0
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w:
                hits[start] = max(hits.get(start, 0.0), w)
            else:
                spared.append((start, end))
        if not hits:
            return 0.0
        if spared:
            # both in order, so that a long text is gone through once
            spared.sort()
            left, at, upto = {}, 0, -1
            for s in sorted(hits):
                while at < len(spared) and spared[at][0] <= s:
                    upto = max(upto, spared[at][1])
                    at += 1
                if s >= upto:
                    left[s] = hits[s]
            hits = left
        return sum(hits.values()) / math.sqrt(max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        raw = self.raw(text)
        return raw / (raw + self.half)


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(term, n if toxic else 0, 0 if toxic else n) for toxic, of in counts.items() for term, n in of.items()], columns=["term", "toxic", "clean"])
        for of in counts.values():
            of.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic)].update(terms_of(set(fold(text).split())))
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield flush()
    yield flush()


def _places(candidates):
    """For each candidate the neighbours of its uses, once in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = candidates.value
        for batch in batches:
            rows: set = set()
            for text in batch["text"]:
                words = fold(text).split()
                around = ["", *words, ""]
                for i, w in enumerate(words):
                    for term in terms_of((w,)):
                        if term in known:
                            rows.add((term, f"{around[i]} {around[i + 2]}"))
            yield pd.DataFrame(list(rows), columns=["term", "place"])

    return run


def phrases_of(text: str | None, weights: Mapping[str, float]) -> set[str]:
    """The pairs of neighbouring words of which one is matched by a term."""
    words = fold(text).split()
    hit = [any(t in weights for t in terms_of((w,))) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}


def _count_phrases(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                counts.update((phrase, int(toxic)) for phrase in phrases_of(text, shared.value))
            yield pd.DataFrame([(p, n if toxic else 0, 0 if toxic else n) for (p, toxic), n in counts.items()], columns=["phrase", "toxic", "clean"])

    return run


def _raws(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "raw": [shared.value.raw(t) for t in batch["text"]]})

    return run


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: Sequence[str] = (), max_rows: int = TRAIN_ROWS) -> Lexicon:
    """Learn terms, exceptions and the calibration from labelled rows whose key is not held out: all of them, or about ``max_rows`` chosen by hash.

    Rows of one text and label count once, so copies of a text neither weigh a term up nor hide it.

    A term is a whole word or the first letters of one. Its weight is the log of how much likelier it is in
    toxic rows than in others. It is kept if it is in enough toxic rows and its uses have enough
    different neighbours (rare words of a text that was copied often have few). A word whose stem is kept is left out unless it is heavier. Words that begin with a kept stem but are
    mostly in clean rows become exceptions, besides those given, and so do phrases, a term's word and a neighbour, that are likelier in clean rows.

    Rows without a text, a label or a partner in the other table are not learnt from; a key with several labels is toxic if one of them is. The
    bound on rows is the only one: all terms and exceptions that they show are kept. Other columns, whatever their names, are ignored. Without a toxic row the lexicon is empty.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    below = sampled(max_rows, marked.count())
    # at most about max_rows short rows, so the texts need not be shuffled
    chosen = F.broadcast(marked.filter(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("toxic")), F.lit(SHARES)) < below))
    train = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, ["key"])
    train = cut(train.select("toxic", "text").distinct())
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return Lexicon({}, tuple(exceptions))
    counts = cut(train.mapInPandas(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") > 0))
    weight = F.ln((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.ln((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(3, math.ceil(LEAST_SHARE * n_toxic))
    found = counts.withColumn("weight", weight).filter((F.col("toxic") >= least) & (F.col("weight") >= LEAST_WEIGHT)).collect()
    candidates = {r["term"]: r["weight"] for r in found}
    shared = spark.sparkContext.broadcast(frozenset(candidates))
    places = train.filter(F.col("toxic") == 1).select("text").mapInPandas(_places(shared), "term string, place string").distinct()
    spread = places.groupBy("term").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") >= LEAST_PLACES)
    kept = {r["term"]: candidates[r["term"]] for r in spread.collect()}

    def covered(term: str) -> bool:
        """A stem that is at least as heavy, within a small margin, says as much."""
        return any(kept.get(term[: n + 1], -1.0) >= kept[term] - 1.0 for n in STEM if len(term) > n + 1)

    weights = dict(sorted(((t, w) for t, w in kept.items() if not covered(t)), key=lambda x: (-x[1], x[0])))
    stems = [t for t in weights if not t.endswith(" ")]
    spared: list[str] = list(exceptions)
    if stems:
        begins = spark.createDataFrame([(x,) for x in stems], "stem string")
        words = counts.filter(F.col("term").endswith(" ") & (F.col("clean") > F.col("toxic"))).select("term", F.explode(F.array(*[F.substring("term", 1, n + 1) for n in STEM])).alias("stem"))
        spared += sorted(r["term"] for r in words.join(begins, "stem", "left_semi").select("term").distinct().collect())
    pairs = train.select("toxic", "text").mapInPandas(_count_phrases(spark.sparkContext.broadcast(weights)), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared += sorted(r["phrase"] for r in pairs.filter((F.col("clean") >= LEAST_CLEAN) & (weight < 0)).select("phrase").collect())
    lexicon = Lexicon(weights, tuple(spared))
    raws = train.select("toxic", "text").mapInPandas(_raws(spark.sparkContext.broadcast(lexicon)), "toxic int, raw double")
    low = raws.filter(F.col("toxic") == 1).agg(F.percentile_approx("raw", 0.02)).first()[0] or 0.0
    high = raws.filter(F.col("toxic") == 0).agg(F.percentile_approx("raw", 0.999)).first()[0] or 0.0
    lexicon.half = (low + high) / 2 if low > high else max(low, high, 1e-3)
    return lexicon


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            columns = [c for c in batch.schema.names if c != "_text"]
            scores = [lexicon.score(x.as_py()) for x in batch.column(batch.schema.get_field_index("_text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], names=[*columns, "score"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[str], *, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score`` (0 to 1) added.

    Null, empty and wordless texts score 0, as does everything under an empty lexicon. Repeated rows score alike; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return in_short_batches(docs).select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(_score(shared), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs, lexicon, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
