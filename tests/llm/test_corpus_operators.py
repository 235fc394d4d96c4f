"""Each operator against brute force on a small corpus with nulls, ties, copies, repeated rows, odd texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkseries.llm import language, mixing, neardup, packing, sharding, suffix, toxicity


def raw(text):
    return (text or "").encode()


# -- packing -----------------------------------------------------------------------------------------------------


def test_packing_has_the_tokenizers_ids_and_full_sequences(docs, rows):
    capacity = 64
    out = packing.pack_documents(docs, capacity).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in places) <= 2
    assert len(sequences) <= 1.05 * sum(r.length for r in out) / capacity + 1


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1024: 5}, {683: 4, 1365: 4}, {700: 9, 1: 5000}, {n: 1 for n in range(1, 2049)}])
def test_plan_places_every_item_once(counts):
    plan, opened = packing.plan_packing(counts, 2048)
    placed, fill = Counter(), Counter()
    for length, first, n, sequence, offset in plan:
        assert first == placed[length]
        placed[length] += n
        for k in range(sequence, sequence + n):
            assert fill[k] == offset
            fill[k] += length
    assert {k: v for k, v in placed.items() if v} == {k: v for k, v in counts.items() if v}
    assert all(v <= 2048 for v in fill.values()) and len(fill) == opened


def test_ids_from_the_table_of_words(monkeypatch):
    """Ids are the tokenizer's for plain and odd words, also when the table is emptied again and again."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abeéßñçȺ") for _ in range(rng.randint(1, 12))) for _ in range(700)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "!?"]) for _ in range(40)) for _ in range(60)] + ["l'été Éeau, it's İ ª x1 don't!? ¼ \x1c a\x1cb ǅ", "", "  ", "e\u0301 , ."]
    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for entries in (packing.CACHE_ENTRIES, 100):
        monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
        packing._forget()
        assert packing.encode_all(texts, path) == want
        assert [e for t in texts for e in packing.encode_all([t], path)] == want
    packing._forget()
    assert packing.encode_all([], path) == [] and packing.encode_all([""], path) == [b""]


def test_words_of_a_task_are_encoded_once(monkeypatch):
    """As many different words as a task over some 16 MB has; those that come again are not encoded again."""
    words = ["".join(w) for w in itertools.islice(itertools.product("etaoin", repeat=7), 200_000)]
    texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
    learnt, learn = [], packing._learn
    monkeypatch.setattr(packing, "_learn", lambda ws, state: (learnt.extend(ws), learn(ws, state)))
    packing._forget()
    for k in range(0, 2 * len(texts), 50):
        packing.encode_all((texts + texts)[k : k + 50], public_tokenizers.path(packing.TOKENIZER))
    packing._forget()
    assert len(learnt) == len(words)


# -- suffix-array dedup ------------------------------------------------------------------------------------------


def repeats(texts):
    """For each text the bytes that a LENGTH-byte string covers that also starts elsewhere."""
    n = suffix.LENGTH
    seen = Counter(t[s : s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                covered[s : s + n] = b"\1" * n
        out.append(bytes(covered))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix_removes_just_the_repeated_bytes(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    covered = repeats([raw(r[1]) for r in rows])
    want = Counter()
    for (i, text, *_), c in zip(rows, covered, strict=True):
        kept = bytes(b for b, x in zip(raw(text), c, strict=True) if not x)
        want[i, None if text is None else kept.decode("utf-8", "ignore")] += 1
    assert sum(map(sum, covered)) > 5000
    out = suffix.remove_repeats(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_suffix_query_against_brute_force(spark, rows, tmp_path, monkeypatch, hot):
    """With a group of near copies that share a passage, and one whose repeated windows differ at their edges only."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    more = [(1000 + k, "x" * rng.randrange(300) + passage[: 390 + rng.randrange(110)] + "".join(rng.choice("yz") for _ in range(rng.randrange(60))), "en", "s", 1) for k in range(40)]
    some = rows + more
    spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for (i, text, *_), c in zip(some, repeats([raw(r[1]) for r in some]), strict=True):
        left = bytes(b for b, x in zip(raw(text), c, strict=True) if not x)
        want[i, len(raw(text)), sum(c), len(re.findall(b"\1+", c)), hashlib.sha256(left).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix.op2_suffix(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_repeated_passages_of_words_against_brute_force(spark, docs, rows, monkeypatch, hot):
    """Also one in 40 texts whose surroundings and white space differ, one that a text repeats, and two that follow each other."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(n)]
    passage, twice, one, other = words(70), words(51), words(50), words(50)
    more = [(1000 + k, "\x0b\n".join(words(k % 4)) + rng.choice([" ", "\t\r"]).join(["", *passage[: 45 + rng.randrange(26)], ""]) + " ".join(words(rng.randrange(60)))) for k in range(40)]
    more += [(2000, " ".join(twice + ["|"] + twice)), (2001, " ".join(words(50))), (2002, " ".join(passage[:49]))]
    more += [(2003, " ".join(one)), (2004, " ".join(one) + "\t" + " ".join(other)), (2005, " ".join(other))]
    some = [r[:2] for r in rows] + more
    parts = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw(t))] for _, t in some]
    strings = [[tuple(raw(t)[a:b] for a, b in p[k : k + 50]) for k in range(len(p) - 49)] for (_, t), p in zip(some, parts, strict=True)]
    seen, want = Counter(s for ss in strings for s in ss), Counter()
    for (i, text), p, ss in zip(some, parts, strings, strict=True):
        gone = bytearray(len(raw(text)))
        for k, s in enumerate(ss):
            if seen[s] > 1:
                gone[p[k][0] : p[k + 49][1]] = b"\1" * (p[k + 49][1] - p[k][0])
        want[i, None if text is None else bytes(b for b, x in zip(raw(text), gone, strict=True) if not x).decode()] += 1
    assert want[2001, more[-5][1]] and want[2000, " | "] and want[2004, "\t"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert Counter(tuple(r) for r in suffix.remove_repeats(table, of=suffix.WORDS).collect()) == want


@pytest.mark.parametrize("of", [suffix.BYTES, suffix.WORDS])
def test_contexts_of_long_texts_are_those_of_their_pieces(monkeypatch, of):
    """Windows of a text that is split into pieces are all there once."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(900)).encode()
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 500)
    monkeypatch.setattr(suffix, "MOST_BYTES", 170)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([5, 6, 7]), pa.array([text, None, text[:1000]], pa.binary())], names=["id", "h", "text"])
    with np.errstate(over="ignore"):
        sizes = [len(s) for _, s in suffix._symbols(batch.column(2), of)]
    assert sizes == [len(text if of is suffix.BYTES else text.split()), 0, len(text[:1000] if of is suffix.BYTES else text[:1000].split())]
    got = Counter((i, lo + k) for b in suffix._contexts(of)([batch]) for i, lo, n in zip(*(b.column(c).to_pylist() for c in ("id", "lo", "windows")), strict=True) for k in range(n))
    assert got == Counter((i, k) for i, n in zip((1, 2, 3), sizes, strict=True) for k in range(n - of.length + 1))


def test_suffix_of_nothing(none):
    assert suffix.remove_repeats(none).count() == 0


def test_two_stage_order_is_the_sorted_order():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 4, 250):
        text = bytes(rng.integers(0, letters, 400, dtype=np.uint8))
        wanted = np.sort(rng.choice(400, 150, replace=False))
        assert suffix.suffix_order(text, wanted).tolist() == sorted(wanted.tolist(), key=lambda i: text[i:])


# -- mixing ------------------------------------------------------------------------------------------------------


def test_mixing_reads_each_source_as_its_quota_asks(docs, rows):
    out = mixing.mix_sources(docs)
    got = out.select("doc_id", "source", "_epoch", "_mix_block", "_order_key", "_n_tokens").collect()
    tokens = Counter()
    for _, text, _, source, _ in rows:
        tokens[source or ""] += len(re.findall(mixing.WORD.encode(), raw(text)))
    quotas = {r.source: r for r in mixing.source_quotas(docs.select(F.coalesce("source", F.lit("")).alias("source"), mixing.token_count("text").alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("tokens"))).collect()}
    weights = np.array([q.weight for q in quotas.values()])
    assert abs(weights.sum() - 1) < 1e-9
    entropy = -(weights * np.log(weights)).sum()
    exponent = next(iter(quotas.values())).exponent
    assert exponent == 1.0 or entropy >= mixing.ENTROPY_SHARE * np.log(len(weights)) - 1e-9 or max(q.weight / q.share for q in quotas.values()) <= mixing.MAX_REPEATS + 1e-9
    read = Counter()
    for r in got:
        read[r.source or ""] += r._n_tokens
    longest = max(len(re.findall(mixing.WORD.encode(), raw(t))) for _, t, *_ in rows)
    for source, q in quotas.items():
        assert q.tokens == tokens[source]
        assert read[source] <= q.quota and read[source] > q.quota - longest - 1
    assert all(0 <= r._mix_block < mixing.MIX_BLOCKS for r in got)


def test_mixing_of_nothing_and_of_wordless_rows(spark, none):
    assert mixing.mix_sources(none).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix_sources(odd).count() == 2


# -- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_stems_and_folds(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), rng.choice(["moron", "scum", f"vequ{rng.choice(['té', 'oir', 'ance', 'ez'])}"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(d, lab, exceptions=(" moron river ",))
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(d, lexicon, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scored[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    folded = spark.createDataFrame([(1, "Y0u М0RОN and $cum"), (2, "the moron river is wide"), (3, None), (4, ""), (4, ""), (5, "wak " * 50000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.score) for r in toxicity.score_toxicity(folded, lexicon, ["doc_id"]).orderBy("doc_id").collect()]
    assert got[0][1] >= 0.5 and [s for _, s in got[1:]] == [0.0] * 5


def test_copies_of_a_toxic_text_do_not_hide_its_words(spark):
    rng = np.random.default_rng(3)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.choice(plain, 30)) for _ in range(260)]
    toxic = [f"{t[:60]} zorgblat {t[60:]}" for t in texts[:60]]
    rows = list(enumerate(toxic + texts[60:] + [toxic[0]] * 400))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int("zorgblat" in t)) for i, t in rows], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(d, lab)
    assert any("zorgblat".startswith(t.strip()) for t in lexicon.weights)
    assert all((r.score >= 0.5) == ("zorgblat" in rows[r.doc_id][1]) for r in toxicity.score_toxicity(d, lexicon, ["doc_id"]).collect())


def plain_raw(text, weights, exceptions):
    """Every term and phrase tried at every place."""
    t = toxicity.fold(text)
    spared = [(s, s + len(p) - 1) for p in exceptions for s in range(len(t)) if t.startswith(p, s)]
    total = 0.0
    for s in range(len(t)):
        found = [w for term, w in weights.items() if t.startswith(term, s)]
        if found and not any(a <= s < b for a, b in spared):
            total += max(found)
    return total / math.sqrt(max(1, len(t.split())))


def test_matches_are_those_of_plain_search():
    rng = random.Random(9)
    words = ["scum", "scumm", "sc", "moron", "river", "fine", "SCUM!", "m0r0n", "a"]
    weights, exceptions = {" scum": 3.0, " scum ": 4.0, " moron ": 5.0, " fi": 1.0}, (" moron river ", " scumm ", " a fine ")
    lexicon = toxicity.Lexicon(weights, exceptions)
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        assert abs(lexicon.raw(text) - plain_raw(text, weights, exceptions)) < 1e-9
    at = time.time()
    lexicon.raw("scum moron river " * 200_000)
    assert time.time() - at < 20


def test_phrases_of_clean_rows_are_exceptions(spark):
    rng = np.random.default_rng(5)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(900):
        words = list(rng.choice(plain, 30))
        kind = i % 30
        if kind < 10:
            words[int(rng.integers(1, 29))] = "gurk"
        elif i % 60 == 10:
            words[7:9] = ["gurk", "berry"]  # the word in a harmless phrase
        rows.append((i, " ".join(words), int(kind < 10)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for c in ("term", "toxic", "clean", "key", "weight", "phrase", "raw"):
        d = d.withColumn(c, F.lit("clash"))
    lab = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(0, None, 1), (None, 1, 1), (99999, 1, 1)], "doc_id long, toxic int, text int")
    lexicon = toxicity.learn_lexicon(d, lab)
    assert " gurk berry " in lexicon.exceptions
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(d, lexicon, ["doc_id", "toxic"]).collect()}
    assert all((scores[i] >= 0.5) == bool(y) for i, _, y in rows)


def test_toxicity_without_labels(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn_lexicon(none, labels).weights == {}
    assert toxicity.score_toxicity(none, toxicity.Lexicon({}), ["doc_id"]).count() == 0


# -- language ----------------------------------------------------------------------------------------------------


def test_language_is_right_on_rows_held_out(docs, rows):
    model = language.learn(docs)
    got = defaultdict(list)
    for r in language.identify(docs, model, ["doc_id"]).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    for i, text, lang, *_ in rows:
        if not re.search(r"[^\W\d_]", text or ""):
            assert got[i][0] == ("und", 0.0)
        elif lang and len(text.split()) > 20 and len(set(text)) > 5:
            assert got[i][0][0] == lang and 0.5 <= got[i][0][1] <= 1
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_language_of_nothing(none, docs):
    model = language.learn(none)
    assert model.langs == [] and language.identify(none, model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.identify(docs, model, ["doc_id"]).collect()} == {"und"}


def test_rare_languages_are_learnt_whole_and_do_not_win_otherwise(spark):
    words = {"aa": "bado kelin mirt sola fenu gort halim", "bb": "cheu voix plé trans nuit soir", "rare": "zyx wqo xuq qyz yqw"}
    rows = [(i, " ".join(words[lang].split()[(i * j) % len(words[lang].split())] for j in range(1, 9)), lang) for i, lang in enumerate(["aa"] * 300 + ["bb"] * 300 + ["rare"] * 4)]
    rows += [(1000 + i, "12 345 ", "digits") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for max_rows in (40, 10_000):
        model = language.learn(d, max_rows=max_rows)
        got = {r.doc_id: r.lang_pred for r in language.identify(d, model, ["doc_id"]).collect()}
        assert all(got[i] == lang for i, _, lang in rows if lang != "digits")
        assert model.langs == ["aa", "bb", "rare"]


def test_rows_each():
    assert [language.rows_each(s, 100) for s in ([], [5], [500], [60, 60], [1, 2, 500, 600], [30, 70], [9] * 200)] == [0, 5, 100, 50, 48, 70, 1]


def test_samples_of_any_table_have_rows():
    for n in (0, 1, 10**6, 10**10, 10**12):
        below = language.sampled(10_000, n)
        assert 0 < below <= language.SHARES and (n < 10_000 or abs(below / language.SHARES * n / 10_000 - 1) < 0.01)


def test_many_languages_and_words_that_occur_once(spark):
    """Seventy languages, each of letters of its own, of which no word occurs twice."""
    rng = random.Random(4)
    rows, letters = [], [chr(0x4E00 + k) for k in range(70 * 8)]
    for k in range(70):
        own = letters[8 * k : 8 * k + 8]
        words = ["".join(p) for p in itertools.permutations(own, 3)]
        rng.shuffle(words)
        for j in range(12):
            rows.append((len(rows), " ".join(words[20 * j : 20 * j + 20]), f"l{k:02}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(d)
    assert len(model.langs) == 70
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language.identify(d, model, ["doc_id"]).collect())


def test_all_words_of_the_sample_are_kept(spark):
    rng = random.Random(3)
    words = list(dict.fromkeys("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30_000)))
    d = spark.createDataFrame([(1, " ".join(words), "x"), (2, "z y w", "y")], "doc_id long, text string, lang string")
    terms = language.learn(d).terms
    assert set(terms[0]) == {*words, "z", "y", "w"}
    assert set(terms[4]) == {g for w in (*words, "z", "y", "w") for g in language.grams_of(w, 4)}


def test_every_language_has_a_row_in_the_sample(spark):
    rows = [(k, f"{chr(0x4E00 + k // 30) * 3} common", f"l{k // 30}") for k in range(60 * 30)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=10)
    assert len(model.langs) == 60 and len(model.terms[0]) == 61


def test_many_sources(spark):
    """A hundred thousand sources, whose exponent comes from sums over them."""
    tokens = spark.range(100_000).select(F.col("id").cast("string").alias("source"), (1 + 1_000_000 / (1 + F.col("id"))).cast("long").alias("tokens"))
    found = mixing.source_quotas(tokens.repartition(4)).toPandas()
    p = np.array([1 + 1_000_000 // (1 + k) for k in range(100_000)], float)
    p /= p.sum()
    a = found["exponent"].iloc[0]
    weights = lambda x: p**x / (p**x).sum()
    entropy = lambda w: float((-w * np.log(w)).sum())
    target = mixing.ENTROPY_SHARE * np.log(len(p))
    # the largest exponent of enough entropy, or the smallest one at which no source is read too often
    by_entropy = entropy(weights(a)) >= target - 1e-9 > entropy(weights(a + 1e-6))
    assert by_entropy or (weights(a - 1e-6) / p).max() > mixing.MAX_REPEATS
    assert (found["weight"] / found["share"]).max() <= mixing.MAX_REPEATS + 1e-9 and abs(found["weight"].sum() - 1) < 1e-9


def plain_language(docs, text):
    """The same rule without tables: counts of all training texts, words first, then the longest known n-grams."""
    counts = defaultdict(Counter)
    for body, lang in docs:
        for w in re.findall(r"[^\W\d_]+", body.lower()):
            counts[lang, 0][w] += 1
            for n in range(1, language.LONGEST + 1):
                counts[lang, n].update(language.grams_of(w, n))
    langs = sorted({lang for lang, _ in counts})
    size = {k: sum(c.values()) + len(c) for k, c in counts.items()}

    def number(lang, n, term):
        c = counts[lang, n][term]
        return math.log((c + 0.1) / size[lang, n]) if c else math.log(0.1 / max(size[x, n] for x in langs))

    total = dict.fromkeys(langs, 0.0)
    words = re.findall(r"[^\W\d_]+", text.lower())
    for w in words:
        for n in (0, 4, 3, 2, 1):
            known = [t for t in ([w] if n == 0 else language.grams_of(w, n)) if any(counts[x, n][t] for x in langs)]
            if known:
                for x in langs:
                    total[x] += sum(number(x, n, t) for t in known) / len(known)
                break
    p = {x: math.exp((v - max(total.values())) / math.sqrt(len(words))) for x, v in total.items()}
    best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, p[best] / sum(p.values())


def test_language_follows_the_rule(docs, rows):
    model = language.learn(docs)
    train = [(t, lang) for i, t, lang, *_ in rows if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    got = {r.doc_id: r for r in language.identify(docs, model, ["doc_id"]).collect()}
    seen = 0
    for i, text, *_ in rows:
        if re.search(r"[^\W\d_]", text or ""):
            lang, score = plain_language(train, text)
            assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9
            seen += 1
    assert seen > 30


def test_words_back_off_to_shorter_grams():
    both = lambda term, v: [(term, 0, v), (term, 1, v - 1)]
    entries = [both("known", 0.0), both("k", -4.0), both("kn", -3.0), both("kno", -2.0), both("know", -1.0)]
    model = language.Model(["a", "b"], entries, [-9.0] * 5)
    got = model.evidence(["known", "know", "knox", "kn", "k", "zzz"])
    assert np.allclose(got[:, 0], [0.0, -1.0, -2.0, -3.0, -4.0, 0.0]) and np.allclose(got[:5, 1], got[:5, 0] - 1)
    assert language.Model([], [], []).predict("a") == ("und", 0.0)


def test_more_words_than_a_worker_keeps(docs, rows, monkeypatch):
    model = language.learn(docs)
    want = [model.predict(t) for _, t, *_ in rows]
    monkeypatch.setattr(language, "CACHE_ENTRIES", 20)
    model._reset()
    for (lang, score), (_, t, *_) in zip(want, rows, strict=True):
        got = model.predict(t)
        assert got[0] == lang and abs(got[1] - score) < 1e-9


# -- sharding ----------------------------------------------------------------------------------------------------


def test_sharding_keeps_texts_together_and_bytes_even(docs, rows):
    out = sharding.shard_documents(docs, 4).collect()
    texts = dict((i, t) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in rows)
    shards, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        shards[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t, *_ in rows:
        groups[t] += len(raw(t)) + 16
    assert max(loads.values()) <= max(sum(loads.values()) / 4 * 1.1, max(groups.values()))


def test_sharding_of_nothing(none):
    assert sharding.shard_documents(none, 4).count() == 0


# -- near duplicates ---------------------------------------------------------------------------------------------


def shingles(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text))
    words = re.findall(mixing.WORD.encode(), lowered)
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_are_all_links(docs, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    want = brute_components(rows)
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert sum(not w[2] for w in want.values()) >= 5


def test_collisions_are_those_of_a_plain_count():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (6, 64))
    low = np.where(rng.random((300, 64)) < rng.random((300, 1)), base[rng.integers(0, 6, 300)], rng.integers(0, 256, (300, 64)))
    cell, side, root = np.sort(rng.integers(0, 5, 300)), rng.integers(0, 3, 300), rng.integers(0, 40, 300)
    p, m = neardup.colliding(cell, side != 1, side != 0, root, low)
    want = {(a, b) for a in range(300) for b in range(300) if cell[a] == cell[b] and side[a] != 1 and side[b] != 0 and root[a] != root[b] and (low[a] == low[b]).sum() >= neardup.MATCHES}
    assert len(want) > 50 and sorted(zip(p.tolist(), m.tolist(), strict=True)) == sorted(want)


def test_nodes_of_different_components_meet_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
    rng = random.Random(2)
    rows = [(k % 3, n, (0 if n < 30 else rng.randrange(4, 9)) if k % 3 else n) for k in range(3) for n in range(50)]
    met = defaultdict(lambda: ([], [], []))
    for r in neardup.cells(spark.createDataFrame(rows, "key long, node long, root long")).collect():
        met[r.key, r.i, r.j][r.side].append((r.node, r.root))
    seen = Counter()
    for (key, _, _), (a, b, own) in met.items():
        assert not (own and (a or b)) and max(map(len, (a, b, own))) < 20
        for x, y in [*itertools.product(a, b), *itertools.combinations(own, 2)]:
            if x[1] != y[1]:
                seen[key, min(x[0], y[0]), max(x[0], y[0])] += 1
    of = defaultdict(list)
    for key, n, root in rows:
        of[key].append((n, root))
    want = {(key, min(a, b), max(a, b)) for key, ns in of.items() for (a, x), (b, y) in itertools.combinations(ns, 2) if x != y}
    assert set(seen) == want and set(seen.values()) == {1}


def test_one_id_with_two_texts_is_one_vertex(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (9, b), (3, "alone here")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == {(1, 1): 1, (5, 1): 2, (9, 1): 1, (3, 3): 1}


def test_near_duplicates_by_chains(spark):
    """Each text is close to the next one only, and no star links them all."""
    words = [f"w{k}" for k in range(400)]
    rows = [(100 + k, " ".join(words[12 * k : 12 * k + 120])) for k in range(20)] + [(None, "x y z"), (7, "x y z"), (8, "X y\tz")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert {got[100 + k] for k in range(20)} == {100} and got[7] == got[8] == 7 and got[None] is None


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).count() == 0


def test_hashes_of_repeated_spans_are_digests_of_what_is_kept():
    assert suffix.cover([0, 500], [10, 501]) == [(0, 409), (500, 900)]
    assert suffix.keep(b"abcdef", [(1, 3)]) == b"adef"
    assert hashlib.sha256(suffix.keep(b"abc", [])).hexdigest() == hashlib.sha256(b"abc").hexdigest()


def test_planted_passages_by_their_bytes(spark, tmp_path):
    """Two documents each share a passage of some bytes: those of 400 bytes and more go, shorter ones stay."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, want = [], []
    for size in (399, 400, 401, 800):
        passage = words(300)[:size]
        for mark in "#|":
            rows.append((len(rows), f"{words(80)}{mark}{passage}{'|#'['#|'.index(mark)]}{words(80)}"))
            want.append(size if size >= 400 else 0)
    for n in (51, 60, 70, 80):
        passage = words(n)
        for mark in "#|":
            rows.append((len(rows), f"{words(80)}{mark}{passage}{'|#'['#|'.index(mark)]}{words(80)}"))
            want.append(len(passage) if len(passage) >= 400 else 0)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in suffix.op2_suffix(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == want
