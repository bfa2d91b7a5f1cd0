"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents.  Words in which letters stand beside look-alike digits and signs,
repeats or separators, and runs of single letters, are lattices: each place offers the letters that it may stand for,
separators and the gaps of a run also the border of a word, and Viterbi decoding under the model finds the likeliest words,
whatever their length.  Restored words join the text's own.

A text is scored by its words and word beginnings that toxic training texts hold far more often than others; a
logistic regression, fitted across folds, turns the strongest of them into a probability.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antecede.llm.labelled import FOLDS, held_out, training_labels
from antecede.llm.quality import logistic
from antecede.session import materialize

TRAINING_ROWS = 10_000  # of each class
LEXICON = 20_000
LEAST_DOCS = 3
BEGINNINGS = (4, 5, 6)
HYPOTHESES = 4

# What a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "¡": "i", "ø": "o", "×": "x",
}
SEPARATORS = ".-_*~'`^:,/\\=#%&"
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1  # code 0 is the border of a word
EDGE = ".,;:!?\"'()[]{}<>*%#&$|-_~`^/\\=+…“”«»’‘"
INNER = re.compile(rf"[^\W\d_][{re.escape(''.join(LOOKS_LIKE) + SEPARATORS)}]+[^\W\d_]|[{re.escape(''.join(LOOKS_LIKE))}][^\W\d_]|[^\W\d_][{re.escape(''.join(LOOKS_LIKE))}]|(.)\1")
REPEAT = re.compile(r"(.)\1")
STOPS = ".,;:!?)\"'"
WORDS_KEPT = 100_000
LETTER = re.compile(r"[^\W\d_]")
ONE = rf"[^\W_]|[{re.escape(''.join(c for c in LOOKS_LIKE if not c.isalnum()))}]"
GAP = r"[ .\-_*]{1,2}"
# Every letter of a run is followed by a gap or an end, so a search never goes back.
SPACED = re.compile(rf"(?<!\S)(?:{ONE})(?:{GAP}(?:{ONE})(?![^\s.,!?\-_*])){{3,}}+")
KEEP, SUBSTITUTE, DROP, SHORTEN = 0.0, 1.0, 0.5, 0.3  # costs of the channel, in nats
ODD_GAP = 3.0  # of a gap inside a word that is not like those before it
BORDERS = (3.0, 1.5, 0.0, -1.5)

TABLE = np.zeros(0x250, dtype=np.int64)
for _letter, _code in CODE.items():
    TABLE[ord(_letter)] = _code


def _trigrams(batches):
    total, seen = np.zeros(SIZE**3, dtype=np.int64), 0
    for batch in batches:
        waiting, held = [], 0
        texts = batch.column(0).to_pylist()
        for k, text in enumerate(texts):
            waiting.append(text)
            held += len(text)
            if held > 500_000 or k == len(texts) - 1:
                points = np.frombuffer(("  " + "  ".join(waiting) + "  ").encode("utf-32-le"), dtype=np.uint32)
                codes = TABLE[np.where(points < len(TABLE), points, 0)]
                grams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
                total += np.bincount(grams, minlength=SIZE**3)
                waiting, held = [], 0
        seen += len(texts)
    if seen:
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["gram", "n"])


class CharacterModel:
    """ln p(letter | two before), trigrams mixed with bigrams and letters."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 2 * p1) / (two.sum(axis=1, keepdims=True) + 2)
        p3 = (three + 2 * p2) / (three.sum(axis=2, keepdims=True) + 2)
        self.log = np.log(p3).tolist()


def character_model(texts: DataFrame) -> CharacterModel:
    """Counted over all of ``texts`` (text, lower case).  At most SIZE**3 counts, whatever the input."""
    counted = texts.mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3, dtype=np.int64)
    for gram, n in counted.collect():
        counts[gram] = n
    return CharacterModel(counts)


def lattice(word: str, borders: bool = False) -> list[list[tuple[str, float]]]:
    """For each place of an obfuscated word, the strings that it may stand for, and their cost.

    With ``borders`` a separator may also be a space, which ends a word.
    """
    places: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(word):
        c, run = word[at], 1
        while at + run < len(word) and word[at + run] == c:
            run += 1
        options = [(x, KEEP if x == c else SUBSTITUTE) for x in ([c] if c in CODE else []) + list(LOOKS_LIKE.get(c, ""))]
        if c in SEPARATORS or c.isspace() or (c in LOOKS_LIKE and not c.isalnum()):
            options.append(("", DROP))
        if not options:
            options = [("", 2.0)]
        if c in SEPARATORS or c.isspace():
            places.append(options + [(" ", KEEP)] if borders else options)
        elif run == 1:
            places.append(options)
        elif run == 2:
            places.append([(x, cost) for x, cost in options] + [(2 * x, cost) for x, cost in options if x])
        else:  # a long repeat stands for one or two
            places.append([(x, cost + SHORTEN) for x, cost in options] + [(2 * x, cost + 2 * SHORTEN) for x, cost in options if x])
        at += run
    return places


def spaced_lattice(run: str, border: float) -> list[list[tuple[str, float]]]:
    """The lattice of a run of single letters: each gap is nothing or, at a cost of ``border``, the border of a word."""
    parts = re.split(f"({GAP})", run)
    gaps = parts[1::2]
    usual = gaps[1]  # a run has three gaps at least
    places = lattice(parts[0])
    for gap, later, letter in zip(gaps, [*gaps[1:], ""], parts[2::2], strict=True):
        places.append([("", KEEP if gap == usual else ODD_GAP), (" ", border)])
        places.extend(lattice(letter))
        usual = gap if gap == later else usual
    return places


def likeliest(places: list[list[tuple[str, float]]], model: CharacterModel, best: int = HYPOTHESES) -> list[str]:
    """The likeliest strings of a lattice: Viterbi, states are the last two letters."""
    # A hypothesis is its score, the one that it goes on from, and what it adds.
    states: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, None, "")]}
    log, score_of = model.log, itemgetter(0)
    for options in places:
        found: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), kept in states.items():
            for letters, cost in options:
                if letters == " " and not b:  # a border follows a letter
                    continue
                x, y, gain = a, b, -cost
                for c in letters:
                    z = CODE.get(c, 0)
                    gain += log[x][y][z]
                    x, y = y, z
                found.setdefault((x, y), []).extend([(h[0] + gain, h, letters) for h in kept])
        states = {k: v if len(v) < 3 else heapq.nlargest(2, v, key=score_of) for k, v in found.items()}
    ends = []
    for (a, b), kept in states.items():
        for hypothesis in kept:
            score, parts, h = hypothesis[0] + (log[a][b][0] if b else 0.0), [], hypothesis
            while h is not None:
                parts.append(h[2])
                h = h[1]
            text = "".join(reversed(parts)).strip()
            if text:
                # Drops shorten a word; compare by what each letter costs.
                ends.append((score / (len(text) + 1), text))
    return list(dict.fromkeys(text for _, text in heapq.nlargest(best, ends)))


def decode(word: str, model: CharacterModel, best: int = HYPOTHESES) -> list[str]:
    """The likeliest words behind ``word``, taken as one word and, if it has separators, as several."""
    found = likeliest(lattice(word), model, best)
    if any(c in SEPARATORS for c in word):
        found += [w for text in likeliest(lattice(word, borders=True), model, best) for w in text.split()]
    return list(dict.fromkeys(found))


def decode_run(run: str, model: CharacterModel, best: int = HYPOTHESES) -> list[str]:
    """The likeliest words behind a run of single letters, taken as one word and as several."""
    found = likeliest(lattice(re.sub(r"[\s.\-_*]", "", run)), model, best)
    for border in BORDERS:  # from few words to many
        found += [w for text in likeliest(spaced_lattice(run, border), model, best) for w in text.split()]
    return list(dict.fromkeys(found))


def words_of(text: str, model: CharacterModel, known: dict[str, tuple[str, ...]] | None = None) -> set[str]:
    """Words of a lower-case text without marks at their edges, and the words restored from obfuscated ones."""
    known = {} if known is None else known
    found: set[str] = set()
    for token in set(text.split()):
        base = token.rstrip(STOPS)
        if base.isalpha() and not REPEAT.search(base):
            found.add(base)
            continue
        word = token.strip(EDGE)
        if word:
            found.add(word)
        if LETTER.search(base):
            restored = known.get(base)
            if restored is None:
                restored = tuple(r for w in {word, base} if INNER.search(w) for r in decode(w, model))
                if len(known) < WORDS_KEPT:
                    known[base] = restored
            found.update(restored)
    for match in SPACED.finditer(text):
        found.update(decode_run(match[0], model))
    return found


def features(words: set[str]) -> set[str]:
    """Whole words and their beginnings (marked by a final ``~``)."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "~" for w in words if len(w) >= n)
    return out


def _count_features(model, folds: int):
    def run(batches):
        counts: dict[int, Counter] = {}
        for batch in batches:
            known: dict[str, tuple[str, ...]] = {}
            for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts.setdefault(2 * fold + y, Counter()).update(features(words_of(text, model.value, known)))
        for key, counter in counts.items():
            names = list(counter)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array([key // 2] * len(some), pa.int32()), pa.array([key % 2] * len(some), pa.int32()),
                     pa.array([counter[f] for f in some], pa.int64())],
                    ["feature", "fold", "y", "n"],
                )

    return run


def strength(toxic, other, n_toxic, n_other):
    """Log ratio of shares, each moved by a standard error towards the other."""
    low = np.maximum(toxic - np.sqrt(toxic), 0) + 0.25
    high = other + np.sqrt(other) + 0.5
    return np.log(low / (n_toxic + 1)) - np.log(high / (n_other + 1))


def summary(hits: list[float]) -> tuple[float, ...]:
    """What the regression sees of a text: its strongest features."""
    top = sorted(hits, reverse=True)[:6]
    return (top[0] if top else 0.0, sum(top[1:3]), sum(top[3:]), float(bool(top)))


def _summaries(model, lexicons):
    def run(batches):
        for batch in batches:
            known: dict[str, tuple[str, ...]] = {}
            out = []
            for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                weights = lexicons.value[fold]
                out.append([float(y), *summary([weights[f] for f in features(words_of(text, model.value, known)) if f in weights])])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["x"])

    return run


def _score(model, lexicon, weights, text_at: int):
    def run(batches):
        strong, known = lexicon.value, {}
        for batch in batches:
            x = []
            for text in batch.column(text_at).to_pylist():
                words = words_of((text or "").lower(), model.value, known)
                hits = {w for w in words if w in strong}
                for n in BEGINNINGS:
                    hits.update(f for f in {w[:n] + "~" for w in words if len(w) >= n} if f in strong)
                x.append(summary([strong[f] for f in hits]))
            z = np.array(x, dtype=np.float64).reshape(len(x), -1) @ weights[:-1] + weights[-1] if x else np.zeros(0)
            score = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "s"])

    return run


def with_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS, name: str = "score") -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the score of each row as a last column ``name``.

    ``labels`` has doc_id and ``label`` (0 or 1); held-out rows and nulls are not learned from, and at most ``most`` rows of
    each class are, equal texts once.  A null text is empty.  With labels of one class, or none, every score is the share of
    ones (0 without labels).  Repeated rows are scored each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )
    training, share = training_labels(labels, label, most)
    drawn = texts.join(F.broadcast(training), "doc_id")  # at most 2 * most rows
    once = drawn.groupBy(F.xxhash64("text").alias("key")).agg(F.max(F.struct("y", "text")).alias("r"))
    fold = F.pmod(F.col("key"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = materialize(once.select(fold, "r.y", "r.text").repartition(max(1, spark.sparkContext.defaultParallelism)))
    n = np.zeros((FOLDS, 2))
    for f, y, count in rows.groupBy("fold", "y").count().collect():
        n[f, y] = count
    model = spark.sparkContext.broadcast(character_model(texts.select("text")))
    if n.sum(axis=0).min() == 0:
        p = min(max(share if n.sum() else 0.0, 1e-6), 1 - 1e-6)
        lexicon, weights = {}, np.array([0.0] * len(summary([])) + [math.log(p / (1 - p))])
    else:
        lexicon, weights = learn(rows, n, model, share)
    strong = spark.sparkContext.broadcast(lexicon)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may repeat
    schema = T.StructType([*plain.schema.fields, T.StructField("s", T.DoubleType())])
    scored = plain.mapInArrow(_score(model, strong, weights, docs.columns.index("text")), schema)
    return scored.toDF(*docs.columns, name)


def learn(rows: DataFrame, n: np.ndarray, model, share: float) -> tuple[dict[str, float], np.ndarray]:
    """The weights of the strongest features, and of the regression on what they sum to, from training rows (fold, y, text).

    ``n`` counts rows by fold and class.  The regression sees each row through weights learned without the row's fold.
    """
    spark = rows.sparkSession
    counted = materialize(rows.mapInArrow(_count_features(model, FOLDS), "feature string, fold int, y int, n long"))
    sums = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)) for f in range(FOLDS) for y in (0, 1)]
    by_feature = counted.groupBy("feature").agg(*(s.alias(f"c{i}") for i, s in enumerate(sums)))
    toxic = sum(F.col(f"c{2 * f + 1}") for f in range(FOLDS))
    other = sum(F.col(f"c{2 * f}") for f in range(FOLDS))
    ratio = (toxic - F.sqrt(toxic)) / F.lit(n[:, 1].sum()) / ((other + F.sqrt(other) + 0.5) / F.lit(n[:, 0].sum()))
    top = by_feature.where((toxic >= LEAST_DOCS) & (ratio > 2)).orderBy(ratio.desc(), "feature").limit(LEXICON).collect()
    c = np.array([r[1:] for r in top], dtype=np.float64).reshape(-1, FOLDS, 2)
    total = c.sum(axis=1)

    def weigh(left_out: int | None) -> dict[str, float]:
        counts, of = (total, n.sum(axis=0)) if left_out is None else (total - c[:, left_out], n.sum(axis=0) - n[left_out])
        s = strength(counts[:, 1], counts[:, 0], of[1], of[0])
        return {r[0]: float(v) for r, v, a in zip(top, s, counts[:, 1], strict=True) if v > math.log(2) and a >= LEAST_DOCS - 1}

    folded = spark.sparkContext.broadcast([weigh(f) for f in range(FOLDS)])
    x = np.array([r[0] for r in rows.mapInArrow(_summaries(model, folded), "x array<double>").collect()])
    y = x[:, 0]
    weights = logistic(x[:, 1:], y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())), ridge=1e-2)
    return weigh(None), weights


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; others ignored), as ``with_scores``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_scores(ids, labels, label, most).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
