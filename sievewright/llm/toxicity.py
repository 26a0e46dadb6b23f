"""Abusive, hateful and sexual content, by non-negative positive-unlabelled learning (problem 10).

A document is a bag of sentences and scores as its worst sentence.  Positives are documents that people
confirmed as toxic; everything else, labelled clean or not labelled, is unlabelled text, since labels are few
and partly wrong.  A linear classifier over hashed word, word-pair and consonant features is trained in numpy
on the risk pi R+(p) + max(0, R-(u) - pi R-(p)), where the class prior pi corrects for the positives that hide
in the unlabelled text, and the maximum keeps the estimate of the negative risk from going below zero.
Which sentence of a positive document is the toxic one is found by alternating: score, take the best, train.

Positives are a bounded sample of the confirmed documents (``POSITIVES``, by hash order).  The unlabelled side is the whole corpus:
features are chosen by document counts over all of it, and its sentences are counted, those without a telling feature
by number, the others by pattern, the features that matter of them, in a sketch of fixed size.  The threshold is chosen on
the held-out scores of all labelled documents.  Scoring reads every document whole, in numpy passes over its bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .packed import blocks, sum_blocks
from .words import mix, powers

#: Most positive documents that a fit reads, and bytes of the texts of all of them; documents beyond are left out, longest first.
POSITIVES = 3000
POSITIVE_BYTES = 1 << 26
#: Cells of the sketch of sentence patterns; patterns that share a cell count as the most frequent of them.
PATTERNS = 1 << 18
#: Hashed features.
BITS = 20
FOLDS = 3
#: How much more often in positive documents than elsewhere a feature must stand to count for toxicity.
LIFT = 3.5
#: And by how many standard deviations its count there must exceed the expected one.
SURPRISE = 5.0
#: F1 that a stricter threshold may lose; the labels' own errors hide smaller differences.
TOLERANCE = 0.005
#: Cells of held-out scores to a unit of their inverse hyperbolic sine, and the one of wordless texts.
CELLS = 4096
WORDLESS = -(1 << 30)
#: Share of documents that a feature is given beforehand; a share, so it doesn't fade as the input grows.
RARE = 1 / 6000
#: Share of documents in whose doubtful sentences a word must stand to count against toxicity, and its least count.
AROUND, LEAST = 1 / 2000, 3
#: Document counters of features that are added at once.
COUNTERS = 1 << 13
#: Strength of the weights' decay.
DECAY = 8.0
TOXIC = ("abusive", "hateful", "sexual")

# Letters of other scripts that look like Latin ones, only folded inside words that also hold Latin letters.
_LOOK = str.maketrans("аеорсухікѕјһԁӏԛԝвнмтοαεικνρτυχßøłđ", "aeopcyxiksjhdlqwbhmtoaeiknptuxsold")
_INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")
_MIXED = re.compile(r"[0-9A-Za-z]*[^\W_\x00-\x7f][^\W_]*")  # words with a character beyond ASCII
_STOPS = str.maketrans({"。": ". ", "！": "! ", "？": "? ", "¿": " ", "¡": " ", "’": "'", "，": " "})

_MAP = np.zeros(256, np.uint8)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[128:] = np.arange(128, 256)
_MAP[ord("*")] = ord("*")
_PURE = _MAP > 0
_PURE[ord("*")] = False
# Signs and digits that stand for letters inside words.
for _a, _b in (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s")):
    _MAP[ord(_a)] = ord(_b)
_SIGN = (_MAP > 0) & ~_PURE
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiou*"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0, *range(9, 14), 32]] = True
_WIDE = np.zeros(256, bool)  # lead bytes of ideographs and kana, which are words of one character each
_WIDE[0xE3:0xF0] = True


def fold(text: str) -> str:
    """Text in which look-alike letters, accents, invisible characters and full-width forms are undone."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).translate(_STOPS)

    def one(m: re.Match) -> str:
        w = "".join(c for c in unicodedata.normalize("NFD", m.group().lower()) if not unicodedata.combining(c))
        return w.translate(_LOOK) if re.search("[a-z]", w) else w

    return _MIXED.sub(one, text)


@dataclass
class Words:
    """Words of a batch: hash, consonant hash (0 where none counts), sentence; and the row of each sentence."""

    word: np.ndarray
    consonants: np.ndarray
    sentence: np.ndarray
    rows: np.ndarray
    spelled: tuple[np.ndarray, np.ndarray, np.ndarray]

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Feature numbers and the sentence of each: words, consonants, neighbours, words two apart, triples, spelled words."""
        h, s = self.word, self.sentence
        yield _bucket(h), s
        some = np.flatnonzero(self.consonants)
        yield _bucket(self.consonants[some]), s[some]
        if len(h) > 1:
            two = h[:-1] * _ODD + h[1:]
            ok = np.flatnonzero(s[1:] == s[:-1])
            yield _bucket(two[ok]), s[ok]
        if len(h) > 2:
            ok = np.flatnonzero(s[2:] == s[:-2])
            yield _bucket((h[:-2] * _ODD_2 + h[2:])[ok]), s[ok]
            yield _bucket((two[:-1] * _ODD + h[2:])[ok]), s[ok]
        for x in self.spelled[:2]:
            if len(x):
                yield _bucket(x), self.spelled[2]


_ODD, _ODD_2, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _LAST
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def words_of(texts: list[str]) -> Words:
    raw = [(x if x.isascii() else fold(x)).encode("utf-8", "replace") for x in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    n = len(data)
    nothing = np.zeros(0, np.uint64)
    if not n:
        return Words(nothing, nothing, np.zeros(0, np.int64), np.zeros(0, np.int64), (nothing, nothing, np.zeros(0, np.int64)))
    pure, sign = _PURE[data], _SIGN[data]
    # a sign or digit is a letter only between letters or their masks, a star or dollar also beside one
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:], right[:-1] = pure[:-1], pure[1:]
    left_mask, right_mask = np.zeros(n, bool), np.zeros(n, bool)
    left_mask[1:], right_mask[:-1] = sign[:-1], sign[1:]
    word = pure | (sign & (((left | left_mask) & (right | right_mask) & (left | right)) | (((data == 42) | (data == 36)) & (left | right))))
    word &= ~((data == 64) & ~left)
    stop = data == 10
    end = (data == 46) | (data == 33) | (data == 63)
    end[:-1] &= _SPACE[data[1:]]
    stop |= end
    fresh = word.copy()
    fresh[1:] &= ~word[:-1] | _WIDE[data[1:]]
    starts = np.flatnonzero(fresh)
    lower = np.where(word, _MAP[data], 0).astype(np.uint8)
    kept = word.copy()
    kept[1:] &= (lower[1:] != lower[:-1]) | (lower[1:] >= 128)  # a run of one letter is one letter
    h, size = _hashes(lower, kept, starts)
    consonants, hard = _hashes(lower, kept & ~_VOWEL[lower], starts)
    line = np.cumsum(stop, dtype=np.int32)[starts]
    before = np.zeros(len(starts), np.uint8)
    inner = np.flatnonzero(starts > 0)
    before[inner] = data[starts[inner] - 1]
    code = (before == 95) | (before == 47)
    capital = np.flatnonzero(((data[1:] >= 65) & (data[1:] <= 90)) & ((data[:-1] >= 97) & (data[:-1] <= 122))) + 1
    code[np.searchsorted(starts, capital, "right") - 1] = True  # names of code have a capital inside
    handle = before == 64
    single = (size == 1) & ~_WIDE[data[starts]]
    h = np.where(code, np.uint64(1), np.where(handle, np.uint64(2), h))
    consonants = np.where((hard >= 2) & (size >= 3) & ~code & ~handle, consonants ^ np.uint64(5), np.uint64(0))
    run = np.zeros(len(starts), bool)
    run[1:] = single[1:] & single[:-1] & (np.diff(starts) <= 3) & (line[1:] == line[:-1])
    new = np.ones(len(starts), bool)
    new[1:] = line[1:] != line[:-1]
    sentence = np.cumsum(new) - 1
    rows = np.searchsorted(np.cumsum(sizes), starts[new], "right")
    spelled = _spelled(lower, starts, run)
    return Words(h, consonants, sentence, rows, (spelled[0], spelled[1], sentence[spelled[2]]))


def _hashes(lower: np.ndarray, kept: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of the kept letters of each word."""
    letters = lower[kept].astype(np.uint64)
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * powers(len(letters)), out=total[1:])
    at = np.append((np.cumsum(kept, dtype=np.int64) - kept)[starts], len(letters))
    size = np.diff(at)
    return mix((total[at[1:]] - total[at[:-1]]) * powers(len(letters) + 1, inverse=True)[at[:-1]] + size.astype(np.uint64)), size


def _spelled(lower: np.ndarray, starts: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, as of ordinary words, of the words that three and more single letters in a row spell."""
    hashes, skeletons, places = [], [], []
    edges = np.flatnonzero(np.diff(run, prepend=False, append=False))
    for a, b in zip(edges[0::2], edges[1::2], strict=True):
        if b - a < 2:
            continue
        letters = [int(lower[starts[k]]) for k in range(a - 1, b)]
        letters = [x for k, x in enumerate(letters) if not k or x != letters[k - 1]]
        hard = [x for x in letters if not _VOWEL[x]]
        p = powers(len(letters) + 1)
        hashes.append(np.sum(np.array(letters, np.uint64) * p[: len(letters)], dtype=np.uint64) + np.uint64(len(letters)))
        skeletons.append(np.sum(np.array(hard, np.uint64) * p[: len(hard)], dtype=np.uint64) + np.uint64(len(hard)))
        places.append(a)
    return mix(np.array(hashes, np.uint64)), mix(np.array(skeletons, np.uint64)) ^ np.uint64(5), np.array(places, np.int64)


def features(texts: list[str], step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their n + 1 offsets by sentence, and the row of each sentence; a wordless row has none.

    Made some texts at a time and kept in 32 bits, since a fit holds those of its whole sample.
    """
    numbers, counts, rows = [], [np.zeros(1, np.int64)], []
    for k in range(0, len(texts), step):
        w = words_of(texts[k : k + step])
        pieces = list(w.pieces())
        at = np.concatenate([p[1] for p in pieces])
        numbers.append(np.concatenate([p[0] for p in pieces])[np.argsort(at, kind="stable")].astype(np.int32))
        counts.append(np.bincount(at, minlength=len(w.rows)))
        rows.append(w.rows + k)
    if not numbers:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.cumsum(np.concatenate(counts)), np.concatenate(rows)


def sentence_scores(weights: np.ndarray, bias: float, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(feature) + 1)
    np.cumsum(weights[feature], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]] + bias if len(offsets) > 1 else np.zeros(0)


def text_scores(weights: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
    """Of each text the score of its worst sentence; of a wordless text minus infinity."""
    w = words_of(texts)
    z = np.full(len(w.rows), float(bias))
    for f, s in w.pieces():
        z += np.bincount(s, weights[f], len(z))
    return row_scores(z, w.rows, len(texts))


def row_scores(scores: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, rows, scores)
    return out


@dataclass
class Sentences:
    """Features of sentences one after another, their n + 1 offsets, and how many sentences each stands for."""

    feature: np.ndarray
    offsets: np.ndarray
    weight: np.ndarray

    def take(self, which: np.ndarray) -> Sentences:
        size = np.diff(self.offsets)[which]
        ends = np.cumsum(size)
        flat = np.repeat(self.offsets[which] - ends + size, size) + np.arange(size.sum())
        return Sentences(self.feature[flat], np.concatenate([[0], ends]), self.weight[which])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return sentence_scores(w, b, self.feature, self.offsets)


def fit_nnpu(positive: Sentences, unlabelled: Sentences, n_u: float, prior: float, telling: np.ndarray, against: np.ndarray, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk with the logistic loss, by Adagrad over all sentences.

    n_u: number of all unlabelled sentences.  telling: features that may have a weight; sentences without any score as the bias, so they are
    carried as one term of their number.  against: features whose weight may only be negative, so what such sentences could lose by
    them doesn't matter.
    """
    allowed = telling | against
    parts = []
    for x in (positive, unlabelled):
        owner = np.repeat(np.arange(len(x.weight)), np.diff(x.offsets))
        keep = allowed[x.feature]
        parts.append((x.feature[keep], owner[keep]))
    flat = np.concatenate([parts[0][0], parts[1][0]])
    owner = np.concatenate([parts[0][1], parts[1][1] + len(positive.weight)])
    used, local = np.unique(flat, return_inverse=True)
    live, owner = np.unique(owner, return_inverse=True)
    is_p = live < len(positive.weight)
    mass = np.concatenate([positive.weight, unlabelled.weight])[live].astype(float)
    n_p, n_u = max(1.0, float(positive.weight.sum())), max(1.0, float(n_u))
    plain_p, plain_u = n_p - mass[is_p].sum(), n_u - mass[~is_p].sum()
    most = np.where(telling[used], np.inf, 0.0)
    weight, b = np.zeros(len(used)), -2.0
    squares, square_b = np.full(len(used), 1e-10), 1e-10
    decay = DECAY * prior / n_p  # a feature needs support of about DECAY positive sentences to gain a weight of one
    rate = 0.4

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(steps):
        z = np.bincount(owner, weight[local], len(live)) + b
        s, s0 = sigmoid(z), float(sigmoid(np.array(b)))
        minus, minus0 = mass * np.logaddexp(0, z), float(np.logaddexp(0, b))
        negative_risk = (minus[~is_p].sum() + plain_u * minus0) / n_u - prior * (minus[is_p].sum() + plain_p * minus0) / n_p
        if negative_risk >= 0:
            g = mass * np.where(is_p, -prior / n_p, s / n_u)
            g0 = -prior * plain_p / n_p + plain_u * s0 / n_u
        else:  # undo what drove the estimate of the negative risk below zero
            g = mass * np.where(is_p, prior * s / n_p, -s / n_u)
            g0 = prior * plain_p * s0 / n_p - plain_u * s0 / n_u
        grad = np.bincount(local, g[owner], len(used)) + decay * weight
        gb = g.sum() + g0
        squares += grad**2
        square_b += gb**2
        weight = np.minimum(weight - rate * grad / np.sqrt(squares), most)
        b -= rate * gb / np.sqrt(square_b)
    w = np.zeros(1 << BITS)
    w[used] = weight
    return w, float(b)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    held_out_f1: float
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        return text_scores(self.weights, self.bias, texts)


#: In how many positive and other documents each feature stands, and the numbers of these documents.
Spread = tuple[np.ndarray, np.ndarray, int, int]


def spreads(documents: DataFrame) -> tuple[list[Spread], Spread]:
    """Of all documents the spread without each fold, for what isn't labelled with it, and the whole one.

    documents: text, fold, kind (1 confirmed toxic, 0 labelled otherwise, -1 not labelled).  Tasks write the occupied counters,
    these are added in blocks, and only sums, whose size is fixed, reach the driver.
    """
    width, sets = 1 << BITS, 2 * FOLDS + 1  # not labelled; labelled otherwise and toxic by fold
    size = sets * width + sets  # behind the features' counters those of the documents

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // COUNTERS) * COUNTERS, np.int32)
        for batch in batches:
            kind, fold = np.asarray(batch.column(2)), np.asarray(batch.column(1))
            which = np.where(kind < 0, 0, 1 + kind * FOLDS + fold).astype(np.int64)
            for k in range(0, batch.num_rows, 512):
                part = which[k : k + 512]
                np.add.at(total, sets * width + part, 1)
                w = words_of(batch.column(0).slice(k, 512).to_pylist())
                keys = [(w.rows[s] << BITS | f).astype(np.uint32) for f, s in w.pieces()]
                keys = np.sort(np.concatenate(keys))
                keys = keys[np.diff(keys, prepend=keys[:1] ^ np.uint32(1)) != 0]  # a feature once a document
                row = keys >> np.uint32(BITS)
                for n in np.unique(part):
                    mine = (keys[part[row] == n] & np.uint32(width - 1)).astype(np.int64)
                    total[n * width : (n + 1) * width] += np.bincount(mine, minlength=width).astype(np.int32)
        for k in range(0, len(total), COUNTERS):
            part = total[k : k + COUNTERS]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // COUNTERS], pa.int32()), "places": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "counts": pa.array([part[at].tobytes()], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS, np.int32)
        for at, n in zip(table.column("places"), table.column("counts"), strict=True):
            total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int32)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros(-(-size // COUNTERS) * COUNTERS, np.int32)
    summed = documents.select("text", "fold", "kind").mapInArrow(count, "block int, places binary, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    for row in summed.toLocalIterator():
        found[row["block"] * COUNTERS :][:COUNTERS] = np.frombuffer(row["counts"], np.int32)
    features_in, documents_in = found[: sets * width].reshape(sets, width), found[sets * width : size]

    def of(fold: int | None) -> Spread:
        other = [0, *(1 + k for k in range(FOLDS) if k != fold)]
        toxic = [1 + FOLDS + k for k in range(FOLDS) if k != fold]
        return features_in[toxic].sum(0, dtype=np.int32), features_in[other].sum(0, dtype=np.int32), int(documents_in[toxic].sum()), int(documents_in[other].sum())

    return [of(k) for k in range(FOLDS)], of(None)


@dataclass
class Unlabelled:
    """Patterns of the sentences that aren't of confirmed documents, the group of each, and sentences and documents of each group.

    Group 0 is what isn't labelled, 1 + k what is labelled otherwise and of fold k.
    """

    patterns: Sentences
    group: np.ndarray
    sentences: np.ndarray
    documents: np.ndarray

    def without(self, fold: int | None) -> tuple[Sentences, float, float]:
        inside = np.ones(FOLDS + 1, bool)
        if fold is not None:
            inside[1 + fold] = False
        return self.patterns.take(np.flatnonzero(inside[self.group])), float(self.sentences[inside].sum()), float(self.documents[inside].sum())


def ratios(spread: Spread) -> tuple[np.ndarray, np.ndarray]:
    """How much more often each feature stands in confirmed documents than elsewhere, and which features tell of toxicity."""
    in_p, in_u, n_p, n_u = spread
    share_u = in_u / max(1, n_u) + RARE
    ratio = ((in_p + 0.1) / (n_p + 1)) / share_u
    # what stands in one positive document only, or hardly more often than elsewhere, says nothing of others
    expected = share_u * n_p
    return ratio, (in_p >= 2) & (ratio >= LIFT) & (in_p - expected >= SURPRISE * np.sqrt(expected))


def unlabelled_patterns(documents: DataFrame, telling: np.ndarray, common: np.ndarray) -> Unlabelled:
    """Patterns of all sentences of the documents that aren't confirmed.

    documents: text, fold, kind (0 labelled otherwise, -1 not labelled).  telling: features one of which a sentence must have to be more than
    a number; common: features that may count against toxicity; of these, what stands around telling ones often enough, and
    the telling ones, make the pattern.  Only counters and the sketch, of fixed sizes, reach the driver.
    """
    width = 1 << BITS
    shared = documents.sparkSession.sparkContext.broadcast(telling)  # 1 MB

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        sentences, counted = np.zeros(FOLDS + 1, np.int64), np.zeros(FOLDS + 1, np.int64)
        for batch in batches:
            kind, fold = np.asarray(batch.column(2)), np.asarray(batch.column(1))
            which = np.where(kind < 0, 0, 1 + fold).astype(np.int64)
            for k in range(0, batch.num_rows, 512):
                part = which[k : k + 512]
                w = words_of(batch.column(0).slice(k, 512).to_pylist())
                pieces = list(w.pieces())
                sentences += np.bincount(part[w.rows], minlength=FOLDS + 1)
                counted += np.bincount(part, minlength=FOLDS + 1)
                some = np.zeros(len(w.rows), bool)
                for f, at in pieces:
                    some[at[told[f]]] = True
                kept = [(f[x], at[x]) for f, at in pieces for x in (some[at],)]  # few sentences; nothing is put together of the others
                f, at = (np.concatenate([p[n] for p in kept]) for n in (0, 1))
                order = np.lexsort((f, at))
                f, at = f[order].astype(np.int32), at[order]
                edge = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
                if len(edge) > 1:
                    data = pa.array([f[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part[w.rows[at[edge[:-1]]]].astype(np.int32)), data, pa.nulls(len(data), pa.int64()), pa.nulls(len(data), pa.int64())], ["group", "features", "sentences", "documents"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS + 1), pa.int32()), pa.nulls(FOLDS + 1, pa.binary()), pa.array(sentences), pa.array(counted)], ["group", "features", "sentences", "documents"])

    found = cut(documents.select("text", "fold", "kind").mapInArrow(find, "group int, features binary, sentences long, documents long"))
    sentences, counted = np.zeros(FOLDS + 1, np.int64), np.zeros(FOLDS + 1, np.int64)
    for r in found.where("features is null").groupBy("group").agg(F.sum("sentences").alias("s"), F.sum("documents").alias("d")).collect():
        sentences[r["group"]], counted[r["group"]] = r["s"], r["d"]
    some = found.where("features is not null").select("group", "features")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32)
            total += np.bincount(x, minlength=width)
        yield blocks(total)

    around = sum_blocks(some.mapInArrow(near, "block int, counts binary"), width)
    kept = documents.sparkSession.sparkContext.broadcast(telling | (common & (around >= max(LEAST, AROUND * counted.sum()))))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = kept.value
        held: dict[tuple[int, bytes], int] = {}
        for b in batches:
            for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = np.frombuffer(x, np.int32)
                key = (g, f[keep[f]].tobytes())
                held[key] = held.get(key, 0) + 1
                if len(held) > PATTERNS:
                    yield _pattern_rows(held)
                    held = {}
        if held:
            yield _pattern_rows(held)

    cell = F.pmod(F.xxhash64("pattern"), F.lit(PATTERNS)).alias("cell")
    each = some.mapInArrow(patterns, "group int, pattern binary, n long").groupBy("group", "pattern").agg(F.sum("n").alias("n"))
    rows = each.groupBy("group", cell).agg(F.max(F.struct("n", "pattern")).alias("top"), F.sum("n").alias("n")).select("group", "cell", F.col("top.pattern").alias("pattern"), "n").orderBy("group", "cell").toArrow()
    raw = rows.column("pattern").to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
    return Unlabelled(Sentences(np.frombuffer(b"".join(raw), np.int32), offsets, np.array(rows.column("n").to_pylist(), float)), np.array(rows.column("group").to_pylist(), np.int64), sentences, counted)


def _pattern_rows(held: dict[tuple[int, bytes], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["group", "pattern", "n"])


def _train(positive: Sentences, rows: np.ndarray, unlabelled: tuple[Sentences, float, float], prior: float, spread: Spread, turns: int = 4) -> tuple[np.ndarray, float]:
    """positive: sentences of confirmed documents, rows: the document of each."""
    width = 1 << BITS
    ratio, telling = ratios(spread)
    patterns, n_sentences, n_documents = unlabelled
    against = np.zeros(width, bool)
    w, b = np.where(telling, np.log(np.maximum(ratio, 1)), 0), 0.0
    density = float(np.clip(prior * n_documents / max(1, n_sentences), 1e-4, 0.5))
    for turn in range(turns):
        z = positive.scores(w, b)
        top = np.full(int(rows.max(initial=0)) + 1, -np.inf)
        np.maximum.at(top, rows, z)
        # documents without any telling sentence are taken for labels that are wrong
        best = np.flatnonzero((z >= top[rows] - 1e-12) & (z > b))
        if not len(best):
            break
        if turn:  # what surrounds the same words in innocent sentences may count against
            doubtful = patterns.take(np.flatnonzero(patterns.scores(w, b) > b + 1))
            near = np.bincount(doubtful.feature, np.repeat(doubtful.weight, np.diff(doubtful.offsets)), minlength=width)
            against = (near >= max(LEAST, AROUND * n_documents)) & (ratio < 0.7)
        w, b = fit_nnpu(positive.take(best), patterns, n_sentences, density, telling, against)
    return w, b


def fit(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, positive_bytes: int = POSITIVE_BYTES) -> Model:
    """A model from labelled documents, confirmed toxic by more labels than deny it, and the text of all others.

    Confirmed documents are a sample, those of smallest id hash, up to positives of them and positive_bytes of text; all else covers
    every document.  The class prior is the share of toxic among labelled documents; the threshold is the strictest whose F1 is
    within TOLERANCE of the best, over all labelled documents, each scored by the weights of the folds it isn't in.  Null labels
    and null texts count for nothing.  Without two positives the model scores everything as clean.
    """
    votes = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.count_if(F.lower(F.trim("label")).isin(*TOXIC)).alias("toxic"), F.count_if(F.lower(F.trim("label")) == "clean").alias("clean"))
        .where("toxic + clean > 0")
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")
    text = documents.where("text is not null and trim(text) <> ''").select("doc_id", "text", fold)
    confirmed = text.join(votes.where("toxic > clean").select("doc_id"), "doc_id", "left_semi")
    size = F.octet_length("text").alias("size")
    # the first of them by hash, then as many as fit, small ones first; bytes are summed over these few sizes alone
    first = confirmed.select("doc_id", size, F.xxhash64("doc_id", F.lit(3)).alias("place")).orderBy("place", "doc_id").limit(positives)
    sizes = sorted((r["size"], r["doc_id"]) for r in first.collect())
    fit_in = [i for (_, i), total in zip(sizes, np.cumsum([z for z, _ in sizes]) if sizes else [], strict=True) if total <= positive_bytes]
    shares = votes.agg(F.avg((F.col("toxic") > F.col("clean")).cast("double"))).first()[0]
    none = Model(np.zeros(1 << BITS), -1.0, np.inf, 0.0, shares or 0.0)
    if len(fit_in) < 2:
        return none
    chosen = documents.sparkSession.createDataFrame([(i,) for i in fit_in], documents.select("doc_id").schema)
    table = confirmed.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("text", "fold").toArrow()  # at most positives ids, positive_bytes of text
    everything = text.join(votes, "doc_id", "left").select("text", "fold", F.when(F.col("toxic") > F.col("clean"), 1).when(F.col("toxic").isNotNull(), 0).otherwise(-1).alias("kind"))
    without, whole = spreads(everything)
    found = [ratios(x) for x in (*without, whole)]
    telling, common = (np.logical_or.reduce(x) for x in ([t for _, t in found], [r < 0.7 for r, _ in found]))
    others = unlabelled_patterns(everything.where("kind <> 1"), telling, common)
    folds, (w, b) = train(table.column("text").to_pylist(), np.array(table.column("fold").to_pylist(), np.int64), shares or 0.0, without, whole, others)
    threshold, f1 = strictest(*held_out(text.join(votes, "doc_id").select("text", "fold", (F.col("toxic") > F.col("clean")).alias("toxic")), folds))
    return Model(w, b, threshold, f1, shares or 0.0)


def train(texts: list[str], fold_of: np.ndarray, prior: float, without: list[Spread], whole: Spread, others: Unlabelled) -> tuple[list[tuple[np.ndarray, float] | None], tuple[np.ndarray, float]]:
    """Weights and bias without each fold, None where too few positives are left, and those of all.

    texts: confirmed documents and their folds.  without, whole: the spreads of all documents.
    """
    feature, offsets, rows = features(texts)
    positive = Sentences(feature, offsets, np.ones(len(rows)))

    def on(inside: np.ndarray, spread: Spread, fold: int | None) -> tuple[np.ndarray, float] | None:
        if inside.sum() < 2:
            return None
        mine = np.flatnonzero(inside[rows])
        return _train(positive.take(mine), rows[mine], others.without(fold), prior, spread)

    return [on(fold_of != k, without[k], k) for k in range(FOLDS)], on(np.ones(len(texts), bool), whole, None)


def held_out(labelled: DataFrame, folds: list[tuple[np.ndarray, float] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occupied cells of the held-out scores in rising order, and the toxic and all documents of each.

    labelled: text, fold, toxic.  Cells are even in the inverse hyperbolic sine of the score, so their number, which is all
    that reaches the driver, has a bound at any input; wordless texts are in the cell WORDLESS.
    """
    shared = labelled.sparkSession.sparkContext.broadcast([m and (m[0].astype(np.float32), m[1]) for m in folds])  # 4 MB a fold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                fold = np.asarray(part.column(1))
                for n, m in enumerate(models):
                    mine = part.filter(pa.array(fold == n))
                    if m is not None and mine.num_rows:
                        z = text_scores(*m, mine.column(0).to_pylist())
                        cell = np.where(np.isfinite(z), np.floor(np.arcsinh(np.maximum(z, -1e9)) * CELLS), WORDLESS).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(cell), mine.column(2)], ["cell", "toxic"])

    cells = labelled.select("text", "fold", "toxic").mapInArrow(run, "cell int, toxic boolean").groupBy("cell").agg(F.count_if("toxic").alias("hit"), F.count(F.lit(1)).alias("n"))
    found = np.array(sorted(tuple(r) for r in cells.collect()), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def strictest(cell: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Threshold and its F1 from the cells of held-out scores: of the thresholds as good as the best but for wrong labels the
    strictest, since innocent look-alikes stand just below."""
    some = np.flatnonzero(cell != WORDLESS)[::-1]  # wordless texts are never toxic, though their labels count as missed
    if not len(some):
        return 0.0, 0.0
    scores = 2 * np.cumsum(toxic[some]) / (np.cumsum(n[some]) + max(1, toxic.sum()))
    best = int(np.flatnonzero(scores >= scores.max() - TOLERANCE)[0])
    low = np.sinh(cell[some[best]] / CELLS)
    below = np.sinh((cell[some[best + 1]] + 1) / CELLS) if best + 1 < len(some) else low
    return float((low + below) / 2), float(scores[best])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, score, toxic of every document; null and wordless texts have the lowest score and aren't toxic."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 4 MB at any input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                z = text_scores(weights, bias, [x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z)], ["doc_id", "source", "score"])

    kind = dict(documents.dtypes)["doc_id"]
    scored = documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, score double")
    return scored.withColumn("toxic", F.col("score") >= F.lit(float(model.threshold)))
