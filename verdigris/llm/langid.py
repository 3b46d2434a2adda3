"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A text is its runs of letters, lower-cased, each behind a word mark. Every language has a
probability for each piece of the vocabulary; the likelihood of a word is the sum over all its
segmentations into pieces, found by the forward algorithm, and that of a text is the product over
its words. The prediction is the likeliest language under equal priors and ``score`` its posterior.

Fitting takes a bounded sample, ``per_language`` labelled texts of each language (those with the
smallest hash, copies once), and runs ``rounds`` of expectation-maximisation: each round is one
Spark job in which tasks sum expected piece counts by forward and backward passes over distinct
words. The model is one probability for each language and piece, so its size does not follow the
data. Scoring is a narrow stage over whole texts; a letter run of any length needs memory for its
characters and for the sums at the last few places.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without labelled rows
every text is ``und``; equal likelihoods go to the language that sorts first; texts of any length are
scored whole, repeated rows one by one; an empty table gives no rows; a column named like the result
is replaced, other columns pass whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_struct, bounded_batches, encode_words, split_words, starts_of, text_slices, written

MARK = "▁"
#: Probability of a character outside the vocabulary, alike in all languages.
UNKNOWN = 1e-6
#: Characters between two rescalings of the forward sums.
RESCALE = 16
#: Places up to which the sums of the fit need no rescaling.
UNSCALED = 65
PER_LANGUAGE = 2000
#: Words whose likelihoods a task remembers between slices.
CACHE = 100_000
BASE = np.uint64(0x9E3779B97F4A7C15)
FIELDS = "lang_pred string, score double, n_words bigint"


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # pieces x languages


class Vocabulary:
    """Pieces as sorted hashes, found by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = [p for p in pieces if p.lower() == p and p.replace(MARK, "x").isalpha()]
        self.longest = max(map(len, self.pieces))
        keys = np.zeros(len(self.pieces), np.uint64)
        for k, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def lattice(self, chars: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of equal length (rows of ``chars``), by end: (start, rows, pieces) that end there."""
        n, length = chars.shape
        ends: list[list] = [[] for _ in range(length + 1)]
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = h * BASE + chars[:, j] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                rows = np.flatnonzero(self.keys[at] == h)
                if len(rows):
                    ends[j + 1].append((i, rows, self.order[at[rows]]))
        return ends


    def ends(self, chars: np.ndarray):
        """The same, one end after the other and without holding them: (start, rows, pieces) lists."""
        n, length = chars.shape
        upto = np.zeros((n, length + 1), np.uint64)  # hashes of the first characters
        for j in range(length):
            upto[:, j + 1] = upto[:, j] * BASE + chars[:, j] + np.uint64(1)
        power = np.cumprod(np.full(self.longest, BASE))  # overflow wraps, as in the hash
        for end in range(1, length + 1):
            found = []
            for start in range(max(0, end - self.longest), end):
                h = upto[:, end] - upto[:, start] * power[end - start - 1]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                rows = np.flatnonzero(self.keys[at] == h)
                if len(rows):
                    found.append((start, rows, self.order[at[rows]]))
            yield found


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters of every text, and how many each text has."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "))


def by_length(words: list[str]):
    """(places, characters) of the words of each length, the mark put first, at most 20,000 at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = starts_of(sizes)
    for size in np.unique(sizes):
        same = order[np.searchsorted(sizes[order], size) : np.searchsorted(sizes[order], size, side="right")]
        for k in range(0, len(same), 20_000):
            at = same[k : k + 20_000]
            chars = np.empty((len(at), int(size) + 1), np.uint64)
            chars[:, 0] = ord(MARK)
            chars[:, 1:] = flat[starts[at][:, None] + np.arange(int(size))]
            yield at, chars


def forward(ends, n: int, prob: np.ndarray, longest: int) -> np.ndarray:
    """Log of the sums over all segmentations; only the sums at the last ``longest`` places are held."""
    held = longest + 1
    alpha, scale = np.zeros((held, n, prob.shape[1])), np.zeros((n, prob.shape[1]))
    alpha[0], end = 1, 0
    for end, found in enumerate(ends, 1):
        here = alpha[(end - 1) % held] * UNKNOWN
        for start, rows, piece in found:
            here[rows] += alpha[start % held][rows] * prob[piece]
        alpha[end % held] = here
        if end % RESCALE == 0:
            top = np.maximum(alpha.max(axis=0), 1e-300)
            alpha /= top
            scale += np.log(top)
    return np.log(np.maximum(alpha[end % held], 1e-300)) + scale


def log_likelihoods(words: list[str], vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """log P(word | language), all segmentations summed: words x languages."""
    out = np.zeros((len(words), prob.shape[1]))
    for at, chars in by_length(words):
        out[at] = forward(vocab.ends(chars), len(at), prob, vocab.longest)
    return out


class WordScores:
    """Log-likelihoods of words under a model, remembered between slices of text."""

    def __init__(self, vocab: Vocabulary, prob: np.ndarray):
        self.vocab, self.prob = vocab, prob
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, self.prob.shape[1]))

    def of(self, words: list[str]) -> np.ndarray:
        """words x languages."""
        if len(self.known) + len(words) > CACHE:
            self.clear()
        if new := [w for w in words if w not in self.known]:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, log_likelihoods(new, self.vocab, self.prob)])
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def scaled_sums(ends: list, n: int, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums of one language by place, and the log of the scale taken out of each (long runs only)."""
    sums, scale = np.zeros((len(ends), n)), np.zeros((len(ends), n))
    sums[0] = 1
    for end in range(1, len(ends)):
        sums[end] = sums[end - 1] * UNKNOWN
        for start, rows, piece in ends[end]:
            sums[end][rows] += sums[start][rows] * prob[piece] * np.exp(scale[start][rows] - scale[end - 1][rows])
        if len(ends) > UNSCALED:
            scale[end] = scale[end - 1] + np.log(sums[end])
            sums[end] = 1
    return sums, scale


def expected_counts(words: list[str], weight: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (words x weight) under one language's probabilities."""
    out = np.zeros(len(vocab.pieces))
    for places, signs in by_length(words):
        step = max(1, 20_000 * UNSCALED // max(UNSCALED, signs.shape[1]))  # long runs by fewer at once
        for k in range(0, len(places), step):
            at, ends = places[k : k + step], vocab.lattice(signs[k : k + step])
            length, n = len(ends) - 1, len(at)
            turned: list[list] = [[] for _ in ends]
            for end in range(length, 0, -1):
                for start, rows, piece in ends[end]:
                    turned[length - start].append((length - end, rows, piece))
            alpha, before = scaled_sums(ends, n, prob)
            beta, behind = (x[::-1] for x in scaled_sums(turned, n, prob))
            total = np.maximum(alpha[length], 1e-300)
            for end in range(1, length + 1):
                for start, rows, piece in ends[end]:
                    scale = np.exp(before[start][rows] + behind[end][rows] - before[length][rows])
                    out += np.bincount(piece, alpha[start][rows] * beta[end][rows] * prob[piece] / total[rows] * scale * weight[at][rows], len(out))
    return out


def fit(labelled: DataFrame, vocab_path: str, *, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, rounds: int = 3, smoothing: float = 0.1) -> Model:
    """Piece probabilities of every language in ``lang_col``."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("turn", F.xxhash64("text"))
    # a share of each language's distinct texts that holds more than enough first, so that no language fills a task
    enough = per_language + 8 * per_language**0.5
    shares = {r["lang"]: min(1.0, enough / r["count"]) for r in rows.select("lang", "turn").distinct().groupBy("lang").count().collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")) if shares else F.lit(0.0)
    some = rows.where(F.pmod("turn", F.lit(1 << 31)) < share * (1 << 31)).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "text"))
    sample = some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")

    def count(batches):
        for part in text_slices(batches, "text"):
            words, per_text = letter_words(pc.fill_null(part.column("text"), ""))
            langs = part.column("lang").dictionary_encode()
            index, distinct = encode_words(words)
            key = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), per_text) * max(1, len(distinct)) + index
            pairs, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pairs // max(1, len(distinct)))), distinct.take(pa.array(pairs % max(1, len(distinct)))), pa.array(n)], names=["lang", "word", "n"])

    words = written(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    pieces = len(vocabulary(vocab_path).pieces)
    prob = np.full((pieces, len(languages)), 1 / pieces)
    for _ in range(rounds if languages else 0):
        sent = labelled.sparkSession.sparkContext.broadcast(prob)

        def expect(batches, sent=sent):
            vocab, sums = vocabulary(vocab_path), {}
            for part in batches:
                langs = part.column("lang").to_pylist()
                lang_of, word, n = np.array(langs), np.array(part.column("word").to_pylist(), object), part.column("n").to_numpy()
                for lang in sorted(set(langs)):
                    own = lang_of == lang
                    sums[lang] = sums.get(lang, 0) + expected_counts(word[own].tolist(), n[own], vocab, sent.value[:, languages.index(lang)])
            for lang, total in sums.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(total[used])], names=["lang", "piece", "n"])

        sums = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        prob = np.full((pieces, len(languages)), smoothing)
        np.add.at(prob, (sums["piece"].to_numpy(np.int64), np.array([languages.index(x) for x in sums["lang"]], np.int64)), sums["n"].to_numpy())
        prob /= prob.sum(axis=0)
    return Model(languages, prob)


def identify(docs: DataFrame, model: Model, vocab_path: str, *, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang_pred, score, n_words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        own = sent.value
        scores = WordScores(vocabulary(vocab_path), own.probability)
        names = np.array([*own.languages, "und"], object)

        def apply(texts: pa.Array) -> pa.Array:
            words, per_text = letter_words(texts)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if len(words) and own.languages:
                index, distinct = encode_words(words)
                each = scores.of(distinct.to_pylist())
                text_of = np.repeat(np.arange(len(texts)), per_text)
                total = np.stack([np.bincount(text_of, each[index, k], len(texts)) for k in range(each.shape[1])], 1)
                there = per_text > 0
                best = np.where(there, total.argmax(axis=1), best)
                score = np.where(there, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(per_text)], names=["lang_pred", "score", "n_words"])

        return apply

    return add_struct(docs, text_col, into, FIELDS, factory)
