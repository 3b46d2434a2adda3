"""Token counts by rank-synchronous merging of ragged numpy arrays.

The vocabulary is a sentencepiece BPE model with byte fallback and an identity normaliser. A text is
cut into pre-tokens: no piece of the vocabulary continues from another character into a word mark,
so a mark that follows another character always begins a new pre-token. The distinct pre-tokens of a
batch are held as one ragged array of symbols; in each step every sequence applies its own pair of
lowest rank at the same time, sequences without a pair leave, and the symbols that survive are
counted, once per occurrence of the pre-token. Unknown characters count their UTF-8 bytes.

A sequence merges all places of its pair in one step, from the left, up to the first merge that makes
a pair of lower rank: those are the merges that the library would do next one by one. So a long
pre-token takes about as many steps as it has kinds of pairs, and needs no other way. Memory is
bounded by the slice of text that a step works on; nothing is shuffled.

Defined cases: null and empty texts have no tokens; texts and pre-tokens may have any length; repeated
rows are counted one by one, an empty table gives no rows; a column named like the result is
replaced, other columns pass whatever their names. Ranks are never tied: pieces are numbered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import add_struct, encode_words, ragged, starts_of

MARK = "▁"
PRETOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
FIELDS = "n_bytes bigint, n_tokens bigint"
NONE = np.int64(2**62)

_loaded: dict[str, "Merges"] = {}


class Merges:
    """The model as arrays: symbol of a character, weight of a symbol, rank and result of a pair."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.size = model.get_piece_size()
        rank = {i: k for k, i in enumerate(sorted(pieces.values(), key=lambda i: (-model.get_score(i), i)))}
        self.weight = np.ones(self.size + 5, np.int64)
        self.weight[self.size :] = np.arange(5)
        self.symbol = np.empty(0x110000, np.int32)
        for low, high, width in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.symbol[low:high] = self.size + width
        pairs = {}
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = pieces.get(piece[:k]), pieces.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank[i] << 20 | i
        self.keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        starts = np.searchsorted(self.keys >> 20, np.arange(self.size + 6))
        self.low, self.high = starts[:-1], starts[1:]  # the pairs of each left symbol

    @classmethod
    def of(cls, path: str) -> "Merges":
        """Built once in each worker process."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | piece of each pair, or NONE."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], NONE)

    def count(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each sequence."""
        out = np.zeros(len(sequences), np.int64)
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        full = np.flatnonzero(size)
        if len(full):
            chars = np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32)
            out[full] = self._count_ragged(self.symbol[chars], size[full])
        return out

    def _count_ragged(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, alive = np.zeros(len(lengths), np.int64), np.arange(len(lengths))
        starts = starts_of(lengths)
        best = np.full(len(symbols), NONE)
        best[:-1] = self.pair(symbols[:-1], symbols[1:])
        best[starts[1:] - 1] = NONE
        while True:
            low = np.minimum.reduceat(best, starts[:-1])
            done = low >= NONE
            if done.any():
                total = np.add.reduceat(self.weight[symbols], starts[:-1])
                out[alive[done]] = total[done]
                stay = ~done
                if not stay.any():
                    return out
                keep = ragged(starts[:-1][stay], lengths[stay])
                symbols, best, lengths, alive, low = symbols[keep], best[keep], lengths[stay], alive[stay], low[stay]
                starts = starts_of(lengths)
            hit = np.flatnonzero(best == np.repeat(low, lengths))
            at = hit[self._first_merges(symbols, best, starts, hit)]
            of = np.searchsorted(starts, at, side="right") - 1
            symbols[at] = (best[at] & 0xFFFFF).astype(np.int32)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, best = symbols[keep], best[keep]
            at -= np.arange(len(at))
            lengths = lengths - np.bincount(of, minlength=len(lengths))
            starts = starts_of(lengths)
            inner = at + 1 < starts[of + 1]
            best[at] = NONE
            best[at[inner]] = self.pair(symbols[at[inner]], symbols[at[inner] + 1])
            inner = at[at > starts[of]]
            best[inner - 1] = self.pair(symbols[inner - 1], symbols[inner])

    def _first_merges(self, symbols: np.ndarray, best: np.ndarray, starts: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which of the places ``hit`` of each sequence's lowest pair are merged together, from the left."""
        new = np.ones(len(hit), bool)
        new[1:] = hit[1:] != hit[:-1] + 1
        run = np.flatnonzero(new)
        take = np.flatnonzero((np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0)  # places that overlap give way
        at = hit[take]
        of = np.searchsorted(starts, at, side="right") - 1
        several = of[1:] == of[:-1]
        if not several.any():
            return take
        made, low = (best[at] & 0xFFFFF).astype(np.int32), best[at]
        after_merge = np.zeros(len(at), bool)  # the symbol before is one just made
        after_merge[1:] = several & (at[1:] == at[:-1] + 2)
        left = np.where(after_merge, np.roll(made, 1), symbols[np.maximum(at - 1, 0)])
        lower = (at > starts[of]) & (self.pair(left, made) < low)
        has = at + 2 < starts[of + 1]
        lower |= has & (self.pair(made, symbols[np.minimum(at + 2, len(symbols) - 1)]) < low)
        if not lower.any():
            return take
        stop = np.full(len(starts), len(symbols), np.int64)
        np.minimum.at(stop, of[lower], at[lower])
        return take[at <= stop[of]]


def count_texts(texts: pa.Array, merges: Merges) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    odd = np.asarray(pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False), bool)
    for i in np.flatnonzero(odd):  # runs of blanks or marks: pre-tokens by pattern
        if text := texts[int(i)].as_py():
            out[i] = merges.count(PRETOKEN.findall(MARK + text.replace(" ", MARK))).sum()
    plain = np.flatnonzero(~odd)
    if len(plain):
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        index, distinct = encode_words(pc.list_flatten(lists))
        counts = merges.count([MARK + w for w in distinct.to_pylist()])
        out[plain] = np.bincount(pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), weights=counts[index], minlength=len(plain)).astype(np.int64)
    return out


def token_counts(docs: DataFrame, model_path: str, *, text_col: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes (UTF-8) and n_tokens under the model."""

    def factory():
        merges = Merges.of(model_path)

        def apply(texts: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays([pc.binary_length(texts).cast(pa.int64()), pa.array(count_texts(texts, merges))], names=["n_bytes", "n_tokens"])

        return apply

    return add_struct(docs, text_col, into, FIELDS, factory)
