"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

An expression is a lower-cased run of letters, spelt between boundary signs. For toxic and for
ordinary documents an interpolated Kneser-Ney model of ``ORDER`` letters gives each expression a
likelihood: the highest order has absolutely discounted counts of its class, every lower order
discounted continuation counts over both classes together. Letters that neither class has seen in their
context thus get the same backoff in both models, so a rare expression says nothing until its own
class counts do, while an unseen inflection still profits from the stem it shares. Counts are numbers
of documents: an expression counts once in each document that has it.

An ordinary document draws every expression from the ordinary model; a toxic one draws a share
``SHARE`` of them from the toxic model. ``ratio`` is the difference of the two log-likelihoods over the
number of expressions, to which ``LENGTH`` neutral ones are added so that a few words alone decide
nothing; a logistic curve of two weights turns it into ``score``.

Fitting: counts cover every labelled training row. They are gathered by the whole letter sequence, as
two integers that hold its five signs, and written as a table that grows with the data; nothing of
it is broadcast. The curve is fitted on ``CALIBRATION_ROWS`` held-back texts (those with the smallest
hash, copies once), by counts that leave out just their rows; the model then takes the counts of all rows.

Scoring: slices of documents are written as bags of expressions with the distinct sequences they hold.
These are joined to the model by context (the signs before the last), a row for each; the log-ratios go
back to their slices. A single text longer than a slice is a slice of its own.

Defined cases: null, empty and letterless texts have ratio 0 and get the curve's value there; a score of
just 0.5 is toxic to the query; labels other than 0 and 1 are ignored; without rows of both classes
every score is the share of toxic rows (0 without any); repeated rows count as often as they stand; an
empty table gives no rows; a column named like the result is replaced, other names pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, encode_words, split_words, starts_of, text_slices, without, written

ORDER = 5
#: Bits of a sign: a code point moved by two, as 1 and 2 are the boundary signs.
SIGN_BITS = 21
DISCOUNT = 0.75
#: Share of a toxic document's expressions that come from the toxic model.
SHARE = 0.03
#: Neutral expressions added to the length of every text.
LENGTH = 50
CALIBRATION_ROWS = 20_000
FIELDS = "score double, ratio double"
#: Bytes of text whose distinct sequences are gathered in one slice.
GATHER_BYTES = 32 << 20


@dataclass
class Model:
    counts: DataFrame  # hi, lo, n0, n1: documents by class of each letter sequence
    curve: tuple[float, float]  # weight of the ratio, constant


def expressions(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split_words(pc.replace_substring_regex(pc.utf8_lower(texts), r"\P{L}+", " "))


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences of ORDER signs that end at each predicted sign of all words, and the word of each.

    A sequence is two integers: ``hi`` holds its first two signs, ``lo`` the last three.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    size = n + ORDER  # ORDER - 1 signs before, one after
    at = starts_of(size)
    signs = np.ones(int(at[-1]), np.int64)
    inside = np.arange(int(at[-1])) - np.repeat(at[:-1], size)
    letter = (inside >= ORDER - 1) & (inside < np.repeat(size, size) - 1)
    signs[letter] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64) + 2
    signs[at[1:] - 1] = 2
    end = np.flatnonzero(inside >= ORDER - 1)
    joined = lambda *back: sum(signs[end - k] << (SIGN_BITS * i) for i, k in enumerate(reversed(back)))
    return joined(4, 3), joined(2, 1, 0), np.repeat(np.arange(len(words)), n + 1)


def distinct_sequences(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sequences, sorted, and the index of each given one among them."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return hi[order][new], lo[order][new], kind


def contexts_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The first place of each context among sorted sequences."""
    new, pair = np.ones(len(hi), bool), lo >> SIGN_BITS
    new[1:] = (hi[1:] != hi[:-1]) | (pair[1:] != pair[:-1])
    return np.flatnonzero(new)


def count_sequences(rows: DataFrame) -> DataFrame:
    """Distinct letter sequences of the rows (text, toxic, sampled): n0 and n1, the documents of each class, and
    h0 and h1, those of sampled rows."""

    def run(batches):
        for part in text_slices(batches, "text"):
            words, per_text = expressions(pc.fill_null(part.column("text"), ""))
            if not len(words):
                continue
            index, distinct = encode_words(words)
            pairs = np.unique((np.repeat(np.arange(len(per_text)), per_text) << 32) + index)  # once a document
            text, word = pairs >> 32, pairs & 0xFFFFFFFF
            toxic, sampled = part.column("toxic").to_numpy()[text], part.column("sampled").to_numpy(zero_copy_only=False)[text]
            of = lambda rows, word=word, size=len(distinct): np.bincount(word, rows, size)
            by_class = [of(toxic == c) for c in (0, 1)] + [of((toxic == c) & sampled) for c in (0, 1)]
            hi, lo, word_of = spelt(distinct.to_pylist())
            hi, lo, kind = distinct_sequences(hi, lo)
            sums = [np.bincount(kind, c[word_of], len(hi)).astype(np.int64) for c in by_class]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi, lo, *sums)], names=["hi", "lo", *sorts])

    sorts = ["n0", "n1", "h0", "h1"]
    counted = rows.mapInArrow(run, "hi long, lo long, " + ", ".join(f"{n} long" for n in sorts))
    return counted.groupBy("hi", "lo").agg(*[F.sum(n).alias(n) for n in sorts])


def log_ratios(counts: DataFrame) -> DataFrame:
    """hi, pair, known, neutral: a row for each context of ORDER - 1 signs.

    ``known`` holds (last sign, log P(last | toxic) - log P(last | ordinary)) of the signs that some class
    has seen there, ``neutral`` is the difference for all others. P interpolates the discounted counts of
    the class with the discounted continuation counts of ever shorter contexts over both classes.
    """
    sign = (1 << SIGN_BITS) - 1
    first = F.col("hi").bitwiseAND(sign)  # the second sign of the sequence
    pair, last = F.shiftright("lo", SIGN_BITS), F.col("lo").bitwiseAND(sign)

    def level(counted: DataFrame, context: list[str], lower: DataFrame | None, on: list[str]) -> DataFrame:
        """``counted`` (columns of a sequence, ``types`` of signs before it) with its probability ``p``."""
        total = counted.groupBy(*context).agg(F.sum("types").alias("total"), F.count("*").alias("kinds"))
        with_total = counted.join(total, context) if context else counted.crossJoin(total)  # one row of totals
        below = with_total.join(lower, on) if lower is not None else with_total.withColumn("below", 1 / (F.col("kinds") + 1))
        p = (F.greatest(F.col("types") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")
        return below.withColumn("p", p)

    fours = counts.groupBy(first.alias("first"), "lo").agg(F.count("*").alias("types"))
    threes = fours.groupBy("lo").agg(F.count("*").alias("types"))
    twos = threes.groupBy(F.col("lo").bitwiseAND((1 << 2 * SIGN_BITS) - 1).alias("two")).agg(F.count("*").alias("types"))
    ones = twos.groupBy(F.col("two").bitwiseAND(sign).alias("last")).agg(F.count("*").alias("types"))
    p1 = level(ones, [], None, []).select("last", F.col("p").alias("below"))
    twos = twos.select("two", "types", F.shiftright("two", SIGN_BITS).alias("one"), F.col("two").bitwiseAND(sign).alias("last"))
    p2 = level(twos, ["one"], p1, ["last"]).select("two", F.col("p").alias("below"))
    threes = threes.select("lo", "types", pair.alias("pair"), F.col("lo").bitwiseAND((1 << 2 * SIGN_BITS) - 1).alias("two"))
    p3 = level(threes, ["pair"], p2, ["two"]).select("lo", F.col("p").alias("below"))
    fours = fours.select("first", "lo", "types", pair.alias("pair"))
    p4 = level(fours, ["first", "pair"], p3, ["lo"]).select("first", "lo", F.col("p").alias("shared"))

    rows = counts.select("hi", "lo", first.alias("first"), pair.alias("pair"), last.alias("last"), "n0", "n1").join(p4, ["first", "lo"])
    seen = [f(c).alias(f"{name}{c}") for c in (0, 1) for name, f in (("seen", lambda c: F.sum(f"n{c}")), ("types", lambda c: F.count_if(F.col(f"n{c}") > 0)))]
    contexts = rows.groupBy("hi", "pair").agg(*seen, F.collect_list(F.struct("last", "n0", "n1", "shared")).alias("signs"))  # an alphabet at most
    lent = lambda c: F.when(F.col(f"seen{c}") > 0, DISCOUNT * F.col(f"types{c}") / F.col(f"seen{c}")).otherwise(F.lit(1.0))

    def log_of(sign: Column, c: int) -> Column:
        own = F.when(F.col(f"seen{c}") > 0, F.greatest(sign[f"n{c}"] - DISCOUNT, F.lit(0.0)) / F.col(f"seen{c}")).otherwise(F.lit(0.0))
        return F.log(own + lent(c) * sign["shared"])

    known = F.transform("signs", lambda x: F.struct(x["last"].cast("int").alias("last"), (log_of(x, 1) - log_of(x, 0)).alias("ratio")))
    return contexts.select("hi", "pair", F.map_from_entries(known).alias("known"), (F.log(lent(1)) - F.log(lent(0))).alias("neutral"))


def mean_ratio(ratio: np.ndarray, times: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """For each text, from the log-ratios of its distinct expressions and how often each stands there."""
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    drawn = np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + ratio)
    return np.bincount(text_of, drawn * times, len(per_text)) / (np.bincount(text_of, times, len(per_text)) + LENGTH)


def scores(ratio: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * ratio + curve[1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Weight and constant of a ridge-penalised logistic curve, by Newton's method."""
    scale = max(float(x.std()), 1e-9)
    a, w, penalty = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2), np.array([ridge, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def bags(docs: DataFrame, text_col: str, kept: list[str]) -> DataFrame:
    """Slices of the documents, written: slice, block (kept columns and bags of expressions), words, hi, pair, lasts."""

    def packed(table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def run(batches):
        base, done = TaskContext.get().partitionId() << 32, 0
        known: dict[str, int] = {}
        parts, held = [], 0

        def row() -> pa.RecordBatch:
            hi, lo, _ = distinct_sequences(*spelt(list(known))[:2])
            block, words = packed(pa.Table.from_batches(parts)), packed(pa.table({"word": pa.array(list(known), pa.string())}))
            at = contexts_of(hi, lo)
            lists = [pa.array([x[at]], pa.list_(pa.int64())) for x in (hi, lo >> SIGN_BITS)]
            lasts = pa.ListArray.from_arrays(pa.array(np.append(at, len(lo)).astype(np.int32)), pa.array((lo & ((1 << SIGN_BITS) - 1)).astype(np.int32)))
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), lasts))
            return pa.RecordBatch.from_arrays([pa.array([base + done]), pa.array([block]), pa.array([words]), *lists], names=["slice", "block", "words", "hi", "pair", "lasts"])

        for part in text_slices(batches, text_col):
            texts = pc.fill_null(part.column(text_col), "")
            size = pc.sum(pc.binary_length(texts)).as_py()
            if parts and held + size > GATHER_BYTES:
                yield row()
                done, known, parts, held = done + 1, {}, [], 0
            words, per_text = expressions(texts)
            index, distinct = encode_words(words)
            place = np.fromiter((known.setdefault(w, len(known)) for w in distinct.to_pylist()), np.int64, len(distinct))
            text_of = np.repeat(np.arange(len(texts)), per_text)
            pairs, times = np.unique((text_of << 32) + place[index], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) << 32).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, times)]
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            parts.append(pa.RecordBatch.from_arrays([*columns, *lists], names=[f"c{k}" for k in range(len(columns))] + ["bag", "times"]))
            held += size
        if parts:
            yield row()
        pa.default_memory_pool().release_unused()

    return written(docs.mapInArrow(run, "slice long, block binary, words binary, hi array<long>, pair array<long>, lasts array<array<int>>"), "toxicity-bags")


def described(docs: DataFrame, counts: DataFrame, text_col: str, kept: list[str], more: list[T.StructField], finish: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """The ``kept`` columns of ``docs`` and those that ``finish`` makes of the ratio of each row."""
    bounded_batches(docs.sparkSession)
    slices = bags(docs, text_col, kept)
    asked = slices.select("slice", F.inline(F.arrays_zip("hi", "pair", "lasts")))
    ratio = F.transform("lasts", lambda x: F.coalesce(F.element_at("known", x), "neutral", F.lit(0.0)))
    answers = asked.join(log_ratios(counts), ["hi", "pair"], "left").select(F.col("slice").alias("part"), "hi", "pair", ratio.alias("ratio"))
    schema = T.StructType([*[docs.schema[c] for c in kept], *more])
    names = schema.fieldNames()

    def opened(column: pa.ChunkedArray) -> pa.Table:
        return pa.ipc.open_stream(column[0].as_py()).read_all()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, words = opened(left.column("block")), opened(left.column("words")).column("word").to_pylist()
        hi, lo, word_of = spelt(words)
        _, _, kind = distinct_sequences(hi, lo)
        right = right.sort_by([("hi", "ascending"), ("pair", "ascending")]).column("ratio").combine_chunks()  # signs stand in order
        each = np.bincount(word_of, right.flatten().to_numpy()[kind], len(words))
        tables = []
        for part in block.to_batches():
            bag, times = part.column("bag"), part.column("times").flatten().to_numpy()
            x = mean_ratio(each[bag.flatten().to_numpy()], times, bag.value_lengths().to_numpy())
            tables.append(pa.RecordBatch.from_arrays([*part.columns[:-2], *finish(x)], names=names))
        return pa.Table.from_batches(tables)

    return slices.select("slice", "block", "words").groupBy("slice").cogroup(answers.groupBy("part")).applyInArrow(run, schema)


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", held_back: Column, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """The model from labelled rows; a bounded part of those where ``held_back`` holds serves the curve."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), F.coalesce(held_back, F.lit(False)).alias("back")).where("toxic in (0, 1)")
    rows = rows.withColumn("turn", F.xxhash64("text", "toxic"))
    last = rows.where("back").select("turn").distinct().orderBy("turn").limit(calibration_rows).agg(F.max("turn")).first()[0]
    rows = rows.withColumn("sampled", F.col("back") & F.coalesce(F.col("turn") <= F.lit(last).cast("long"), F.lit(False)))
    both = written(count_sequences(rows.select("text", "toxic", "sampled")), "toxicity-counts")
    counts = both.select("hi", "lo", "n0", "n1")
    others = both.select("hi", "lo", (F.col("n0") - F.col("h0")).alias("n0"), (F.col("n1") - F.col("h1")).alias("n1")).where("n0 + n1 > 0")
    sample = rows.where("sampled").select("text", "toxic", "turn").distinct()
    seen = described(sample, others, "text", ["toxic", "turn"], [T.StructField("x", T.DoubleType())], lambda x: [pa.array(x)]).orderBy("turn").limit(calibration_rows).toPandas()
    y = seen["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Model(counts, (0.0, float(np.log(share / (1 - share)))))
    return Model(counts, logistic(seen["x"].to_numpy(float), y))


def assess(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "toxicity", keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct ``into``: score, ratio.

    Without ``keep_text`` the text column is left out, so that texts are not shuffled.
    """
    docs = without(docs, into, text_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    curve = model.curve

    def finish(x: np.ndarray) -> list[pa.Array]:
        return [pa.StructArray.from_arrays([pa.array(scores(x, curve)), pa.array(x)], names=["score", "ratio"])]

    return described(docs, model.counts, text_col, kept, [T.StructField(into, T._parse_datatype_string(f"struct<{FIELDS}>"))], finish)
