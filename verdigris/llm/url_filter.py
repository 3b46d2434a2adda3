"""URL filtering by a Bloom filter cascade, in DataFrame operations only.

A rule has a host and a path. It fits its host and all subdomains where the url's path starts with
the rule's. A url's keys are host suffix + path prefix, for the prefix lengths that rules have; the
longest key that is a rule decides (the longer host on a tie).

Which keys are rules is answered by a cascade. Level 1 is a Bloom filter of the listed keys. The
keys of the corpus that it passes although they are not listed form level 2, the listed keys that
level 2 passes form level 3, and so on until none is passed. A key is listed exactly if the first
level that lacks it is an even one (counting from 1; after the last level, one more). Every key of the
corpus is part of the universe that the cascade was built over, so membership is exact and no page
is joined with a rule. Two cascades answer "is a rule" and "is an allow rule".

Level 1 has a rate of false passes at which about as many keys of the corpus pass it as are listed
(their number is estimated beforehand), so all levels together are bounded by the list and grow with
the logarithm of the corpus only. Building reads the corpus twice: for that estimate and for the keys
that level 1 falsely passes, which are written as a table; later levels come from that table and the
list. A level reaches the tasks as one literal. Of a list of more than ``most_keys`` keys each part, by
a hash of the key, gets cascades of its own, and pages are judged part after part, each pass written to
the shared folder, so that no plan holds more bits than those of ``most_keys`` keys.

Defined cases: a null url or one without ``://`` has empty host and path and fits no rule; rules
with a null host are ignored, a null path is empty; of rules with one key the blocking one counts;
no rules or no pages are fine; repeated pages give repeated rows; urls are judged at any length; a
column named like the result is replaced, other columns pass whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, without, written

#: Wrong passes of a level, the first aside.
RATE = 0.05
#: Listed keys of one pass: about 6 MB of bits a level.
MOST_KEYS = 8_000_000
LEVELS = 60


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a url, longest first, the longer host first on a tie."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tails = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring(path, F.lit(1), n)))
    fitting = F.flatten(F.transform(suffixes, lambda s: F.transform(tails, lambda t: F.struct((F.length(s) + F.length(t)).alias("size"), F.length(s).alias("host_size"), F.concat(s, t).alias("key")))))
    ordered = F.sort_array(fitting, asc=False)
    return F.when(F.length(host) > 0, F.array_distinct(F.transform(ordered, lambda k: k["key"]))).otherwise(F.array().cast("array<string>"))


class Level:
    """A Bloom filter: an array of longs, as a column, and its geometry."""

    def __init__(self, keys: DataFrame, count: int, level: int, rate: float):
        self.bits = max(64, 64 * math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
        self.hashes = max(1, round(-math.log2(rate)))
        self.level = level
        places = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("place"))
        words = [0] * (self.bits // 64)
        for r in places.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).collect():
            words[r["word"]] = r["bits"]
        # one string that Catalyst folds to an array: a node and a call, however many longs there are
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<long>")

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level * 64 + i)), F.lit(self.bits).cast("long")) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        """Whether all bits are there; the first that lacks ends the look-up."""

        def bit(place: Column) -> Column:
            word = F.get(self.words, F.shiftrightunsigned(place, 6).cast("int"))
            return F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

        return reduce(and_, map(bit, self.places(key)))


class Cascade:
    """Exact membership of the keys of a universe in a list."""

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = RATE):
        """Both have a column ``key`` of non-null strings, distinct in the list; the universe may hold listed keys."""
        self.levels: list[Level] = []
        count, size = listed.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
        first = max(min(rate, max(count, 1) / max(size, 1)), 1e-12)
        sides = [listed, None]  # the keys of the last level of either side
        for k in range(LEVELS):
            if k == 1:
                sides[1] = written(universe.where(self.levels[0].passes(F.col("key"))).join(listed, "key", "left_anti").distinct(), "cascade")
            elif k > 1:
                sides[k % 2] = written(sides[k % 2].where(self.levels[-1].passes(F.col("key"))), "cascade")
            count = sides[k % 2].count()
            if not count:
                break
            self.levels.append(Level(sides[k % 2], count, k, rate if k else first))
        else:
            raise RuntimeError("the cascade does not end; choose a smaller rate")

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: levels are asked in turn until one lacks it."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[k].passes(key), answer).otherwise(F.lit(k % 2 == 1))
        return answer


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", into: str = "filter", rate: float = RATE, most_keys: int = MOST_KEYS) -> DataFrame:
    """``pages`` with a struct ``into``: host, path, rule (the deciding key or null), verdict.

    ``rules`` has columns host, path and action (``block`` or ``allow``).
    """
    pages = without(pages, into, url_col)
    listed = rules.where("host != '' and (coalesce(path, '') = '' or startswith(path, '/'))").select(F.concat(F.col("host"), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("size"), (F.col("action") == "allow").alias("allow")).groupBy("key").agg(F.min("allow").alias("allow"), F.collect_set("size").alias("sizes"))
    listed = written(listed, "rules")
    lengths = sorted(r[0] for r in listed.select(F.explode("sizes")).distinct().collect()) or [0]
    parts = max(1, math.ceil(listed.count() / most_keys))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    part_of = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))
    out, found = pages, free_name([*pages.columns, into], "found")
    for part in range(parts):
        mine = (lambda key, part=part: part_of(key) == part) if parts > 1 else (lambda key: F.lit(True))
        own = listed.where(mine(F.col("key")))
        universe = pages.select(F.explode(keys_of(host, path, lengths)).alias("key")).where(mine(F.col("key")))
        known, allowed = Cascade(own.select("key"), universe, rate), Cascade(own.where("allow").select("key"), own.select("key"), rate)
        rule = F.get(F.filter(keys_of(host, path, lengths), lambda k: mine(k) & known.has(k)), F.lit(0))
        out = out.withColumn(found, rule)
        here = F.when(F.col(found).isNull() | allowed.has(F.col(found)), "allow").otherwise("block")
        value = F.struct(host.alias("host"), path.alias("path"), F.col(found).alias("rule"), here.alias("verdict"))
        if part:  # of the rules of all parts that fit, the first key of the url counts
            first = F.array_position(keys_of(host, path, lengths), F.col(found)) < F.array_position(keys_of(host, path, lengths), F.col(f"`{into}`.rule"))
            value = F.when(F.col(found).isNotNull() & (F.col(f"`{into}`.rule").isNull() | first), value).otherwise(F.col(f"`{into}`"))
        out = out.withColumn(into, value).drop(found)
        if part < parts - 1:
            out = written(out, "judged")
    return out
