"""URL filters by a cascade of Bloom filters, all in DataFrame functions.

A rule list names keys: a host suffix and a path prefix with an action. A url probes one key for each *shape*
(number of host labels, length of path prefix) that occurs in the list. The set of all distinct probes of the
corpus is the complete key universe, so a cascade can encode the listed keys exactly: level 1 is a Bloom filter of
the listed keys, level 2 of the universe's keys that level 1 takes wrongly, level 3 of the listed keys that level 2
takes, and so on until a level takes none wrongly. The parity of the first level that refuses a key is its exact
membership; no url is joined to anything. A filter is one array of 64-bit words, built by an aggregate and handed to the scan as a
scalar subquery: about 9 bits for each listed rule, whatever the corpus holds, and neither in the plan nor in the driver's Python.
Only keys wrongly taken, a fraction RATE of the universe, are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import read, staged

#: The rules of the query: host, path, action.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Wrong answers of level 1, and of each further level, per key that isn't listed there.
RATE, NEXT_RATE = 1 / 64, 1 / 8


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a table of one row with its words of 64 bits, and the number of bits tested for a key."""

    words: DataFrame
    bits: int
    tests: int
    salt: int

    def takes(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        table, out = self.words.scalar(), F.lit(True)
        for i in range(self.tests):
            at = positions(key, self.bits, self.salt, i)
            word = F.get(table, F.shiftright(at, 6).cast("int"))
            out = out & (F.expr("0") != F.getbit(word, (at % 64).cast("int")))
        return out


def positions(key: Column, bits: int, salt: int, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt * 16 + i), key), F.lit(bits))


def level_of(keys: DataFrame, n: int, salt: int) -> Level:
    """The filter of the n keys of a column key. Its bits are set by an aggregate: a row for each 64-bit word, then one row with all words."""
    rate = RATE if salt == 1 else NEXT_RATE
    bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    tests = min(8, max(1, round(bits / n * math.log(2))))
    at = keys.select(F.explode(F.array(*[positions(F.col("key"), bits, salt, i) for i in range(tests)])).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(found, "word", "left").select("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    words = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("words"))
    return Level(staged(words, "filter"), bits, tests, salt)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact membership of a key of the universe: the first level that refuses it decides, by its parity."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[depth].takes(key), out).otherwise(F.lit(depth % 2 == 1))
        return out


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of listed (key) over universe (key, distinct). Listed keys that no row of the universe has are in the first filter, too; nothing asks for them.

    There is no limit to the levels: each takes a fraction of the keys before it, under hashes of its own, until none is taken wrongly.
    """
    listed = listed.select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    levels = [level_of(listed, n, 1)]
    taken = universe.where(levels[0].takes(F.col("key")))
    inside, wrong = listed, staged(taken.join(listed, "key", "left_anti"), "cascade")  # RATE of the universe
    while m := wrong.count():
        levels.append(level_of(wrong, m, len(levels) + 1))
        inside, wrong = wrong, staged(inside.where(levels[-1].takes(F.col("key"))), "cascade")
    return Cascade(tuple(levels))


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path. Without :// (or null) both are empty."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), rest.alias("rest")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def probe(labels: int, length: int) -> Column:
    """The url's key of a shape: its last labels of the host and the first length characters of its path; null if it has fewer."""
    enough = (F.size(F.split("host", r"\.")) >= labels) & (F.char_length("path") >= length) & (F.col("host") != "")
    return F.when(enough, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    A rule fits its host and all subdomains where the url's path starts with the rule's; of several, the longest key
    wins, then the longer host. Without a rule the verdict is default: the url's keys are in neither list. Null urls, and urls
    without ://, have an empty host and fit no rule. Repeated rows and urls give a row each; the longest texts are whole.
    An empty table gives an empty result. A key in both lists counts as blocked.
    """
    spark: SparkSession = pages.sparkSession
    split = parts(pages)
    rules = [(h.lower().strip("."), p, a) for h, p, a in rules]
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    if not shapes:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = F.array_compact(F.array(*[F.concat(F.lit(f"{n}:{k}:"), probe(n, k)) for n, k in shapes]))
    universe = staged(split.select(F.explode(keys).alias("key")).distinct(), "universe")
    cascades = {}
    for action in ("block", "allow"):
        own = [f"{h.count('.') + 1}:{len(p)}:{h}{p}" for h, p, a in rules if a == action]
        cascades[action] = build(spark.createDataFrame([(k,) for k in own], "key string"), universe)
    found = []
    for n, k in shapes:
        plain, tagged = probe(n, k), F.concat(F.lit(f"{n}:{k}:"), probe(n, k))
        act = F.when(cascades["block"].holds(tagged), "block").when(cascades["allow"].holds(tagged), "allow")
        found.append(F.when(plain.isNotNull() & act.isNotNull(), F.struct(F.char_length(plain).alias("size"), F.lit(n).alias("labels"), plain.alias("rule"), act.alias("act"))))
    best = F.array_max(F.array_compact(F.array(*found)))
    return split.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.act"), F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, p, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(a, length(h || p)) AS act
  FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM f
"""
