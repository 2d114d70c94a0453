"""URL filters by Bloom filter cascades: exact membership for every key of the corpus, without joins at the pages.

A cascade's first Bloom filter encodes the listed keys; the second encodes those other keys of the corpus that the first
takes for listed; the third encodes the listed ones that the second takes, and so on until a level has no false
positive. A key is then judged by the first level that lacks it. This is exact for every key of the universe that built
it, and the universe is all keys that the pages have.

Rules are a table (host, path, verdict), listed hosts another. A page's keys are its host's last labels with its path's first
characters, for each (number of labels, length) that some rule has; a rule is looked up as such a key. One cascade tells the
keys that are rules, a second, over these alone, the blocking from the allowing ones; a third tells the listed hosts, which
judge pages without a rule: block if the host or a parent is listed. All three come from one table of the corpus's keys. The
plan grows with the number of such pairs (labels, length), a few hundred for any real list, not with the number of rules.

A level's filter is sized by the ratio of the keys to encode and the others: the first lets about as many others through as
there are listed keys, further ones half of theirs. Filters are arrays read by scalar subqueries, so their size is checked:
a cascade with a level of more than ``max_bits`` is left, and its keys, those that the corpus has, are joined with salts.

Defined results: a null url, or one without ``://``, has empty host and path and no rule and is allowed; rules of equal
length go to the longer host; repeated rows are judged each; extra columns stay out; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardloom.llm.common import Scratch, meet

#: The largest filter: 16 MB. At 12 bits a key, as for one listed key in 300, it holds 11 million listed keys of the corpus.
MAX_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def filter_size(n: int, others: int, first: bool) -> tuple[int, int]:
    """(bits, probes) for n keys to be told from the others: all but about n of them at the first level, half of them later."""
    rate = min(0.5, max(n, 1) / max(others, 1) * 0.7) if first else 0.5
    probes = max(1, round(-math.log2(rate)))
    return max(64, -(-math.ceil(n * probes / math.log(2)) // 64) * 64), probes


def _places(key: Column, level: int, bits: int, probes: int) -> list[Column]:
    h, g = (F.shiftrightunsigned(F.xxhash64(F.lit(2 * level + i), key), 34) for i in (0, 1))
    return [(h + F.lit(j) * (g + 1)) % F.lit(bits) for j in range(probes)]


class Cascade:
    """Levels of Bloom filters over (key, listed), a row for each key of the universe. keys: a table that can be read again."""

    def __init__(self, keys: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS):
        self.levels: list[tuple[DataFrame, int, int]] = []
        self.fits, encoded, others = True, keys.where("listed").select("key"), keys.where("NOT listed").select("key")
        n, m = encoded.count(), others.count()
        while n:
            if len(self.levels) > 60:
                raise RuntimeError("the cascade does not end")
            bits, probes = filter_size(n, m, not self.levels)
            if bits > max_bits:
                self.fits = False
                break
            words = encoded.select(F.explode(F.array(*_places(F.col("key"), len(self.levels), bits, probes))).alias("p"))
            words = words.groupBy(F.floor(F.col("p") / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("word"))
            spine = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
            level = spine.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("words"))  # at most max_bits / 64 numbers
            self.levels.append((scratch.put(level, "level"), bits, probes))
            # the next level holds those of the others that this one takes, and is tested on those that this one holds
            encoded, others, m = scratch.put(others.where(self._in(len(self.levels) - 1, F.col("key"))), "took"), encoded, n
            n = encoded.count()

    def _in(self, i: int, key: Column) -> Column:
        words, bits, probes = self.levels[i]
        array = words.scalar()
        tests = [F.call_function("shiftrightunsigned", F.get(array, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(1) == 1 for p in _places(key, i, bits, probes)]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found

    def has(self, key: Column) -> Column:
        """True for listed keys. The first level that lacks the key judges: even levels hold listed keys, odd ones others."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self._in(i, key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def rule_tables(spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Short lists as the tables that judge_urls takes."""
    return spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(h,) for h in listed], "host string")


def judge_urls(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, max_bits: int = MAX_BITS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page. rules: (host, path, verdict "allow" or "block"); listed_hosts: (host)."""
    s = Scratch(pages.sparkSession, "urls")
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    block = F.col("verdict") == "block"
    given = rules.select("host", "path", F.lit(True).alias("rule"), block.alias("block"), F.lit(False).alias("host_only"))
    given = given.union(listed_hosts.select("host", F.lit(""), F.lit(False), F.lit(False), F.lit(True))).where("host IS NOT NULL AND path IS NOT NULL")
    shape = given.select(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("n")).distinct()
    shapes = sorted(map(tuple, shape.collect()))  # pairs of small numbers
    given = given.groupBy(F.concat("host", F.lit(" "), "path").alias("key")).agg(F.max("rule").alias("rule"), F.max("block").alias("block"), F.max("host_only").alias("listed"))

    def key(labels: int, length: int) -> Column:
        fits = (F.size(F.split("host", "\\.")) >= labels) & (F.length("path") >= length) & (F.col("host") != "")
        return F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.lit(" "), F.substring("path", 1, length)))

    keys = rows.select(F.explode(F.array(*[key(*x) for x in shapes])).alias("key")) if shapes else given.select("key").where("false")
    universe = s.put(keys.where("key is not null").distinct(), "universe")
    no = F.lit(False)
    marked = meet(universe, given, ["key"], "left").select("key", *[F.coalesce(c, no).alias(c) for c in ("rule", "block", "listed")])
    marked = s.put(marked, "marked")
    s.drop(universe)
    sources = {"rule": marked, "block": marked.where("rule"), "listed": marked.where(F.col("key").endswith(" "))}
    rows = rows.withColumns({f"_k{i}": key(*x) for i, x in enumerate(shapes)})
    has = {}
    for name, own in sources.items():
        cascade = Cascade(own.select("key", F.col(name).alias("listed")), s, max_bits)
        if cascade.fits:
            has[name] = cascade.has
            continue
        has[name] = None
        found = s.put(own.where(name).select("key"), f"found-{name}")
        for i, x in enumerate(shapes):
            if name != "listed" or x[1] == 0:
                flag = found.select(F.col("key").alias(f"_k{i}"), F.lit(True).alias(f"_{name}{i}"))
                rows = meet(rows, flag, [f"_k{i}"], "left", F.struct("page_id", "path"))

    def member(name: str, i: int) -> Column:
        return F.coalesce(has[name](F.col(f"_k{i}")) if has[name] else F.col(f"_{name}{i}"), no) & F.col(f"_k{i}").isNotNull()

    found, listed = [], no
    for i, (labels, length) in enumerate(shapes):
        part = F.substring_index("host", ".", -labels)
        text = F.concat(part, F.substring("path", 1, length))
        verdict = F.when(member("block", i), F.lit("block")).otherwise(F.lit("allow"))
        found.append(F.when(member("rule", i), F.struct(F.length(text).alias("n"), F.length(part).alias("h"), text.alias("rule"), verdict.alias("verdict"))))
        if length == 0:
            listed = listed | member("listed", i)
    best = F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
    rows = rows.withColumns({"_best": best, "_listed": listed})
    default = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), default).alias("verdict"))
