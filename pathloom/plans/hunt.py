"""The hunt: generate candidates, hash them, keep those that match unknown keys, repeat until a round finds nothing."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_path
from ..functions.keys import unsigned
from ..meta import TableMeta
from ..operators.guessers import preset
from ..session import checkpointed


def hits(candidates: DataFrame, unknown: DataFrame, meta: TableMeta) -> DataFrame:
    """``key, path``: candidates whose key is unknown, for each key the smallest path."""
    hashed = candidates.select(hash_path(F.col("path"), meta).alias("key"), "path")
    return hashed.join(unknown.select("key"), "key", "left_semi").groupBy("key").agg(F.min("path").alias("path"))


def counted_hits(candidates: DataFrame, unknown: DataFrame, meta: TableMeta) -> DataFrame:
    """``key, path, n``: as ``hits``, in one pass with the number of candidates, of which those that hit nothing are a row without a key."""
    hashed = candidates.select(hash_path(F.col("path"), meta).alias("hash"), "path")
    both = hashed.join(unknown.select("key"), F.col("hash") == F.col("key"), "left")
    return both.groupBy("key").agg(F.min(F.when(F.col("key").isNotNull(), F.col("path"))).alias("path"), F.count("*").alias("n"))


@dataclass(frozen=True)
class HuntState:
    """What is known and what is looked for, at one moment of a hunt; every step makes a new state.

    ``known`` is the given corpus (``path``), ``finds`` are the finds since
    (``key, path`` each), ``unknown`` the keys that are left.
    """

    known: DataFrame
    unknown: DataFrame
    finds: tuple[DataFrame, ...] = ()

    def corpus(self, since: int | None = None) -> DataFrame:
        """All paths known by now, or the finds from number ``since`` on."""
        known = self.known.select("path")
        return reduce(DataFrame.union, (f.select("path") for f in self.finds[since:]), known if since is None else known.limit(0))

    def add_known(self, paths: DataFrame) -> HuntState:
        return replace(self, known=self.known.select("path").union(paths.select("path")))

    def add_unknown(self, keys: DataFrame) -> HuntState:
        return replace(self, unknown=self.unknown.select("key").union(keys.select("key")).distinct())

    def promote(self, found: DataFrame) -> HuntState:
        """Finds become known and are no longer looked for; what is left is written down."""
        return replace(self, finds=(*self.finds, found), unknown=checkpointed(self.unknown.join(found, "key", "left_anti")))


@dataclass
class HuntReport:
    """``resolved`` is ``key, path, round, guesser``; ``stats`` has a row per generator and round."""

    resolved: DataFrame
    unknown: DataFrame
    rounds: int
    stats: list[dict] = field(default_factory=list)


class Hunt:
    def __init__(self, meta: TableMeta, guessers: list | None = None, faithful: bool = True):
        """``faithful`` runs every generator over the whole corpus in every round; else those that look at one path
        at a time see only the paths added since they last ran, which finds the same and counts fewer candidates."""
        self.meta, self.guessers, self.faithful = meta, list(guessers or []), faithful

    @classmethod
    def for_table(cls, table: str, meta: TableMeta, **options) -> Hunt:
        faithful = options.pop("faithful", True)
        return cls(meta, preset(table, **options), faithful)

    def with_(self, guesser) -> Hunt:
        return Hunt(self.meta, [*self.guessers, guesser], self.faithful)

    def run(self, corpus: DataFrame, unknown: DataFrame, count: bool = True) -> HuntReport:
        """Finds are added to the corpus between generators of the same round.

        Only the finds and the keys that are left are written down; the corpus
        is the given one and the finds.
        """
        state = HuntState(corpus.select("path"), unknown.select("key").distinct())
        spark = corpus.sparkSession
        resolved = spark.createDataFrame([], "key long, path string, round int, guesser string")
        report = HuntReport(resolved, state.unknown, 0)
        if not self.guessers:
            return report
        seen: dict[int, int] = {}  # generator -> finds it has seen
        while True:
            report.rounds += 1
            if state.unknown.isEmpty():
                break
            this_round = 0
            for at, g in enumerate(self.guessers):
                if state.unknown.isEmpty():
                    break
                began = time.monotonic()
                whole = self.faithful or not getattr(g, "local", False)
                candidates = g.guess(state.corpus(None if whole else seen.get(at)))
                seen[at] = len(state.finds)
                total = None
                if count:
                    counted = checkpointed(counted_hits(candidates, state.unknown, self.meta))
                    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                    found = counted.filter("key is not null").select("key", "path")
                else:
                    found = checkpointed(hits(candidates, state.unknown, self.meta))
                n = found.count()
                report.stats.append({"round": report.rounds, "guesser": g.name, "candidates": total, "found": n, "seconds": time.monotonic() - began})
                if n:
                    this_round += n
                    resolved = resolved.unionByName(found.withColumns({"round": F.lit(report.rounds), "guesser": F.lit(g.name)}))
                    state = state.promote(found)
            if not this_round or state.unknown.isEmpty():
                break
        report.resolved, report.unknown = resolved, state.unknown
        return report


def stats_frame(spark, report: HuntReport) -> DataFrame:
    return spark.createDataFrame([(s["round"], s["guesser"], s["candidates"], s["found"], s["seconds"]) for s in report.stats], "round int, guesser string, candidates long, found long, seconds double")


def resolved_lines(report: HuntReport, digits: int, lowercase: bool) -> DataFrame:
    """The output list: sorted by key, padded, lower-cased where the table asks for it."""
    from ..sources.textio import hash_lines

    pairs = report.resolved.select("key", F.lower("path").alias("path") if lowercase else F.col("path"))
    return hash_lines(pairs, digits)


def targets(unknown: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Keys to hunt for: the unknown ones that no known row has, in unsigned order."""
    return unknown.select("key").distinct().join(known_keys.select("key"), "key", "left_anti").orderBy(unsigned(F.col("key")))
