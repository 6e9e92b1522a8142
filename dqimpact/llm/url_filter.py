"""URL rules by host and path, as a sorted range join.

A rule holds for its host with all subdomains and for every path that starts with its own.  With the
labels of the host reversed, `org.example` + `/es/` is a key, and the rule covers the interval of all
keys that start with it.  An address asks once for each of its parent hosts, so that every rule is one
interval and intervals are nested or apart.  A sweep over the sorted keys keeps a stack of the rules that
are open: its top is the longest rule that covers the key.

Each different (host, path) is asked once, so repeated addresses cost one question.  All keys of one
host would meet in one task; they are dealt over a fixed number of salts, and the rules, which are few
against the addresses, go to each salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import carried, quoted

SALTS = 32


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z in lower case; empty without ://."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    whole = F.coalesce(url, F.lit(""))
    place = F.instr(whole, "://")
    return F.when(place > 0, F.substring(whole, place + 3, F.length(whole))).otherwise("")


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def _questions(addresses: DataFrame) -> DataFrame:
    """One row for each parent host of an address, the host itself first."""
    labels = F.split("host", "\\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = addresses.filter("host <> ''").select("host", "path", F.explode(parents).alias("parent"))
    return asked.select(
        _reversed(F.col("parent")).alias("rhost"),
        F.col("path").alias("key"),
        F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt"),
        F.lit(1).alias("kind"),
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
        F.length("parent").cast("long").alias("host_length"),
    )


def _intervals(rules: DataFrame) -> DataFrame:
    named = rules.filter("host is not null and path is not null and verdict is not null")
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Of two rules with one host and path the blocking one counts.
    one = named.groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    none = F.lit(None).cast("string")
    return one.select(
        _reversed(F.col("host")).alias("rhost"),
        F.col("path").alias("key"),
        salts.alias("salt"),
        F.lit(0).alias("kind"),
        none.alias("host"),
        none.alias("path"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.length("host").cast("long").alias("host_length"),
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rhost, salt, key, kind): a rule comes before the keys that it covers."""
    at: tuple | None = None
    open_rules: list[tuple[str, str, str, int]] = []
    for batch in batches:
        made: list[list] = [[], [], [], [], []]
        for rhost, key, salt, kind, host, path, rule, verdict, length in zip(
            *(column.to_pylist() for column in batch.columns), strict=True
        ):
            if at != (rhost, salt):
                at, open_rules = (rhost, salt), []
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if kind == 0:
                open_rules.append((key, rule, verdict, length))
            elif open_rules:
                _, rule, verdict, length = open_rules[-1]
                for values, value in zip(made, (host, path, rule, verdict, length), strict=True):
                    values.append(value)
        kinds = [pa.string()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(made, kinds, strict=True)],
            names=["host", "path", "rule", "verdict", "host_length"],
        )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row; `default` is the verdict where no rule fits.

    `rules` has host, path and verdict (allow or block).  The longest rule wins: by the characters of
    host and path together, then by those of the host.  Defined results for odd rows: a null url, or one
    without ://, has an empty host and path and fits no rule; repeated rows are judged alike; a rule with
    a null is left out; other columns are carried along, those named like a result, in any case, are replaced.
    """
    own = carried(pages, ["host", "path", "rule", "verdict"])
    address = F.col(quoted(url))
    parsed = pages.select(
        *[F.col(quoted(c)).alias(name) for name, c in own.items()],
        host_of(address).alias("host"), path_of(address).alias("path"),
    )
    addresses = parsed.select("host", "path").distinct()
    both = _questions(addresses).unionByName(_intervals(rules))
    dealt = both.repartition("rhost", "salt").sortWithinPartitions("rhost", "salt", "key", "kind")
    fitting = dealt.mapInArrow(_sweep, "host string, path string, rule string, verdict string, host_length long")
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict")).alias("best")
    )
    told = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return parsed.join(told, ["host", "path"], "left").select(
        *[F.col(name).alias(c) for name, c in own.items()], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
