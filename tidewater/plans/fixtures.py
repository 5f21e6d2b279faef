"""Mailbox snapshots worked out from the orders table by fixed arithmetic on its keys.

The statements run as they are in Spark and in DuckDB, so both sides of a
comparison start from the same rows; what is worked out from them is written
twice, once in the operators and once in SQL.  Folders are (customer % 3, order
% 4).  Account 0 has no usable baseline and gets full listings; account 1 gets
deltas; account 2's modseq has not moved, so only its counters speak.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.reconcile import Mailbox, settled
from tidewater.shared import Scratch

NEW_FAR = 10_000_000
_FAR = "(((st | CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) - (st & CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)) | CASE WHEN k % 19 = 0 THEN 8 ELSE 0 END)"
_NEAR = "(((st | CASE WHEN k % 6 = 1 THEN 4 ELSE 0 END) - (st & CASE WHEN k % 6 = 1 THEN 4 ELSE 0 END)) | CASE WHEN k % 23 = 0 THEN 8 ELSE 0 END)"
_LOCAL = "k % 14 = 5 AND k % 11 = 0"

#: In the order in which they build on each other.
TABLES = {
    "o": "SELECT o_orderkey AS k, CAST(o_custkey % 3 AS INT) AS account, CAST(o_orderkey % 4 AS INT) AS channel, CAST((o_orderkey * 7) & 55 AS INT) AS st FROM orders",
    "channels": "SELECT DISTINCT account, channel, channel <> 3 AS expunge FROM o",
    "pairs": "SELECT account, channel, CASE WHEN k % 13 <> 0 THEN k + 1 END AS fuid, CASE WHEN k % 17 <> 0 THEN k + 1 END AS nuid, st AS flags FROM o WHERE k % 11 <> 0 AND NOT (account = 2 AND channel = 2)",
    "far": f"SELECT account, channel, k + 1 AS uid, CAST({_FAR} AS INT) AS flags, k AS modseq FROM o WHERE CASE WHEN account = 2 AND channel = 1 THEN k % 11 <> 0 AND k % 13 <> 0 ELSE k % 5 <> 0 END UNION ALL SELECT account, channel, k + 1 + {NEW_FAR} AS uid, CAST({_FAR} AS INT) AS flags, k AS modseq FROM o WHERE k % 10 = 3",
    "near": f"SELECT account, channel, CASE WHEN NOT ({_LOCAL}) THEN k + 1 END AS uid, CAST({_NEAR} AS INT) AS flags, '17.' || CAST(k AS STRING) || '.h' || CASE WHEN {_LOCAL} THEN '' ELSE ',U=' || CAST(k + 1 AS STRING) END || CASE WHEN k % 2 = 0 THEN ':2,X' ELSE '' END AS name, CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS indir FROM o WHERE k % 7 <> 0",
    "state": "SELECT account, channel, NOT (account = 2 AND channel = 2) AS present, 7 AS fuidval, CASE WHEN account = 2 AND channel = 2 THEN 0 ELSE 9 END AS nuidval, CASE WHEN account = 2 AND channel = 2 THEN 0 ELSE max(k) + 1 END AS maxpulled, max(k) + 1 AS maxpushed, CASE WHEN account = 0 AND channel = 1 THEN 10 WHEN account = 2 AND channel = 2 THEN 0 ELSE 9 END AS uvval, max(k) + 1 AS uvlast, account = 1 AND channel = 3 AS journal FROM o GROUP BY account, channel",
    "stats": 'SELECT account, channel, count(*) AS "exists", CASE WHEN account = 1 AND channel = 1 THEN 8 ELSE 7 END AS uidvalidity, max(uid) + 1 AS uidnext, CASE WHEN account = 2 THEN 500 ELSE max(modseq) + 1 END AS modseq FROM far GROUP BY account, channel',
    "mtimes": "SELECT account, channel, 100 + channel AS curs, 5 AS curn, 200 AS news, 6 AS newn FROM channels",
    "baseline": 'SELECT s.account, s.channel, CASE WHEN s.account = 0 THEN 1 ELSE 2 END AS version, 7 AS uidval, s.uidnext, s."exists" + CASE WHEN s.account = 2 AND s.channel = 3 THEN 0 ELSE 1 END AS "exists", CASE WHEN s.account = 2 THEN s.modseq ELSE CAST(floor(s.modseq / 2.0) AS BIGINT) END AS modseq, CASE WHEN s.account = 2 AND s.channel = 1 THEN 0 ELSE 3 END AS ghosts, 5 AS nlocal, 100 + s.channel AS curs, 5 AS curn, 200 AS news, 6 AS newn FROM stats s WHERE NOT (s.account = 0 AND s.channel = 3)',
    "appended": f"SELECT account, channel, name, CAST(substr(name, 4, position('.h' IN name) - 4) AS BIGINT) + {3 * NEW_FAR} AS fuid FROM near WHERE uid IS NULL AND CAST(substr(name, 4, position('.h' IN name) - 4) AS BIGINT) % 3 <> 0",
    "fetched": f"SELECT account, channel, uid, flags | CASE WHEN modseq % 7 = 0 THEN 8 ELSE 0 END AS flags FROM far WHERE uid > {NEW_FAR}",
}

#: The same in DuckDB, as common table expressions.
SQL = ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items())


class Snapshots:
    """The tables as DataFrames; `box` is a run over them whose folders are known, `checked` one whose counters are too."""

    def __init__(self, spark: SparkSession, sf_dir: str, sync: bool = False, force: bool = False):
        made: dict[str, DataFrame] = {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")}
        for name, body in TABLES.items():
            text = body.replace('"', "`")
            used = [t for t in made if f"FROM {t}" in text]
            for t in used:
                text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            made[name] = spark.sql(text, **{t: made[t] for t in used})
        self.tables = made
        self.appended, self.fetched = made["appended"], made["fetched"]
        self.scratch = Scratch(spark, "snapshots")
        raw = Mailbox(**{t: made[t] for t in ("channels", "pairs", "near", "far", "state", "stats", "baseline", "mtimes")}, sync=sync, force=force)
        self.box = settled(raw, self.store)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.write(df, name)

    @cached_property
    def checked(self) -> Mailbox:
        return settled(self.box, self.store, checked=True)
