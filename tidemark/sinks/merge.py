"""Tables of one row per key that batches are merged into: the upserts of trades, books, candles, markets, outcomes,
snapshots and the owners of tokens.

The row that stays under a key is that of the largest (or smallest) order columns, other columns breaking ties, never
the one that happened to arrive last. Merging is so commutative and idempotent: batches that are replayed, split or
reordered give one same table, and a failed merge can simply be run again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


class MergeTable:
    """Rows of `schema` under `path`, dealt to `buckets` by a hash of the key.

    A merge reads and rewrites only the buckets that its batch touches, into a new folder. It takes effect by one small
    file in versions/, made exclusively and ended by a mark, that names the folder of every bucket: readers see all of a
    merge or nothing, and of two merges that began from one version the second fails and is to be repeated. Null parts
    of a key equal each other. The driver holds names of buckets only."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str], first: bool = False, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        rest = [c for c in schema.names if c not in key and c not in order]
        self.values, self.best = [*order, *rest], F.min if first else F.max
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> tuple[int, dict[int, str]]:
        """The newest finished version and its bucket folders; 0 and none for a new table."""
        if not self._fs.exists(self._p("versions")):
            return 0, {}
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._p("versions")) if f.getPath().getName().isdigit()), reverse=True)
        for name in names:
            stream = self._fs.open(self._p(f"versions/{name}"))
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("end\n"):
                return int(name), {int(b): f for b, f in (line.split("\t") for line in text.splitlines()[:-1])}
        return 0, {}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._read(list(self.version()[1].values()))

    def merge(self, batch: DataFrame) -> int:
        """The version that holds the batch; an empty batch changes nothing."""
        number, folders = self.version()
        batch = batch.select(self.schema.names)
        touched = [r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return number
        both = batch.unionByName(self._read([folders[b] for b in touched if b in folders]))
        kept = both.groupBy(*self.key).agg(self.best(F.struct(*self.values)).alias("_v")).select(*self.key, "_v.*").select(self.schema.names)
        new = f"data/{uuid.uuid4().hex}"
        # Small buckets share tasks and large ones are split, by their measured sizes.
        kept.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{new}")
        folders |= {b: f"{new}/_bucket={b}" for b in touched}
        stream = self._fs.create(self._p(f"versions/{number + 1:010d}"), False)
        stream.write(bytearray("".join(f"{b}\t{f}\n" for b, f in sorted(folders.items())).encode() + b"end\n"))
        stream.close()
        return number + 1

    def vacuum(self) -> int:
        """Delete the folders that the newest version doesn't name; to be run when no reader or writer is at an older
        one. The number of folders deleted."""
        used, gone = {f"data/{f.split('/')[1]}" for f in self.version()[1].values()}, 0
        for f in self._fs.listStatus(self._p("data")) if self._fs.exists(self._p("data")) else []:
            name = f"data/{f.getPath().getName()}"
            if name not in used:
                self._fs.delete(self._p(name), True)
                gone += 1
        return gone


def trade_hash(token: Column, event_ts: Column, price: Column, size: Column, side: Column) -> Column:
    """The identity of a trade that has neither hash nor sequence number: SHA-256 of its fields as JSON with sorted keys,
    the time with microseconds, price and size with eight decimals."""
    eight = lambda c: c.cast("decimal(28,8)").cast("string")
    at = F.concat(F.date_format(event_ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    fields = F.struct(at.alias("event_ts"), eight(price).alias("price"), side.alias("side"), eight(size).alias("size"), token.cast("string").alias("token_id"))
    return F.sha2(F.to_json(fields), 256)


#: Keys of the tables; what stays under each is the row ingested last.
KEYS = {
    "trades": ["token", "event_ts", "seq", "trade_hash"],
    "orderbook_snapshots": ["token", "event_ts"],
    "candles": ["token", "width", "start_ts"],
    "markets": ["market_id"],
    "market_outcomes": ["market_id"],
    "feature_snapshots": ["run_id", "market_id", "asof_ts", "version"],
}


class TokenOwners:
    """Which market and outcome a token belongs to. claims (market_id, outcome, token_id, at): the earliest claim owns the
    token for good, later claims of others are conflicts; a market's outcome has the last token of its own that it
    claimed. Both follow from two merged tables, so the order in which batches came does not matter. (A token whose
    owner has moved on to another stays with it: to free it would make the result depend on the order of batches.)"""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64):
        first, last = ("token_id", "at", "market_id", "outcome"), ("market_id", "outcome", "token_id", "at")
        pick = lambda names: StructType([schema[n] for n in names])
        self.owners = MergeTable(spark, f"{path}/owners", pick(first), ["token_id"], ["at", "market_id", "outcome"], first=True, buckets=buckets)
        self.claims = MergeTable(spark, f"{path}/claims", pick(last), ["market_id", "outcome", "token_id"], ["at"], buckets=buckets)

    def merge(self, claims: DataFrame) -> None:
        rows = claims.where("token_id IS NOT NULL AND market_id IS NOT NULL AND outcome IS NOT NULL")
        self.owners.merge(rows)
        self.claims.merge(rows)

    def _judged(self) -> DataFrame:
        o = self.owners.read().select("token_id", F.col("market_id").alias("existing_market_id"), F.col("outcome").alias("existing_outcome"))
        same = (F.col("market_id") == F.col("existing_market_id")) & (F.col("outcome") == F.col("existing_outcome"))
        return self.claims.read().join(o, "token_id").withColumn("own", same)

    def tokens(self) -> DataFrame:
        """(market_id, outcome, token_id)."""
        best = F.max(F.struct("at", "token_id")).alias("m")
        return self._judged().where("own").groupBy("market_id", "outcome").agg(best).select("market_id", "outcome", F.col("m.token_id").alias("token_id"))

    def conflicts(self) -> DataFrame:
        """(market_id, outcome, token_id, existing_market_id, existing_outcome): each refused claim once."""
        return self._judged().where("NOT own").select("market_id", "outcome", "token_id", "existing_market_id", "existing_outcome")
