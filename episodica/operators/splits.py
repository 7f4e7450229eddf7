"""Train and test halves of a task pool, content-addressed."""

from __future__ import annotations

import hashlib
import json
import os
import random
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

RANDOM_ONCE = "random_once_fixed"
UPSTREAM = "from_upstream"


@dataclass(frozen=True)
class Split:
    """Immutable: sha256 covers domain, strategy, seed and both id lists, but no notes or times."""

    domain: str
    strategy: str
    seed: int
    train: tuple[str, ...]
    test: tuple[str, ...]
    notes: str | None = None
    sha256: str = field(default="")

    def __post_init__(self):
        if not self.sha256:
            object.__setattr__(self, "sha256", self.digest())

    def canonical_bytes(self) -> bytes:
        held = {"schema_version": "split/1.0", "domain": self.domain, "sampling": {"strategy": self.strategy, "seed": self.seed}, "train_task_ids": sorted(self.train), "test_task_ids": sorted(self.test)}
        return json.dumps(held, sort_keys=True, separators=(",", ":")).encode()

    def digest(self) -> str:
        return hashlib.sha256(self.canonical_bytes()).hexdigest()

    def verify(self) -> None:
        """Refuse a split whose ids no longer give its address, or whose halves meet or are empty."""
        if self.digest() != self.sha256:
            raise ValueError(f"split {self.sha256[:12]} doesn't match its contents")
        if not self.train or not self.test:
            raise ValueError("both halves of a split need tasks")
        if both := sorted(set(self.train) & set(self.test)):
            raise ValueError(f"{len(both)} task(s) in both halves: {both[:5]}")


def task_pool(df: DataFrame, task: str = "task_id") -> list[str]:
    """Distinct task ids, sorted: tens to thousands."""
    return [r[0] for r in df.select(F.col(task).cast("string")).distinct().orderBy(task).collect()]


def build_split(domain: str, tasks: list[str], train: int, test: int, seed: int, strategy: str = RANDOM_ONCE, notes: str | None = None) -> Split:
    """By CPython's generator over the sorted distinct pool, so the order of tasks doesn't matter."""
    pool = sorted(set(tasks))
    if len(pool) < train + test:
        raise ValueError(f"{domain!r} has {len(pool)} distinct tasks; the split needs {train + test}")
    random.Random(seed).shuffle(pool)
    return Split(domain, strategy, seed, tuple(sorted(pool[:train])), tuple(sorted(pool[train : train + test])), notes)


def split_from_upstream(domain: str, train: list[str], test: list[str], notes: str | None = None) -> Split:
    return Split(domain, UPSTREAM, 0, tuple(sorted(set(train))), tuple(sorted(set(test))), notes)


def hash_split(df: DataFrame, train: int, test: int, seed: int, task: str = "task_id") -> DataFrame:
    """(task_id, split) for pools of any size: tasks in the order of sha256(seed:task). Other ids than build_split."""
    place = _in_hash_order(df, seed, task).filter(F.col("place") <= train + test)
    return place.select("task_id", F.when(F.col("place") <= train, "train").otherwise("test").alias("split"))


def hash_halves(df: DataFrame, tenths: int, seed: int, task: str = "task_id") -> DataFrame:
    """(task_id, split) of all tasks: that many tenths of them, rounded down, train. The same order as hash_split."""
    place = _in_hash_order(df, seed, task)
    n = place.agg(F.count(F.lit(1)).alias("n"))
    share = F.floor(F.col("n") * tenths / 10)
    return place.join(F.broadcast(n)).select("task_id", F.when(F.col("place") <= share, "train").otherwise("test").alias("split"))


def _in_hash_order(df: DataFrame, seed: int, task: str) -> DataFrame:
    """Different tasks, numbered by the hash of seed and task."""
    pool = df.select(F.col(task).cast("string").alias("task_id")).filter("task_id is not null").distinct()
    key = pool.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), "task_id"), 256))
    return numbered(key, [], ["key", "task_id"], "place")


def split_table(spark, split: Split) -> DataFrame:
    """(split_sha, domain, task_id, split); test wins where a task is in both."""
    rows = {t: "train" for t in split.train} | {t: "test" for t in split.test}
    return spark.createDataFrame([(split.sha256, split.domain, t, s) for t, s in sorted(rows.items())], "split_sha string, domain string, task_id string, split string")


def write_split(split: Split, folder: str) -> str:
    """Write once: an equal file is left, another one refused."""
    path = os.path.join(folder, f"{split.domain}-{split.sha256[:12]}.json")
    text = json.dumps(asdict(split), sort_keys=True, indent=2) + "\n"
    os.makedirs(folder, exist_ok=True)
    if os.path.exists(path):
        with open(path) as f:
            if f.read() != text:
                raise FileExistsError(f"{path} holds another split")
        return path
    with open(path, "w") as f:
        f.write(text)
    return path


def load_split(path: str) -> Split:
    with open(path) as f:
        held = json.load(f)
    split = Split(**held | {"train": tuple(held["train"]), "test": tuple(held["test"])})
    split.verify()
    return split


def constraint_violations(splits: DataFrame) -> DataFrame:
    """(rule, detail) of splits (sha256, train array, test array) that break a rule: empty half, shared task, repeated address."""
    empty = splits.filter((F.size("train") == 0) | (F.size("test") == 0)).select(F.lit("halves_non_empty").alias("rule"), F.col("sha256").alias("detail"))
    shared = splits.filter(F.arrays_overlap("train", "test")).select(F.lit("halves_disjoint").alias("rule"), F.col("sha256").alias("detail"))
    again = splits.groupBy("sha256").count().filter("count > 1").select(F.lit("unique_sha256").alias("rule"), F.col("sha256").alias("detail"))
    return empty.unionByName(shared).unionByName(again)


SPLIT_ROW = "sha256 string, domain string, strategy string, seed bigint, train array<string>, test array<string>, notes string"


def insert_split(spark, split: Split, root: str) -> None:
    """Append a verified split to the table of splits; one that is stored already is left."""
    split.verify()
    if get_split(spark, root, split.sha256) is None:
        insert_raw(spark, asdict(split), root)


def insert_raw(spark, row: dict, root: str) -> None:
    """Append a row as it is, for what other programs wrote; only its constraints are checked."""
    one = spark.createDataFrame([tuple(row[f.split()[0]] for f in SPLIT_ROW.split(", "))], SPLIT_ROW)
    if found := constraint_violations(one.select("sha256", "train", "test")).first():
        raise ValueError(f"{found['rule']} is broken by {found['detail']}")
    one.write.mode("append").parquet(f"{root}/splits")


def get_split(spark, root: str, sha256: str) -> Split | None:
    """The stored split of that address, verified; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/splits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema(SPLIT_ROW).parquet(f"{root}/splits").filter(F.col("sha256") == sha256).first()
    if row is None:
        return None
    split = Split(row["domain"], row["strategy"], row["seed"], tuple(row["train"]), tuple(row["test"]), row["notes"], row["sha256"])
    split.verify()
    return split
