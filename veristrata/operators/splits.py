"""Leakage-free splits by hash rank, and the checks on them.

A key's rank is the SHA-1 of salt:key, so it depends on neither row order nor partitions. Cuts are rounded half to even.
Ranks inside a label are exact positions: keys are numbered inside (label, hash prefix) and shifted by what lies before the prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators.numbering import hash_bucket, numbered

CALIBRATION_SALT = "fever-calibration-v1"
HOLDOUT_SALT = "fever-trainval-v1"
THREE_WAY_SALT = "averitec-splits-v1"
CARVE_SALT = "averitec-trainval-v1"
GROUP_SALT = "checkworthy-split-v1"


def hash_rank(salt: str, key: Column) -> Column:
    """The first eight bytes of the digest as hex: string order is number order."""
    return F.substring(F.sha1(F.concat(F.lit(salt + ":"), key.cast("string")).cast("binary")), 1, 16)


def ranked_keys(rows: DataFrame, salt: str) -> DataFrame:
    """(key, label, n, pos) of distinct keys; a key of two labels belongs to the first label in order."""
    keys = rows.groupBy("key").agg(F.min("label").alias("label")).withColumn("h", hash_rank(salt, F.col("key")))
    return numbered(keys, hash_bucket("h"), ["h", "key"], ["label"]).select("key", "label", "n", "pos")


def stratified_split(rows: DataFrame, fractions: dict[str, float], rest: str, salt: str) -> DataFrame:
    """rows with a split column: each label's first keys by rank go to the first named split, the next to the second, what is left to rest."""
    keys = ranked_keys(rows, salt)
    split, edge = F.lit(None).cast("string"), F.lit(0)
    for name, fraction in fractions.items():
        upto = edge + F.bround(F.col("n") * fraction)
        split = F.coalesce(split, F.when(F.col("pos") <= upto, name))
        edge = upto
    return rows.join(keys.select("key", F.coalesce(split, F.lit(rest)).alias("split")), "key")


def holdout(rows: DataFrame, per_label: int, salt: str = HOLDOUT_SALT) -> DataFrame:
    """rows with held: exactly per_label keys of each label; a label with fewer raises."""
    keys = ranked_keys(rows, salt)
    enough = F.when(F.col("n") < per_label, F.raise_error(F.concat(F.lit("too few keys of label "), F.col("label").cast("string")))).otherwise(F.col("pos") <= per_label)
    return rows.join(keys.select("key", enough.cast("boolean").alias("held")), "key")


def group_split(groups: DataFrame, test: int, calibration: int, salt: str = GROUP_SALT) -> DataFrame:
    """(name, split) of distinct group names in SHA-256 order: first test, then calibration, the rest train."""
    h = F.sha2(F.concat(F.lit(salt + ":"), F.col("name")).cast("binary"), 256)
    return numbered(groups.select("name").distinct().withColumn("h", h), hash_bucket("h"), ["h", "name"]).select("name", F.when(F.col("pos") <= test, "test").when(F.col("pos") <= test + calibration, "calibration").otherwise("train").alias("split"))


def budget_prefix(groups: DataFrame, limit: int, salt: str) -> DataFrame:
    """(key, n, running) of the longest run of groups in hash order whose rows stay within limit; it ends at the first group that would not fit."""
    hashed = groups.select("key", F.col("n").alias("rows"), hash_rank(salt, F.col("key")).alias("h"))
    return numbered(hashed, hash_bucket("h"), ["h", "key"], weight="rows").where(F.col("running") <= limit).select("key", F.col("rows").alias("n"), "running")


def drop_leaked(train: DataFrame, *held_out: DataFrame) -> DataFrame:
    """train rows whose key is in no held-out split."""
    for split in held_out:
        train = train.join(split.select("key").distinct(), "key", "left_anti")
    return train


def split_conflicts(rows: DataFrame) -> DataFrame:
    """(key, n_splits) of keys that stand in more than one split; none if the splits are sound."""
    return rows.groupBy("key").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def split_summary(rows: DataFrame) -> DataFrame:
    """Rows of each split and label, and their share of the split; label null: the whole split."""
    found = rows.groupingSets([["split", "label"], ["split"]], "split", "label").agg(F.count("*").alias("n"))
    whole = rows.groupBy("split").agg(F.count("*").alias("total"))
    return found.join(F.broadcast(whole), "split").select("split", "label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def folds(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """rows with fold 0..k-1: positions by hash, parts of equal size but for the first n mod k. By hash, since a generator's stream has no distributed form."""
    placed = numbered(rows.withColumn("_h", hash_rank(str(seed), F.col("id"))), hash_bucket("_h"), ["_h", "id"])
    return placed.withColumn("fold", tile("pos", "n", k)).drop("_h", "pos", "n")


def tile(pos: str, n: str, k: int) -> Column:
    """The part 0..k-1 of a place among n: parts of equal size, the first n mod k of them one longer."""
    size, longer = F.floor(F.col(n) / k), F.col(n) % k
    at, edge = F.col(pos) - 1, (size + 1) * longer
    return F.when(at < edge, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(size, F.lit(1)))).cast("int")


def systematic(rows: DataFrame, every: int, position: str) -> DataFrame:
    return rows.where(F.pmod(F.col(position), F.lit(every)) == 0)
