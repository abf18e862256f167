"""Large values as content-addressed objects, garbage collection, and encryption of values."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values longer than this are kept as objects.
OBJECT_SIZE = 1024
_TOKEN = b"strandlog-password-check"


def separate(log: DataFrame, limit: int = OBJECT_SIZE) -> DataFrame:
    """Replace long values by their SHA-256 and size."""
    long = (F.col("op") == "data") & (F.octet_length("value") > limit)
    return log.withColumns({
        "obj_hash": F.when(long, F.sha2("value", 256)).otherwise(F.col("obj_hash")),
        "obj_size": F.when(long, F.octet_length("value").cast("bigint")).otherwise(F.col("obj_size")),
        "value": F.when(~long, F.col("value")),
    })


def objects(log: DataFrame, limit: int = OBJECT_SIZE) -> DataFrame:
    """(ns, obj_hash, obj_size, data): each long value once per namespace."""
    long = log.where((F.col("op") == "data") & (F.octet_length("value") > limit))
    rows = long.select("ns", F.sha2("value", 256).alias("obj_hash"), F.octet_length("value").cast("bigint").alias("obj_size"), F.col("value").alias("data"))
    return rows.dropDuplicates(["ns", "obj_hash"])


def resolve(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Fill in the bytes of separated values."""
    data = store.select("ns", "obj_hash", "data")
    met = rows.join(data, ["ns", "obj_hash"], "left")
    return met.withColumn("value", F.coalesce("value", "data")).select(rows.columns)


def referenced(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Objects that some row still points to."""
    return store.join(rows.where("obj_hash IS NOT NULL").select("ns", "obj_hash"), ["ns", "obj_hash"], "left_semi")


def orphans(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Objects that no row points to."""
    return store.join(rows.where("obj_hash IS NOT NULL").select("ns", "obj_hash"), ["ns", "obj_hash"], "left_anti")


def derive_key(password: str, salt: bytes) -> bytes:
    """256-bit key of a namespace, on the driver; memory-hard."""
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def new_salt() -> bytes:
    return os.urandom(16)


def encrypt(value: Column, key: bytes) -> Column:
    """AES-256-GCM, nonce first; null stays null."""
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(value, F.lit(key), F.lit("GCM"))


def encrypt_values(log: DataFrame, key: bytes) -> DataFrame:
    """Only data is encrypted; keys, nulls and tombstones stay readable."""
    return log.withColumn("value", F.when(F.col("op") == "data", encrypt(F.col("value"), key)).otherwise(F.col("value")))


def decrypt_values(log: DataFrame, key: bytes) -> DataFrame:
    return log.withColumn("value", F.when((F.col("op") == "data") & F.col("value").isNotNull(), decrypt(F.col("value"), key)).otherwise(F.col("value")))


def verification_token(spark, key: bytes) -> bytes:
    return bytes(spark.range(1).select(encrypt(F.lit(_TOKEN), key)).first()[0])


def password_fits(spark, token: bytes, key: bytes) -> bool:
    found = spark.range(1).select(F.try_aes_decrypt(F.lit(token), F.lit(key), F.lit("GCM"))).first()[0]
    return found is not None and bytes(found) == _TOKEN
