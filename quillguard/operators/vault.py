"""Reversible tokens: a vault is a keyed table of token and original, in memory, as Parquet, or as Parquet with encrypted originals.

A consistent token is made of a keyed hash of its original, under a secret that is drawn for each vault object and never stored: as hard to guess as
a random one, and the same again if a lost executor's part is computed anew. Other tokens are random and settled (written) before anything uses them.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..sources import storage

SCHEMA = "token string, original string"


def _uuid(x: Column) -> Column:
    return F.regexp_replace(F.substring(x, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")


#: Tokens made of 64 hexadecimal digits.
FORMS = {
    "uuid": _uuid, "hex16": lambda x: F.substring(x, 1, 16), "hex32": lambda x: F.substring(x, 1, 32),
    "alnum16": lambda x: F.substring(F.translate(F.base64(F.unhex(x)), "+/=", ""), 1, 16),
}


class Vault:
    """In memory: a DataFrame. Subclasses keep it in files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.secret = spark, os.urandom(32)
        self.table = spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        return self.table

    def append(self, rows: DataFrame) -> None:
        self.table = storage.settled(self.table.unionByName(rows.select("token", "original")))

    def replace(self, rows: DataFrame) -> None:
        self.table = rows.select("token", "original")

    def lookup(self, tokens: DataFrame) -> DataFrame:
        """token, original of those tokens (token) that are known."""
        return tokens.select("token").distinct().join(self.read(), "token")

    def find_by_original(self, originals: DataFrame) -> DataFrame:
        return originals.select("original").distinct().join(self.read(), "original")

    def delete(self, tokens: DataFrame) -> None:
        self.replace(self.read().join(tokens.select("token").distinct(), "token", "left_anti"))

    def clear(self) -> None:
        self.table = self.spark.createDataFrame([], SCHEMA)

    def __len__(self) -> int:
        return self.read().count()


def _plaintext_allowed() -> bool:
    return os.environ.get("QUILLGUARD_ALLOW_PLAINTEXT_STORAGE", "").lower() in ("1", "true", "yes")


class FileVault(Vault):
    """Parquet at a path; plain originals need QUILLGUARD_ALLOW_PLAINTEXT_STORAGE. Rewrites go to another folder, which the pointer file then names."""

    def __init__(self, spark: SparkSession, path: str, allow_plaintext: bool | None = None):
        if not (self._encrypted() or (allow_plaintext if allow_plaintext is not None else _plaintext_allowed())):
            raise PermissionError("plain originals aren't to be stored; allow it or use EncryptedVault")
        self.spark, self.path, self.secret = spark, path.rstrip("/"), os.urandom(32)
        storage.make_folder(spark, self.path)

    def _encrypted(self) -> bool:
        return False

    def _pointer(self) -> dict:
        """What the one file says that is replaced in one step: the folder of the rows and, in an encrypted vault, their wrapped key."""
        p = f"{self.path}/CURRENT"
        return json.loads(storage.read_text(self.spark, p)) if storage.exists(self.spark, p) else {"data": "data"}

    def _current(self) -> str:
        return f"{self.path}/{self._pointer()['data']}"

    def _raw(self) -> DataFrame:
        """No folder yet is an empty vault; one that can't be read is an error."""
        if not storage.exists(self.spark, self._current()):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self._current())

    def read(self) -> DataFrame:
        return self._raw()

    def append(self, rows: DataFrame) -> None:
        self._seal(rows.select("token", "original")).write.mode("append").parquet(self._current())

    def replace(self, rows: DataFrame) -> None:
        name = f"data-{uuid.uuid4().hex}"
        self._seal(rows.select("token", "original")).write.parquet(f"{self.path}/{name}")
        self._point(self._pointer() | {"data": name})

    def _point(self, to: dict) -> None:
        storage.write_text(self.spark, f"{self.path}/CURRENT", json.dumps(to))

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], SCHEMA))

    def _seal(self, rows: DataFrame) -> DataFrame:
        return rows


class EncryptedVault(FileVault):
    """Originals under a data key, which is wrapped by the key given; rotating wraps a new data key and writes all rows again."""

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        super().__init__(spark, path)
        self.key, to = key, self._pointer()
        if "key" in to:
            self.data_key = self._unwrap(to["key"], key)
        else:
            self.data_key = crypto.generate_key()
            self._point(to | {"key": self._wrapped(key)})

    def _encrypted(self) -> bool:
        return True

    def _unwrap(self, text: str, key: bytes) -> bytes:
        row = self.spark.range(1).select(crypto.decrypt_raw(F.unbase64(F.lit(text)), key).alias("k")).first()
        if row["k"] is None:
            raise ValueError("the key doesn't open this vault")
        return bytes(row["k"])

    def _wrapped(self, key: bytes) -> str:
        return self.spark.range(1).select(crypto.encrypt(F.lit(self.data_key), key).alias("k")).first()["k"]

    def _seal(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("original", crypto.encrypt(F.col("original"), self.data_key))

    def read(self) -> DataFrame:
        return self._raw().withColumn("original", crypto.decrypt(F.col("original"), self.data_key))

    def rotate_key(self, key: bytes) -> None:
        """Rows under a new data key are written first; rows and wrapped key then change in one step, so a crash leaves the old vault or the new."""
        rows, old = self.read(), self.data_key
        self.data_key = crypto.generate_key()
        try:
            name = f"data-{uuid.uuid4().hex}"
            self._seal(rows.select("token", "original")).write.parquet(f"{self.path}/{name}")
            self._point({"data": name, "key": self._wrapped(key)})
        except BaseException:
            self.data_key = old
            raise
        self.key = key


def tokenize(df: DataFrame, column: str, vault: Vault, form: str = "uuid", prefix: str = "tok_", consistent: bool = True, into: str = "token") -> DataFrame:
    """Adds a token for each value; null stays null. Consistent: one token a value, over all columns and calls."""
    made = lambda x: F.concat(F.lit(prefix), FORMS[form](x))
    if not consistent:
        drawn = made(F.sha2(F.concat(F.lit(vault.secret), F.uuid().cast("binary")), 256))
        own = storage.settled(df.withColumn(into, F.when(F.col(column).isNotNull(), drawn)))
        vault.append(own.where(F.col(into).isNotNull()).select(F.col(into).alias("token"), F.col(column).alias("original")))
        return own
    originals = df.where(F.col(column).isNotNull()).select(F.col(column).alias("original")).distinct()
    token = made(crypto.hmac_sha256(F.col("original"), vault.secret))
    vault.append(originals.join(vault.read(), "original", "left_anti").withColumn("token", token))
    known = vault.read().groupBy("original").agg(F.min("token").alias(into))
    return df.join(known, df[column] == known["original"], "left").select(*[df[c] for c in df.columns if c != into], known[into])


def detokenize(df: DataFrame, column: str, vault: Vault, into: str = "original") -> DataFrame:
    known = vault.read().select(F.col("token").alias("_token"), F.col("original").alias("_original"))
    return df.join(known, df[column] == known["_token"], "left").select(*[df[c] for c in df.columns if c != into], known["_original"].alias(into))


@dataclass
class KeyVersion:
    id: str
    version: int
    created: str
    active: bool


class LocalKeys:
    """Versioned keys in a file of the driver, wrapped by a master key where one is given."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.keys: dict[str, list[dict]] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def _save(self) -> None:
        temp = self.path.with_suffix(".new")
        temp.touch(mode=0o600)
        temp.write_text(json.dumps(self.keys))
        temp.replace(self.path)

    def create(self, id: str) -> bytes:
        if id in self.keys:
            raise ValueError(f"there is a key {id}")
        return self._add(id)

    def _add(self, id: str) -> bytes:
        key = crypto.generate_key()
        self.keys.setdefault(id, []).append({"key": base64.b64encode(key).decode(), "created": datetime.now(timezone.utc).isoformat()})
        self._save()
        return key

    def get(self, id: str, version: int | None = None) -> bytes:
        return base64.b64decode(self.keys[id][(version or len(self.keys[id])) - 1]["key"])

    def rotate(self, id: str) -> bytes:
        self.keys[id]
        return self._add(id)

    def list(self) -> list[KeyVersion]:
        return [KeyVersion(i, n, v["created"], n == len(vs)) for i, vs in self.keys.items() for n, v in enumerate(vs, 1)]


class EnvKeys:
    """Keys in environment variables of the driver; they can't be rotated."""

    def __init__(self, prefix: str = "QUILLGUARD_KEY_"):
        self.prefix = prefix

    def get(self, id: str, version: int | None = None) -> bytes:
        from .policy import resolve_key

        return resolve_key(f"env://{self.prefix}{id.upper()}")

    def rotate(self, id: str) -> bytes:
        raise NotImplementedError("keys of the environment can't be rotated")

    def list(self) -> list[KeyVersion]:
        return [KeyVersion(k[len(self.prefix) :].lower(), 1, "", True) for k in os.environ if k.startswith(self.prefix)]
