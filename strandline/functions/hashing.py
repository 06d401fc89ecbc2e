"""Content hashes, content-addressed ids and hash-uniform weights."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_sha256(text: Column) -> Column:
    """sha256 of a text's UTF-8 bytes."""
    return F.sha2(text, 256)


def paragraph_digest(title: Column, text: Column) -> Column:
    """sha256 of the compact JSON array [title, text]; both sides of a join must use this one expression."""
    return F.sha2(F.to_json(F.array(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))), 256)


def first_64_bits(digest: Column) -> Column:
    """The first eight bytes of a hex digest, as DECIMAL(20,0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def uniform_weight(namespace: str, global_step: Column, key: Column) -> Column:
    """A weight in [0, 1) that depends on namespace, step and key alone: 64 bits of their sha256, over 2^64."""
    joined = F.concat(F.lit(f"{namespace}\0"), global_step.cast("string"), F.lit("\0"), key)
    return first_64_bits(F.sha2(joined, 256)).cast("double") / F.lit(2.0**64)


def stable_int(text: Column) -> Column:
    return first_64_bits(F.sha2(text, 256))


def code_artifact_id(ordinal: Column, code: Column) -> Column:
    """``code:{ordinal}:{first 12 hex digits of the code's sha256}``."""
    return F.concat(F.lit("code:"), ordinal.cast("string"), F.lit(":"), F.substring(F.sha2(code, 256), 1, 12))


def task_id(source: Column, question: Column, prefix: str = "taco:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(source, F.lit("\n"), question), 256), 1, 20))


def canonical_json(value) -> str:
    """Compact JSON with sorted keys; sets become sorted lists."""

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (set, frozenset)):
            return sorted(plain(v) for v in x)
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json_sha256(texts: pd.Series) -> pd.Series:
    """sha256 of a JSON text brought to canonical form; null for what is not JSON."""

    def one(t: str | None) -> str | None:
        try:
            return hashlib.sha256(canonical_json(json.loads(t)).encode()).hexdigest() if t is not None else None
        except ValueError:
            return None

    return texts.map(one)


def cache_key(*parts: Column) -> Column:
    """A request's key: equal requests have equal keys, and a null differs from an empty text."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])), 256)
