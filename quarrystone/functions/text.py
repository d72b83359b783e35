"""Tokenisers, hashes and BM25 as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lowered after the cut.

    A text is lowered at once where that gives the same: all but two letters
    have one lower letter, whatever stands beside them. Characters that the
    cut's tables don't know may have lower letters that they know.
    """
    cut = lambda x: F.array_remove(F.split(x, r"[^\p{IsAlphabetic}\p{N}]+"), "")
    return F.when(F.rlike(text, F.lit(r"[\u0130\u03a3\p{Cn}]")), F.transform(cut(text), F.lower)).otherwise(cut(F.lower(text)))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lowered: what token filters look at."""
    return F.transform(F.array_remove(F.split(text, r"[^A-Za-z0-9]+"), ""), F.lower)


def tokens_of(text: str) -> list[str]:
    """tokens() for a query text, in order and without repeats."""
    out, word = [], ""
    for ch in text + " ":
        if ch.isalpha() or ch.isnumeric():
            word += ch.lower()
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


def ascii_tokens_of(text: str) -> list[str]:
    out, word = [], ""
    for ch in text + " ":
        if ch.isascii() and ch.isalnum():
            word += ch.lower()
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


def stable_hash(id_: Column) -> Column:
    """16 hex digits that order documents where scores tie."""
    return F.substring(F.sha2(id_, 256), 1, 16)


def term_hash(term: Column) -> Column:
    return F.sha2(F.lower(F.trim(term)), 256)


def shard_of(collection: Column | str, namespace: Column | str, id_: Column, shards: int) -> Column:
    """The shard of an id: the first 64 bits of a SHA-256, modulo the number of shards."""
    if shards <= 1:
        return F.lit(0)
    c, n = (x if isinstance(x, Column) else F.lit(x) for x in (collection, namespace))
    digest = F.sha2(F.concat_ws("\x1f", c, n, id_), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(shards).cast("decimal(20,0)")).cast("int")


def shard_namespace(namespace: Column, shard: Column) -> Column:
    return F.concat(namespace, F.lit("__tvs"), F.lpad(shard.cast("string"), 4, "0"))


def parse_shard_namespace(name: Column) -> tuple[Column, Column]:
    """The namespace, and the shard or null."""
    pattern = r"(?s)^(.*)__tvs(\d{4})$"
    found = name.rlike(pattern)
    return F.when(found, F.regexp_extract(name, pattern, 1)).otherwise(name), F.when(found, F.regexp_extract(name, pattern, 2).cast("int"))


def idf(documents: Column, df: Column) -> Column:
    n, d = documents.cast("double"), F.least(df, documents).cast("double")
    return F.when((n <= 0) | (d <= 0), F.lit(0.0)).otherwise(F.log(1.0 + (n - d + 0.5) / (d + 0.5)))


def bm25(idf_: Column, tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    mean = F.when(average > 0, average).otherwise(F.lit(1.0))
    return idf_ * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / mean))


def key_category(key: Column) -> Column:
    """What a storage key holds."""
    has, ends = (lambda s: F.contains(key, F.lit(s))), (lambda s: F.endswith(key, F.lit(s)))
    return (
        F.when(ends("/metadata.json"), "metadata")
        .when(has("/manifests/"), "manifest")
        .when(has("/segments/"), "segment")
        .when(has("/ann/") & ends("/meta.json"), "ann_meta")
        .when(has("/ann/") & has("/buckets/"), "ann_bucket")
        .when(has("/ann/") & has("/filters/"), "filter")
        .when(ends("/queue/wal.json"), "queue")
        .when(has("/operations/"), "status")
        .otherwise("other")
    )


def lag_seconds(accepted: Column, applied: Column) -> Column:
    """Seconds from one RFC 3339 time to another, as texts with a zone; null if either isn't one."""
    return F.try_to_timestamp(applied).cast("double") - F.try_to_timestamp(accepted).cast("double")
