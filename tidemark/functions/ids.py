"""Value-level functions on columns: tags, names, deterministic ids, fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_tag(category: Column | str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(category) if isinstance(category, str) else category, key.cast("string"))


def parse_tag(tag: Column) -> Column:
    """Struct (category, id), null for a text without a colon."""
    at = F.instr(tag, ":")
    return F.when(at > 0, F.struct(F.substring_index(tag, ":", 1).alias("category"), F.substr(tag, at + 1).alias("id")))


def scope_keys(tags: Column, scope: str) -> Column:
    """The keys of one scope among an array of tags, in order, without repeats."""
    prefix = f"{scope}:"
    own = F.filter(tags, lambda t: F.startswith(t, F.lit(prefix)) & (F.length(t) > len(prefix)))
    return F.array_distinct(F.transform(own, lambda t: F.substr(t, F.lit(len(prefix) + 1))))


def key_product(left: Column, right: Column) -> Column:
    """All pairs of two arrays of keys, left-major, without repeats."""
    return F.array_distinct(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(a.alias("left"), b.alias("right"))))))


def snake_case(name: str) -> str:
    """bookId → book_id, HTTPStatus → http_status."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z_]+|_+", name)
    return re.sub(r"_{2,}", "_", "_".join(p for p in parts)).lower()


def name_uuid(name: Column) -> Column:
    """The UUID of version 3 (MD5) of a text without namespace."""
    h = F.md5(name.cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def saga_id(saga: Column, key: Column) -> Column:
    return name_uuid(F.concat_ws(":", saga, key))


def saga_event_id(instance: Column, step: Column, ordinal: Column) -> Column:
    return name_uuid(F.concat_ws(":", instance, step.cast("string"), ordinal.cast("string")))


def idempotency_key(instance: Column, round_: Column, ordinal: Column, label: Column) -> Column:
    return F.concat_ws(":", instance, round_.cast("string"), ordinal.cast("string"), label)


def parse_idempotency_key(text: Column) -> Column:
    """Struct (instance, round, ordinal, label); null unless there are four parts with numbers in the middle. A label may hold colons."""
    p = F.split(text, ":", 4)
    numbers = F.get(p, F.lit(1)).rlike("^[0-9]{1,9}$") & F.get(p, F.lit(2)).rlike("^[0-9]{1,9}$")
    return F.when((F.size(p) == 4) & numbers, F.struct(F.get(p, F.lit(0)).alias("instance"), F.get(p, F.lit(1)).try_cast("int").alias("round"), F.get(p, F.lit(2)).try_cast("int").alias("ordinal"), F.get(p, F.lit(3)).alias("label")))


def expired(deadline: Column, now: Column) -> Column:
    """A missing deadline never expires, an unreadable one has, others have strictly after."""
    return F.when(deadline.isNull(), False).otherwise(F.coalesce(now > F.try_to_timestamp(deadline), F.lit(True)))


def fingerprint(types: Iterable[tuple[str, int]], scopes: Iterable[str]) -> str:
    """A canonical text of event types with versions and of scopes: sorted, each preceded by its length."""
    part = lambda xs: "".join(f"{len(x)}:{x}" for x in sorted(set(xs)))
    return f"{part(f'{t}@{v}' for t, v in types)}|{part(scopes)}"


def fingerprint_column(types: Column, scopes: Column) -> Column:
    """fingerprint() of arrays of `type@version` texts and of scopes."""
    part = lambda xs: F.array_join(F.transform(F.array_sort(F.array_distinct(xs)), lambda x: F.concat_ws(":", F.length(x).cast("string"), x)), "")
    return F.concat_ws("|", part(types), part(scopes))
