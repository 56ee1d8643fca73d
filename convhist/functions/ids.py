"""Content-derived identity: canonical JSON digests, framed digests, references, cursors, UUIDs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The source kinds in product order. The order matters for sorting.
SOURCE_KINDS = ("event_log", "uuid_graph", "table_store", "record_tree")
REFERENCE_PATTERN = rf"^({'|'.join(SOURCE_KINDS)}):([0-9a-z_]{{1,64}})$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CURSOR_PREFIX = "cursor1_"
# JSON for digests: null members stay, times keep their microseconds.
EXACT_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def canonical_json(**fields: Column) -> Column:
    """JSON object with sorted keys; null members are kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), EXACT_JSON)


def canonical_digest(prefix: str, **fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(canonical_json(**fields), 256))


def framed_digest(*parts: Column) -> Column:
    """SHA-256 over parts that each carry their byte length, so no two part lists collide.

    A null part has a mark of its own: the digest is never null and unknown differs from empty.
    """
    texts = [part.cast("string") for part in parts]
    framed = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-1:")) for text in texts]
    return F.sha2(F.concat(*framed), 256)


def framed(text: Column) -> Column:
    """Text behind its byte length."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def structural_text(value: Column, kind: T.DataType) -> Column:
    """Canonical text of a nested value, built bottom up along its type; null only for a null value.

    Members of structs and maps are sorted by name and null ones left out, so a wider type gives the same text; list
    elements keep their order and their nulls. Every part is framed and leaves carry a mark of their type, so different
    values differ.
    """
    if isinstance(kind, T.StructType):
        members = []
        for field in sorted(kind.fields, key=lambda f: f.name):
            inner = structural_text(value[field.name], field.dataType)
            members.append(F.coalesce(F.concat(framed(F.lit(field.name)), framed(inner)), F.lit("")))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), *members, F.lit("}")))
    if isinstance(kind, T.ArrayType):
        element = lambda x: framed(F.coalesce(structural_text(x, kind.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(F.transform(value, element), ""), F.lit("]"))
    if isinstance(kind, T.MapType):
        member = lambda k: F.concat(framed(k.cast("string")), framed(structural_text(F.element_at(value, k), kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), member), ""), F.lit("}"))
    if isinstance(kind, T.VariantType):
        return F.concat(F.lit("v"), F.to_json(value))  # a variant keeps its members sorted by name
    if isinstance(kind, T.StringType):
        return F.concat(F.lit('"'), value)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("x"), F.hex(value))
    return F.concat(F.lit("?" if isinstance(kind, T.BooleanType) else "#"), value.cast("string"))


def binary_framed_digest(*parts: Column) -> Column:
    """SHA-256 over parts framed with an eight-byte big-endian length."""
    framed = []
    for part in parts:
        data = part.cast("binary")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data]
    return F.sha2(F.concat(*framed), 256)


def session_reference(kind: Column, native_id: Column) -> Column:
    """Reference whose prefix names the source kind; UUID ids are compared in lower case."""
    return F.concat(kind, F.lit(":"), binary_framed_digest(F.lit("session/1"), kind, F.lower(native_id)))


def valid_reference(reference: Column) -> Column:
    return reference.rlike(REFERENCE_PATTERN)


def reference_kind(reference: Column) -> Column:
    """Source kind encoded in a reference; null if the reference is malformed."""
    return F.when(valid_reference(reference), F.regexp_extract(reference, REFERENCE_PATTERN, 1))


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in SOURCE_KINDS]), kind).cast("bigint")


def encode_cursor(reference: Column) -> Column:
    packed = F.regexp_replace(F.base64(reference.cast("binary")), r"[\r\n=]", "")
    return F.concat(F.lit(CURSOR_PREFIX), F.translate(packed, "+/", "-_"))


def decode_cursor(cursor: Column) -> Column:
    """Reference inside a cursor; null unless the cursor is in canonical form."""
    body = F.translate(F.substring(cursor, F.lit(len(CURSOR_PREFIX) + 1), F.length(cursor)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(cursor.startswith(CURSOR_PREFIX) & (text != "") & (encode_cursor(text) == cursor), text)


def conversion_key(source: Column, target: Column, reference: Column, revision: Column) -> Column:
    key = F.concat(F.lit("conversion1_"), framed_digest(F.lit("portable/1"), source, target, reference, revision))
    return F.when(source != target, key)


def derived_uuid(key: Column, purpose: Column | str) -> Column:
    """Deterministic version-4 shaped UUID for one purpose of a conversion."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    digest = F.sha2(F.concat(F.lit("converted-uuid/1|"), purpose, F.lit("|"), key), 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def multiset_digest(prefix: str, row_digest: Column) -> Column:
    """Aggregate: order-independent digest of a group of rows.

    Sums four 64-bit lanes of each row's SHA-256. Sums combine map-side, so a group of any size is
    hashed without being collected. Put the position into the row digest to make it order-sensitive.
    """
    lanes = [
        F.sum(F.conv(F.substring(row_digest, start, 16), 16, 10).cast("decimal(20,0)")).cast("string")
        for start in (1, 17, 33, 49)
    ]
    joined = reduce(lambda left, right: F.concat(left, F.lit("|"), right), lanes)
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.count(row_digest).cast("string"), F.lit("|"), joined), 256))


def epoch_time(value: Column, milliseconds: bool, fallback: Column) -> Column:
    """Epoch seconds or milliseconds to a zone-less UTC timestamp, else the fallback."""
    millis = (value if milliseconds else value * 1000).cast("decimal(18,3)")
    seconds = (millis / 1000).cast("decimal(18,6)")
    zero = F.lit(0)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(start + F.make_dt_interval(zero, zero, zero, seconds), fallback)
