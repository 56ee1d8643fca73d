"""Path identity, containment, resource names and canonical base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix by media type.
SUFFIXES = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "audio/mpeg": ".mp3",
    "audio/mp4": ".m4a",
    "audio/ogg": ".ogg",
    "audio/wav": ".wav",
    "audio/webm": ".webm",
    "application/pdf": ".pdf",
    "text/plain": ".txt",
    "text/plain; charset=utf-8": ".txt",
}
MEDIA_TYPE = r"^[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+(?:; charset=utf-8)?$"
MAX_RESOURCE_BYTES = 64 * 1024 * 1024
_CONTROL = r"[\x00-\x1f\x7f]"


def normalize_posix(path: Column) -> Column:
    """POSIX normalisation: empty and ``.`` segments go, ``..`` removes its parent."""
    absolute = path.startswith("/")
    segments = F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))

    def step(stack: Column, part: Column) -> Column:
        can_pop = (F.size(stack) > 0) & (F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(part != "..", F.array_append(stack, part))
            .when(can_pop, F.slice(stack, F.lit(1), F.size(stack) - 1))
            .when(absolute, stack)
            .otherwise(F.array_append(stack, part))
        )

    empty = F.array().cast("array<string>")
    body = F.array_join(F.aggregate(segments, empty, step), "/")
    trailing = path.endswith("/") & (body != "")
    rooted = F.concat(F.when(absolute, "/").otherwise(""), body, F.when(trailing, "/").otherwise(""))
    return F.when(rooted == "", F.when(path.endswith("/"), "./").otherwise(".")).otherwise(rooted)


def windows_identity(path: Column) -> Column:
    """Windows identity: one separator, verbatim prefixes removed, case folded."""
    flat = F.replace(path, F.lit("/"), F.lit("\\"))
    unc = F.regexp_replace(flat, r"(?i)^\\\\\?\\UNC\\", r"\\\\\\\\")
    plain = F.regexp_replace(unc, r"^\\\\\?\\(?=[A-Za-z]:\\)", "")
    share = F.when(plain.startswith("\\\\"), "\\\\").otherwise("")
    drive = F.regexp_extract(plain, r"^([A-Za-z]:\\?)", 1)
    rest = F.when(share != "", F.substring(plain, F.lit(3), F.length(plain))).otherwise(
        F.substring(plain, F.length(drive) + 1, F.length(plain))
    )
    body = normalize_posix(F.concat(F.lit("/"), F.replace(rest, F.lit("\\"), F.lit("/"))))
    body = F.replace(F.substring(body, F.lit(2), F.length(body)), F.lit("/"), F.lit("\\"))
    return F.lower(F.concat(share, drive, body))


def path_identity(path: Column, windows: bool = False) -> Column:
    return windows_identity(path) if windows else normalize_posix(path)


def path_within(path: Column, root: Column) -> Column:
    """The path is the root or lies below it; compares whole segments of absolute paths."""
    inside = F.startswith(path, F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))
    return path.startswith("/") & ((path == root) | inside)


def relative_segments(path: Column, root: Column) -> Column:
    """Segments of the path below the root, an empty array for the root itself, else null."""
    base = F.regexp_replace(root, "/$", "")
    rest = F.substring(path, F.length(base) + 2, F.length(path))
    return F.when(F.regexp_replace(path, "/$", "") == base, F.array().cast("array<string>")).when(
        path_within(path, root), F.split(rest, "/")
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)


def resource_name(filename: Column, media_type: Column) -> Column:
    """Base name if it is usable, else ``attachment`` plus the suffix of the media type."""
    name = basename(filename)
    usable = ~name.isin("", ".", "..") & (F.octet_length(name) <= 255) & ~name.rlike(_CONTROL)
    suffix = F.create_map(*[F.lit(item) for pair in SUFFIXES.items() for item in pair])
    return F.when(usable, name).otherwise(
        F.concat(F.lit("attachment"), F.coalesce(F.try_element_at(suffix, media_type), F.lit(".bin")))
    )


def valid_media_type(media_type: Column) -> Column:
    return media_type.rlike(MEDIA_TYPE)


def resource_path(sha256: Column, name: Column, root: str = ".convhist") -> Column:
    return F.concat(F.lit(f"{root}/resources/sha256/"), sha256, F.lit("/"), name)


def valid_resource(sha256: Column, size: Column, media_type: Column, name: Column, source: Column, path: Column) -> Column:
    return F.coalesce(
        sha256.rlike("^[0-9a-f]{64}$")
        & size.between(0, MAX_RESOURCE_BYTES)
        & valid_media_type(media_type)
        & ~name.isin("", ".", "..")
        & (F.octet_length(name) <= 255)
        & ~name.rlike(r"[\\/\x00-\x1f\x7f]")
        & (source != "")
        & (F.octet_length(source) <= 4096)
        & ~source.rlike(_CONTROL)
        & (path == resource_path(sha256, name)),
        F.lit(False),
    )


def canonical_base64(value: Column) -> Column:
    """Bytes of a canonical base64 text; null if it is empty, padded oddly or not canonical."""
    data = F.try_to_binary(value, F.lit("base64"))
    again = F.regexp_replace(F.base64(data), r"[\r\n]", "")
    return F.when((F.octet_length(data) > 0) & (F.octet_length(data) <= MAX_RESOURCE_BYTES) & (again == value), data)


def data_uri(value: Column) -> Column:
    """Struct (media_type, bytes) of a canonical base64 data URI, else null."""
    media = F.regexp_extract(value, r"(?s)^data:(.+?);base64,(.*)$", 1)
    data = canonical_base64(F.regexp_extract(value, r"(?s)^data:(.+?);base64,(.*)$", 2))
    return F.when(valid_media_type(media) & data.isNotNull(), F.struct(media.alias("media_type"), data.alias("bytes")))


def valid_evidence_reference(kind: Column, namespace: Column, locator: Column, has_document_fields: Column) -> Column:
    """File, image or document reference; only documents may carry title, context or citations."""
    return F.coalesce(
        kind.isin("file", "image", "document")
        & namespace.rlike(r"^[a-z][a-z0-9._-]{0,63}$")
        & (locator != "")
        & (F.length(locator) <= 4096)
        & ~locator.rlike(_CONTROL)
        & ((kind == "document") | ~has_document_fields),
        F.lit(False),
    )
