"""Object keys, paths and content types."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Extension to content type.
CONTENT_TYPES = {"avif": "image/avif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "webp": "image/webp"}
# Image extensions an inventory accepts, and the cache policy.
IMAGE_EXTENSIONS = ("avif", "heic", "heif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
IMMUTABLE_CACHE = "public, max-age=31536000, immutable"

# Forms of ids and digests, to be matched as a whole.
PHOTO_ID = r"p_[a-f0-9]{32}"
FACE_ID = r"f_[a-f0-9]{32}"
PERSON_ID = r"person_[a-f0-9]{32}"
CLUSTER_ID = r"c_[a-zA-Z0-9_-]{8,80}"
MUTATION_ID = r"[a-zA-Z0-9_-]{8,100}"
SLUG = r"[a-z0-9]+(-[a-z0-9]+)*"
SEED = r"[a-f0-9]{8,64}"
SHA256 = r"[a-f0-9]{64}"
UNSAFE_KEY = r"(^|/)\.{0,2}(/|$)|\\|[\x00-\x1f\x7f]"
RUN_ID = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"


def whole(pattern: str) -> str:
    """The pattern for a whole value; ``$`` would also match before a last line feed."""
    return rf"\A(?:{pattern})\z"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def content_type(key: Column) -> Column:
    """image/webp unless the key ends in a known other extension."""
    ext = extension(key)
    return (
        F.when(ext == "avif", "image/avif")
        .when(ext.isin("jpeg", "jpg"), "image/jpeg")
        .otherwise("image/webp")
    )


def valid_slug(slug: Column) -> Column:
    return F.coalesce(F.length(slug).between(1, 128) & slug.rlike(whole(SLUG)), F.lit(False))


def valid_seed(seed: Column) -> Column:
    return F.coalesce(seed.rlike(whole(SEED)), F.lit(False))


def matches(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(whole(pattern)), F.lit(False))


def parse_photo_key(key: Column, prefix: str) -> Column:
    """struct(shard, photo_hash, kind, sha, ext); null when the key is not one.

    One pattern match decides; the parts then sit at known places.
    """
    pattern = (
        f"^{re.escape(prefix)}/[a-f0-9]{{2}}/p_[a-f0-9]{{32}}/(thumb|display)"
        r"-[a-f0-9]{20}\.(webp|avif|jpeg)\z"
    )
    start = len(prefix) + 2
    name = F.substring(key, start + 38, 64)
    return F.when(
        key.rlike(pattern),
        F.struct(
            F.substring(key, start, 2).alias("shard"),
            F.substring(key, start + 5, 32).alias("photo_hash"),
            F.substring_index(name, "-", 1).alias("kind"),
            F.substring(F.substring_index(name, "-", -1), 1, 20).alias("sha"),
            F.substring_index(name, ".", -1).alias("ext"),
        ),
    )


def parse_avatar_key(key: Column, prefix: str) -> Column:
    """struct(person_id, sha); null when the key is not an avatar key."""
    pattern = (
        f"^{re.escape(prefix)}/people/(person_[a-f0-9]{{32}})/avatar-([a-f0-9]{{20}})\\.webp\\z"
    )
    return F.when(
        key.rlike(pattern),
        F.struct(
            F.regexp_extract(key, pattern, 1).alias("person_id"),
            F.regexp_extract(key, pattern, 2).alias("sha"),
        ),
    )


def unsafe_key(key: Column) -> Column:
    """Absolute, backslash, control character, or an empty/dot path segment."""
    return F.coalesce(key.rlike(UNSAFE_KEY), F.lit(True))


def outside_root(path: Column, root: str) -> Column:
    """True unless the path stays below ``root`` with no parent steps."""
    inside = path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")
    return ~F.coalesce(inside, F.lit(False))


def private_crop_path(path: Column, root: str) -> Column:
    """Below the private root, with a 'crops' folder on the way."""
    below = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)
    return ~outside_root(path, root) & F.array_contains(F.split(below, "/"), "crops")


def encode_segments(key: Column) -> Column:
    """Percent-encode each path segment, keeping the slashes.

    Keys of unreserved characters only, the usual case, are left as they are.
    """
    encoded = F.transform(
        F.split(key, "/"),
        lambda s: F.regexp_replace(
            F.regexp_replace(
                F.regexp_replace(
                    F.regexp_replace(
                        F.regexp_replace(
                            F.regexp_replace(F.url_encode(s), r"\+", "%20"), "%21", "!"
                        ),
                        "%27", "'",
                    ),
                    "%28", "(",
                ),
                "%29", ")",
            ),
            "%7E", "~",
        ),
    )
    return F.when(key.rlike(r"^[A-Za-z0-9/._-]*\z"), key).otherwise(F.array_join(encoded, "/"))
