"""Digests in their compared form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256_DIGITS = 64
GIT_SHA1_DIGITS = 40

#: What counts as a surrounding blank.
BLANKS = " \t\r\n"


def usable_digest(value: Column, digits: int) -> Column:
    """The digest without surrounding blanks and leading ``name:``, in lower case; null if not exactly ``digits`` hex digits remain.

    Null, empty, shortened, longer or non-hex values give null.
    """
    bare = F.lower(F.btrim(value, F.lit(BLANKS)))
    return F.when(bare.rlike(f"^(?:[a-z][a-z0-9_/-]*:)?[0-9a-f]{{{digits}}}$"), F.right(bare, F.lit(digits)))


def git_blob_sha1(content: Column) -> Column:
    """SHA-1 that git gives a blob: of ``blob <bytes>``, a zero byte and the content."""
    header = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), content))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)
