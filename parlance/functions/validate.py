"""Checks of uploads and accounts: columns of what is wrong, so that bad rows can be told apart and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import suffix

#: What uploads may be, and what an address and a password have to look like.
ALLOWED = (".wav", ".mp3", ".m4a", ".flac", ".ogg", ".mp4", ".webm")
MIME = ("audio/", "video/")
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MIN_PASSWORD, SPEAKERS = 8, (1, 20)


def found(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail; a check on a null fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def upload_errors(filename: Column, size: Column, mime: Column, speakers: Column, allowed: tuple[str, ...] = ALLOWED, max_mb: int = 500) -> Column:
    """An array of filename, extension, size, mime and speakers, as far as they are wrong; speakers may be null."""
    return found({
        "filename": F.coalesce(filename, F.lit("")) != "",
        "extension": suffix(filename).isin(*allowed),
        "size": size <= max_mb * 1024 * 1024,
        "mime": F.array_contains(F.array(*[F.startswith(mime, F.lit(m)) for m in MIME]), True),
        "speakers": speakers.isNull() | speakers.between(*SPEAKERS),
    })


def new_accounts(wanted: DataFrame, accounts: DataFrame) -> DataFrame:
    """`wanted` (username, email, password, ...) with errors: password, email, username_taken, email_taken."""
    names = accounts.select("username").distinct().withColumn("n_taken", F.lit(True))
    mails = accounts.select("email").distinct().withColumn("m_taken", F.lit(True))
    rows = wanted.join(names, "username", "left").join(mails, "email", "left")
    errors = found({"password": F.length("password") >= MIN_PASSWORD, "email": F.col("email").rlike(EMAIL), "username_taken": F.col("n_taken").isNull(), "email_taken": F.col("m_taken").isNull()})
    return rows.withColumn("errors", errors).select(*wanted.columns, "errors")
