"""Portable text expressions: everything here stays inside the JVM and whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dataset_name(x: Column | str) -> Column:
    """One spelling for each dataset: letters only without case, `lme_ku` with its underscore."""
    key = F.regexp_replace(F.lower(col(x)), "[^a-z]", "")
    return F.when(key == "lmeku", "lme_ku").otherwise(key)


def nfkc(x: Column | str) -> Column:
    """Compatibility normal form, by the JVM's own library; ASCII texts are passed through."""
    x = col(x)
    whole = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), whole).otherwise(x)
