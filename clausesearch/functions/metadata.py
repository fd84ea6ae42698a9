"""Metadata of a source file from its name: {country}_{agency}_{norm}[_{variant}].{suffix}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(name: Column) -> Column:
    return F.split(F.regexp_replace(name, r"\.[^.]*\z", ""), "_")


def parse_file_name(df: DataFrame, name: str = "file_name", strict: bool = False) -> DataFrame:
    """Adds country, agency, norm_id, variant, year and error (null where the name follows the convention).

    The year is the last four-digit number from 1900 to 2099 in the norm. A name with fewer than three
    parts has only an error, or raises if ``strict``; a null name is an error too.
    """
    p = _parts(F.col(name))
    good = F.coalesce(F.size(p) >= 3, F.lit(False))
    years = F.regexp_extract_all(F.get(p, F.lit(2)), F.lit(r"((?:19|20)\d{2})"), 1)
    problem = F.concat(F.lit("file name breaks the naming convention: "), F.coalesce(F.col(name), F.lit("")))
    error = F.when(~good, F.raise_error(problem) if strict else problem)
    variant = F.array_join(F.slice(p, 4, F.greatest(F.size(p), F.lit(4))), "_")
    return df.withColumns({
        "country": F.when(good, F.get(p, F.lit(0))), "agency": F.when(good, F.get(p, F.lit(1))), "norm_id": F.when(good, F.get(p, F.lit(2))),
        "variant": F.when(good, F.nullif(variant, F.lit(""))), "year": F.when(good, F.try_element_at(years, F.lit(-1)).cast("int")), "error": error.cast("string"),
    })
