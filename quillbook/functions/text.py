"""Small text forms: clock times, run names, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_ns(text: Column) -> Column:
    """``HH:MM:SS`` as nanoseconds since midnight; null unless it has that form."""
    part = F.split(text, ":")
    seconds = part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")
    return F.when(text.rlike(r"^\d{2}:[0-5]\d:[0-5]\d$"), seconds * 1_000_000_000)


def variant_id(**fields: Column) -> Column:
    """``name=value`` parts joined by two underscores, in the order given."""
    return F.concat_ws("__", *[F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items()])


def variant_fields(variant: Column) -> Column:
    """The parts of ``variant_id`` as a map."""
    return F.str_to_map(variant, F.lit("__"), F.lit("="))


def method_of(run_file: Column) -> Column:
    """``permsg`` for files of per-message samples that lie beside batch ones, else ``batch``."""
    return F.when(run_file.contains("_permsg"), "permsg").otherwise("batch")


def price_text(price: Column) -> Column:
    """A price of four implied decimals, for display."""
    return (price.cast("decimal(20,0)") / F.lit(10_000).cast("decimal(20,0)")).cast("decimal(20,4)").cast("string")


def rotation(variants: list[str], run: int) -> list[str]:
    """The order in which a run takes its variants: each run begins one further on."""
    at = run % len(variants) if variants else 0
    return variants[at:] + variants[:at]
