"""Scalar expressions: parsing of settings, names and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def device_ordinal(text: Column) -> Column:
    """-1 for `cpu`, the number of `cuda` or `cuda:N`; null for anything else."""
    s = F.lower(F.trim(text))
    return F.when(s == "cpu", -1).when(s == "cuda", 0).when(s.rlike("^cuda:[0-9]{1,9}$"), F.regexp_extract(s, "^cuda:([0-9]+)$", 1).cast("int"))


def duration_ms(text: Column) -> Column:
    """`500ms`, `15s`, `2m` in milliseconds; null for anything else."""
    n = F.regexp_extract(text, "^([0-9]+)(ms|s|m)$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, "^([0-9]+)(ms|s|m)$", 2)
    return F.when(unit == "ms", n).when(unit == "s", n * 1000).when(unit == "m", n * 60000)


def strip_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def enum_of(text: Column, names: tuple[str, ...]) -> Column:
    """The name in upper case, null if it is none of them."""
    s = F.upper(F.trim(text))
    return F.when(s.isin(*names), s)


def format_number(x: Column, digits: int = 1) -> Column:
    """A dash where there is no finite number."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "-").otherwise(F.format_string(f"%.{digits}f", x))


def format_bytes(x: Column) -> Column:
    """Whole KiB, or MiB with one digit from one MiB on; a dash where there is no finite number."""
    mib = F.concat(format_number(x / (1 << 20), 1), F.lit(" MiB"))
    kib = F.concat(format_number(x / 1024, 0), F.lit(" KiB"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "-").when(x >= 1 << 20, mib).otherwise(kib)


def label(name: Column) -> Column:
    """Display names of targets.  Fixed values of the report format."""
    return F.when(name == "tei", "TEI").when(name == "infinity", "Infinity").otherwise(name)


def bearer_digest(header: Column) -> Column:
    """SHA-256 of the key behind a `Bearer` scheme in any case; null without it."""
    return F.when(F.lower(F.substring(header, 1, 7)) == "bearer ", F.sha2(F.trim(F.substring(header, F.lit(8), F.char_length(header))), 256))


def token_limit(sentence_limit: Column, tokenizer_limit: Column, positions: Column, model_type: Column, pad_id: Column) -> Column:
    """The first that is given: the sentence limit, a sane tokenizer limit, positions (less padding and one for models that count from it)."""
    from_pad = model_type.isin("roberta", "xlm-roberta", "camembert")
    return F.coalesce(
        sentence_limit,
        F.when((tokenizer_limit > 0) & (tokenizer_limit < 1e6), tokenizer_limit.cast("int")),
        F.when(from_pad, positions - pad_id - 1).otherwise(positions),
    )


def micros(nanos: Column) -> Column:
    """Microseconds, ten minutes at most."""
    return F.least(F.floor(nanos / 1000), F.lit(600_000_000)).cast("long")
