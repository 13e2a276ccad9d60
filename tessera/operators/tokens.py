"""Lexical tokens, truncation and word-aligned windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Special tokens before and behind a sequence of the lexical stand-in.
LEAD, TRAIL = 1, 1
WORD = r"[^ \t\n\r\f]+"
PIECE = 4


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def with_specials(n_words: Column) -> Column:
    return n_words + (LEAD + TRAIL)


def truncated(length: Column, limit: int) -> tuple[Column, Column]:
    """Length that is kept, specials included, and whether anything was cut."""
    return F.least(length, F.lit(limit)), length > limit


def first_truncated(requests: DataFrame, request: str, index: str, flag: str) -> DataFrame:
    """(request, first_truncated): the lowest index of a truncated input, -1 if there is none."""
    return requests.groupBy(request).agg(F.coalesce(F.min(F.when(F.col(flag), F.col(index))), F.lit(-1)).alias("first_truncated"))


def word_ids(text: Column, piece: int = PIECE) -> Column:
    """Words cut into pieces of so many characters: every piece's word number, -1 for the specials around them."""
    inner = F.flatten(F.transform(words(text), lambda w, i: F.array_repeat(i, F.ceil(F.char_length(w) / piece).cast("int"))))
    return F.concat(F.array(F.lit(-1)), inner, F.array(F.lit(-1)))


def windows(ids: Column, limit: int, lead: int = LEAD, trail: int = TRAIL) -> Column:
    """Ranges (from, to, length, wrap, weight) of a sequence: whole where it fits, else windows ending where a word starts.

    A window takes the most text tokens that fit; it ends at the last word start in reach, or is cut hard where there is none.
    Specials are added to each window again and do not count in its weight.
    """
    room = limit - lead - trail
    if room < 1:
        raise ValueError("no room for text between the special tokens")
    n = F.size(ids)
    end = n - trail
    span = lambda a, b, length, wrap, weight: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"), length.cast("int").alias("length"), wrap.alias("wrap"), weight.cast("int").alias("weight"))
    whole = F.array(span(F.lit(0), n, n, F.lit(False), n))

    def stop(start: Column) -> Column:
        far = start + room
        # where the word number changes, looking back from the far end
        start_of_word = F.array_max(F.filter(F.sequence(start + 1, far), lambda s: ids[s] != ids[s - 1]))
        return F.when(far >= end, end).otherwise(F.coalesce(start_of_word, far))

    state = F.struct(F.lit(lead).alias("at"), F.array().cast("array<struct<from:int,to:int,length:int,wrap:boolean,weight:int>>").alias("out"))
    # two windows in a row are longer than the room: the first ends where the next word would not have fitted
    steps = F.sequence(F.lit(1), 2 * F.ceil(n / room).cast("int") + 2)

    def step(acc: Column) -> Column:
        # one evaluation of the stop for all of its uses
        return F.get(
            F.transform(
                F.array(stop(acc["at"]).cast("int")),
                lambda b: F.struct(b.alias("at"), F.array_append(acc["out"], span(acc["at"], b, b - acc["at"] + (lead + trail), F.lit(True), b - acc["at"])).alias("out")),
            ),
            F.lit(0),
        )

    split = F.aggregate(steps, state, lambda acc, _: F.when(acc["at"] >= end, acc).otherwise(step(acc)), lambda acc: acc["out"])
    return F.when(n <= limit, whole).otherwise(split)


def row(ids: Column, start: Column, stop: Column, prefix: Column, suffix: Column, pad: int, length: int) -> Column:
    """A model's input row: prefix, tokens of [start, stop), suffix, padding."""
    own = F.concat(prefix, F.slice(ids, start + 1, stop - start), suffix)
    return F.concat(own, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(own))))


def mask(n: Column, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - n)))
