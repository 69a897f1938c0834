"""Positions of pattern matches in whole texts, with SQL functions only.

``regexp_extract_all`` gives the matches and ``split`` the stretches between
them; their lengths in code points add up to positions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: one span: first code point, number of the kind (its place among the kinds), end (exclusive), text
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, pattern: str, kind: int, needs: tuple[str, ...] = ()) -> Column:
    """All leftmost non-overlapping matches of a Java pattern (never an empty match), as SPAN.

    ``needs``: strings of which every match holds one; a text without any is not searched.
    """
    none = F.expr(f"cast(array() as {SPAN})")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["m"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def walk(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        return F.when(F.size(matches) == 0, none).otherwise(F.aggregate(
            F.arrays_zip(between.alias("b"), matches.alias("m")),
            F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"]))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)
    if not needs:
        return found
    worth = F.lit(False)
    for part in needs:
        worth = worth | F.contains(text, F.lit(part))
    return F.when(worth, found).otherwise(none)


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def joined(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """``kind:start:end`` of every span, comma-joined; sorted by kind then start, or by start then kind."""
    keys = ("kind", "start") if by_kind else ("start", "kind")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s[keys[0]].alias("x"), s[keys[1]].alias("y"), s["end"].alias("end"))))
    kind, start = ("x", "y") if by_kind else ("y", "x")
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s[kind]), s[start].cast("string"), s["end"].cast("string"))))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every stretch covered by spans replaced by one ``mark`` per stretch."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(state: Column, s: Column) -> Column:
        clear = s["start"] >= state["at"]
        kept = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.concat(state["out"], kept, F.when(clear, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        ordered, first, step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))
