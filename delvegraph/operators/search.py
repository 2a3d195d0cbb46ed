"""Pattern search over text lines, with enclosing symbols, context and a sound prefilter."""

from __future__ import annotations

import functools
import re
from re import _constants as op
from re import _parser as parser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class UnsafePattern(ValueError):
    """The pattern may take exponential time or means different things to different engines."""


_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def _prefix(item) -> str | None:
    """The literal that an alternative begins with; None if it begins with something else."""
    out = ""
    for what, value in item:
        if what is not op.LITERAL:
            break
        out += chr(value)
    return out or None


def _parts(what, value) -> list:
    """What an element of a pattern holds."""
    if what in _REPEATS:
        return [value[2]]
    if what is op.SUBPATTERN:
        return [value[3]]
    if what is op.ATOMIC_GROUP:
        return [value]
    return list(value[1]) if what is op.BRANCH else []


def _check(items, repeated: bool) -> None:
    for what, value in items:
        if what in (op.GROUPREF, op.GROUPREF_EXISTS, op.ASSERT, op.ASSERT_NOT):
            raise UnsafePattern("back references and look-around are not portable")
        open_ended = what in _REPEATS and value[1] is op.MAXREPEAT
        if open_ended and repeated:
            raise UnsafePattern("a repeated group holds a repeat")
        if what is op.BRANCH and repeated:
            heads = [_prefix(alt) for alt in value[1]]
            if None in heads or any(a != b and b.startswith(a) or heads.count(a) > 1 for a in heads for b in heads):
                raise UnsafePattern("a repeated group holds alternatives that may match alike")
        for part in _parts(what, value):
            _check(part, repeated or open_ended)


def check_pattern(pattern: str) -> None:
    """Refuse nested unbounded repeats, ambiguous alternatives inside one, back references and look-around."""
    try:
        re.compile(pattern)
        parsed = parser.parse(pattern)
    except (re.error, OverflowError) as e:
        raise UnsafePattern(str(e)) from None
    _check(parsed, False)


def required_literals(pattern: str, least: int = 3) -> list[list[str]]:
    """Sets of literals: every match holds one of each set.

    Read off the parsed pattern, so escapes, classes and repeats mean what they mean;
    none where flags or escapes that engines read differently leave it open.
    """
    if re.search(r"\\[0-9QEpPhHRXGzZ]|\\c", pattern):
        return []
    try:
        parsed = parser.parse(pattern)
    except re.error:
        return []
    if parsed.state.flags & ~re.UNICODE.value:
        return []

    def walk(items) -> list[list[str]]:
        out: list[list[str]] = []
        run = ""

        def flush() -> None:
            nonlocal run
            if len(run) >= least:
                out.append([run])
            run = ""

        for what, value in items:
            if what is op.LITERAL:
                run += chr(value)
                continue
            if what is op.AT:
                continue
            flush()
            if what in _REPEATS and value[0] >= 1:
                out += walk(value[2])
            elif what is op.SUBPATTERN and not value[1] and not value[2]:
                out += walk(value[3])
            elif what is op.ATOMIC_GROUP:
                out += walk(value)
            elif what is op.BRANCH:
                sides = [walk(alt) for alt in value[1]]
                if all(sides):  # of each alternative its most telling set
                    out.append(sorted({lit for side in sides for lit in max(side, key=lambda s: min(map(len, s)))}))
        flush()
        return out

    return walk(parsed)


def lines_of(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line, body): lines of each text from 1."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("p", "body")).select("id", (F.col("p") + 1).alias("line"), "body")


def grep(docs: DataFrame, pattern: str, regex: bool = True, prefilter: bool = True, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line, body) of matching lines.  The prefilter drops whole texts that lack the
    literals every match needs, before they are split; it never changes the result."""
    if regex:
        check_pattern(pattern)
    source = docs
    if prefilter:
        for some in required_literals(pattern) if regex else [[pattern]]:
            source = source.filter(functools.reduce(lambda a, b: a | b, (F.col(text_col).contains(lit) for lit in some)))
    found = lines_of(source, id_col, text_col)
    return found.filter(F.col("body").rlike(pattern) if regex else F.col("body").contains(pattern))


def with_context(docs: DataFrame, hits: DataFrame, before: int, after: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Hits plus (id, line, body, context): lines within ``before``/``after`` of a hit."""
    near = hits.select("id", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"), (F.col("line")).alias("hit")).withColumn("is_hit", F.col("line") == F.col("hit"))
    wanted = near.groupBy("id", "line").agg(F.max("is_hit").alias("is_hit"))
    every = lines_of(docs.join(hits.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi"), id_col, text_col)
    return every.join(wanted, ["id", "line"]).select("id", "line", "body", (~F.col("is_hit")).alias("context"))


def ranked_hits(hits: DataFrame, tiers: DataFrame, limit: int) -> DataFrame:
    """The first hits by (tier, path, line), with the total disclosed."""
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(Window.orderBy("tier", "id", "line"))
    top = hits.join(tiers, "id").orderBy("tier", "id", "line").limit(limit)
    return top.withColumn("place", nth).crossJoin(F.broadcast(total))
