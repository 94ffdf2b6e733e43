"""Column helpers for text predicates. Everything stays inside JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASENAME = r"[^\\/]+(?=[\\/]*$)"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def sql_text(text: str) -> str:
    """A text as a literal in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts: Iterable[str]) -> Column:
    """An array of fixed texts, handed over as one expression: a call for each text would cost more than the query."""
    return F.expr("array(" + ", ".join(sql_text(t) for t in texts) + ")")


def contains_any(text: Column, tokens: Iterable[str]) -> Column:
    """True when the text holds at least one token as a plain substring."""
    return F.exists(literals(tokens), lambda t: F.contains(text, t))


def contains_all(text: Column, tokens: Iterable[str]) -> Column:
    return all_of(text.contains(t) for t in tokens)


def icontains(text: Column, token: str) -> Column:
    return F.lower(text).contains(token.lower())


def hits(text: Column, tokens: Sequence[str]) -> Column:
    """The tokens found in the text, in list order."""
    return F.filter(literals(tokens), lambda t: F.contains(text, t))


def first_hit(text: Column, tokens: Sequence[str]) -> Column:
    """The first token of the list found in the text, or null."""
    return F.get(hits(text, tokens), F.lit(0))


def first_match(cases: Sequence[tuple[Column, object]]) -> Column:
    """Value of the first condition that holds, or null."""
    return F.coalesce(*[F.when(cond, F.lit(v) if not isinstance(v, Column) else v) for cond, v in cases])


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def basename(path: Column) -> Column:
    """Last piece after either slash; the path itself when there is none."""
    piece = F.regexp_extract(path, BASENAME, 0)
    return F.when(piece != "", piece).otherwise(path)


def extension(name: Column) -> Column:
    """Lower-case text behind the last dot of the last '/'-piece, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./\s]+)/*$", 1))


def rot13(text: Column) -> Column:
    lower = "abcdefghijklmnopqrstuvwxyz"
    turned = lower[13:] + lower[:13]
    return F.translate(text, lower + lower.upper(), turned + turned.upper())


def human_bytes(n: Column) -> Column:
    """1024 steps with one decimal; plain count below one KB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / float(1024**power), 1))).otherwise(out)
    return out


def fixed(x: Column, digits: int) -> Column:
    """A number from 0 with so many decimals (1 or 2), rounded like C's printf: by its exact binary value, ties to even.

    format_string rounds the shortest decimal instead, and its ties up. The fraction is a whole number of 2**-59 for
    any double from 1/128 on, so each step is exact in 64 bits; smaller ones are cut to that.
    """
    n = F.floor(x)
    rest = ((x - n) * float(1 << 59)).cast("bigint")
    for _ in range(digits):
        rest = rest * 10
        n, rest = n * 10 + F.shiftright(rest, 59), rest.bitwiseAND((1 << 59) - 1)
    half = F.lit(1 << 58)
    n = n + F.when((rest > half) | ((rest == half) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def human_duration(seconds: Column) -> Column:
    s = seconds.try_cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%dh %dm", h, m))
    )


def mask_labels(mask: Column, table: Sequence[tuple[int, str]]) -> Column:
    """Names of the set bits, in table order."""
    m = mask.try_cast("long")
    named = [F.when(m.bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(name)) for bit, name in table]
    return F.array_compact(F.array(*named))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.cast("long").bitwiseAND(F.lit(bit).cast("long")) != 0


def code_label(code: Column, table: dict, default: Column | None = None) -> Column:
    """Label of a code from a small fixed table."""
    label = lookup(code, table)
    return label if default is None else F.coalesce(label, default)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lookup(key: Column, table: dict) -> Column:
    """What a small fixed table of texts or whole numbers has for a key, null where it has nothing."""
    items = [sql_text(x) if isinstance(x, str) else str(x) for pair in table.items() for x in pair]
    return F.element_at(F.expr("map(" + ", ".join(items) + ")"), key)
