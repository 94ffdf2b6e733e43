"""Row rules of one table as columns of one scan.

Most detections look at one row at a time: they filter a table, compute columns, and name a finding. Run one by one and
united, each of them reads its table again. Here the same functions run on a stand-in for the table. A filter becomes a
flag column, computed columns are computed where the flag holds, and the finding becomes a column that is null for rows
that are none. So any number of rules is one projection of the table, and the findings are exploded from it. The first
filters of all rules, joined by OR, stay a real filter, so that it still reaches the files.

A rule that does more than that (groups, joins, explodes) says so when it asks the stand-in for it, and runs as a plan
of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BASE = "__base_"


class NotARowRule(AttributeError):
    """A rule asked for something that needs more than one row."""


class RowTable:
    """A table as a row rule sees it. Without a DataFrame it only notes the filters a rule begins with."""

    def __init__(self, table: str, columns: list[str], df: DataFrame | None = None, hidden: tuple[str, ...] = (), flags: tuple[str, ...] = (), guard: Column | None = None, fresh: bool = True):
        self.table, self.columns, self.df, self.hidden, self.flags, self.guard, self.fresh = table, columns, df, hidden, flags, guard, fresh

    def _next(self, columns: list[str], df: DataFrame | None, fresh: bool = False) -> RowTable:
        return RowTable(self.table, columns, df, self.hidden, self.flags, self.guard, fresh)

    def _where(self, value: Column) -> Column:
        return F.when(F.col(self.flags[-1]), value) if self.flags else value

    def filter(self, condition: str | Column) -> RowTable:
        condition = F.expr(condition) if isinstance(condition, str) else condition
        out = self._next(self.columns, self.df, self.fresh)
        if self.fresh:
            out.guard = condition if self.guard is None else self.guard & condition
        if self.df is not None:
            holds = F.coalesce(condition, F.lit(False))
            flag = f"__on_{len(self.flags)}"
            out.df = self.df.withColumn(flag, F.col(self.flags[-1]) & holds if self.flags else holds)
            out.flags = (*self.flags, flag)
        return out

    where = filter

    def computed(self, cols: dict[str, Column]) -> RowTable:
        df = self.df.withColumns({n: self._where(c) for n, c in cols.items()}) if self.df is not None else None
        return self._next([*self.columns, *[c for c in cols if c not in self.columns]], df)

    def withColumns(self, cols: dict[str, Column]) -> RowTable:
        return self.computed(cols)

    def withColumn(self, name: str, value: Column) -> RowTable:
        return self.computed({name: value})

    def withColumnRenamed(self, old: str, new: str) -> RowTable:
        df = self.df.withColumnRenamed(old, new) if self.df is not None else None
        return self._next([new if c == old else c for c in self.columns], df)

    def select(self, *cols) -> RowTable:
        cols = [c for x in cols for c in (x if isinstance(x, list) else [x])]
        if self.df is None:
            return self._next(self.columns, None)
        others = [*self.hidden, *self.flags]
        df = self.df.select(*others, *[x for c in cols for x in (self.columns if isinstance(c, str) and c == "*" else [c])])
        return self._next(df.columns[len(others) :], df)

    def drop(self, *names: str) -> RowTable:
        return self._next([c for c in self.columns if c not in names], self.df.drop(*names) if self.df is not None else None)

    def finding(self, fields: list[Column]) -> RowFinding:
        """What `findings` returns here: the row's finding, or null."""
        if self.df is None:
            return RowFinding(self, None)
        found = F.struct(*fields)
        is_one = found.getField("severity").isNotNull()
        return RowFinding(self, F.when(F.col(self.flags[-1]) & is_one if self.flags else is_one, found))

    def __getattr__(self, name: str):
        raise NotARowRule(name)


class RowFinding:
    def __init__(self, rows: RowTable, found: Column | None):
        self.rows, self.found = rows, found


class _Tables:
    """What a rule is given in place of a case. A rule that names several findings is run once for each."""

    def __init__(self, case, columns: dict[str, list[str]], chains: dict[str, tuple[DataFrame, tuple[str, ...]]] | None = None):
        self.case, self.columns, self.chains = case, columns, chains

    def supplied(self, name: str) -> bool:
        return self.case.supplied(name)

    def __getitem__(self, name: str) -> RowTable:
        if name not in self.columns:
            self.columns[name] = self.case[name].columns
        columns = self.columns[name]
        if self.chains is None:
            return RowTable(name, columns)
        chain, hidden = self.chains[name]
        return RowTable(name, columns, chain.withColumns({c: F.col(_BASE + c) for c in columns}), hidden)


#: The findings of the rule that is running, in the order in which it names them.
_NAMED: list[RowFinding] | None = None


def named(found: RowFinding) -> RowFinding:
    if _NAMED is not None:
        _NAMED.append(found)
    return found


def _run(rule: Callable, tables: _Tables, params: dict) -> list[RowFinding]:
    global _NAMED
    _NAMED = []
    try:
        rule(tables, **params)
        return _NAMED
    finally:
        _NAMED = None


def row_findings(case, rules: dict[str, Callable], params: dict[str, dict] | None = None) -> tuple[list[DataFrame], list[str]]:
    """The findings of the row rules, one DataFrame for each table they read, and the names of the other rules.

    No job is run. `case` is a mapping of tables.
    """
    params, columns = params or {}, {}
    row_rules, others = {}, []
    guards: dict[str, list[Column | None]] = {}
    for name, rule in rules.items():
        try:
            found = _run(rule, _Tables(case, columns), params.get(name, {}))
        except NotARowRule:
            others.append(name)
            continue
        row_rules[name] = len(found)
        for f in found:
            guards.setdefault(f.rows.table, []).append(f.rows.guard)
    chains = {}
    for table, some in guards.items():
        df = case[table]
        if all(g is not None for g in some):
            df = df.filter(reduce(lambda a, b: a | b, some))
        hidden = tuple(_BASE + c for c in columns[table])
        chains[table] = df.select(*[F.col(c).alias(_BASE + c) for c in columns[table]]), hidden
    found_columns: dict[str, list[str]] = {t: [] for t in chains}
    for name, count in row_rules.items():
        for i in range(count):
            # Each finding follows its own chain of columns, so that a rule's second finding doesn't hide its first.
            f = _run(rules[name], _Tables(case, columns, chains), params.get(name, {}))[i]
            table, hidden = f.rows.table, f.rows.hidden
            column = f"__found_{len(found_columns[table])}"
            chains[table] = f.rows.df.select(*hidden, f.found.alias(column)), (*hidden, column)
            found_columns[table].append(column)
    each = []
    for table, (chain, _) in chains.items():
        all_found = F.array_compact(F.array(*[F.col(c) for c in found_columns[table]]))
        each.append(chain.select(F.explode(all_found).alias("f")).select("f.*"))
    return each, others


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """All parts united in pairs, so that building the plan costs n log n and not n squared."""
    parts = list(parts)
    while len(parts) > 1:
        parts = list(_pairs(parts))
    return parts[0]


def _pairs(parts: list[DataFrame]) -> Iterator[DataFrame]:
    for i in range(0, len(parts) - 1, 2):
        yield parts[i].unionByName(parts[i + 1])
    if len(parts) % 2:
        yield parts[-1]
