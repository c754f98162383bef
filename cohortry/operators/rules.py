"""All rules of many tables as one plan: every table is scanned once, and one aggregation follows.

A row gives entries: one for each row rule that it breaks, one for each of its unique keys, one for each of its links, and one
for each link that may point at it. All entries are counted by key in one aggregation with map-side partial counts, so a hot
key or a hot link is a single row of every task, and only broken rows, distinct keys and distinct links are shuffled.
Uniqueness asks for one entry a key; a link asks for a parent among its entries. An entry is flat: the number of its rule
(``slot``), and its key with whole numbers as numbers; names and texts are made of what is reported only. Where the row's key is
a unique key of the table, the entry of that key also counts the row rules that always say the same.

Results: ``table_name, rule, key, detail, n_rows``. Row rules: the row's key, what is wrong, and the rows with both. ``unique``:
the repeated key and its rows. Links: the link's value (not the child's key), ``no parent`` or ``unsuitable parent``, and the
child rows that have it; ``checks.check_orphans`` lists the children themselves. NULL: an unknown condition is no violation; a
key with NULL is a key like any other; a link with a NULL part is no link. Repeated rows are counted. Empty tables give no
rows, so children of an empty table are all without parent. Columns that no rule names are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import vocab
from cohortry.operators import checks

#: What a slot collects: broken rows, the values of a unique key, or a link's children and parents.
_ROWS, _KEYS, _LINKS = range(3)
#: What an entry is: a row that counts, or a parent that a link's target refuses or takes.
_COUNTED, _PARENT, _SUITABLE = range(3)


@dataclass(frozen=True)
class RowRule:
    """A rule that a row breaks on its own. Each of its ``details`` is one thing that is wrong with a row: a column of texts, NULL
    where nothing is, or a condition and the text that is said where it is TRUE."""

    rule: str
    details: Callable[[DataFrame], Sequence[Column | tuple[Column, str]]]


@dataclass(frozen=True)
class Unique:
    """The columns identify a row of the table."""

    columns: Sequence[str]
    rule: str = "unique"


@dataclass(frozen=True)
class Link:
    """The columns hold the ``parent_columns`` of a row of table ``parent`` (which may be the table itself); if ``target`` is
    given, of one that meets this SQL condition."""

    columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]
    target: str | None = None
    rule: str = "orphan"


@dataclass(frozen=True)
class RuledTable:
    rows: DataFrame
    key: str | Sequence[str]
    rules: Sequence[RowRule | Unique | Link] = field(default_factory=tuple)


def vocabulary(allowed: Mapping[str, Sequence]) -> RowRule:
    return RowRule("vocabulary", lambda df: checks.vocabulary_columns(allowed))


def range_order(low: str, high: str) -> RowRule:
    return RowRule("range_order", lambda df: [(F.col(low) > F.col(high), f"{low} > {high}")])


def bounds(limits: Mapping[str, tuple]) -> RowRule:
    return RowRule("bounds", lambda df: checks.bounds_broken(df, limits))


def status_payload() -> RowRule:
    return RowRule("status_payload", lambda df: [checks.status_payload_detail()])


def scope(expected: Mapping[str, str]) -> RowRule:
    return RowRule("scope", lambda df: [F.nullif(checks.scope_detail(expected), F.lit(""))])


def id_pattern(patterns: Mapping[str, str]) -> RowRule:
    return RowRule("id_pattern", lambda df: [F.nullif(checks.pattern_detail(patterns), F.lit(""))])


def pair_distinct(a: str, b: str) -> RowRule:
    return RowRule("pair_distinct", lambda df: [F.when(F.col(a) == F.col(b), F.col(a))])


def variant_metadata(type_column: str, metadata: str, requirements: Mapping[str, Sequence[str]] = vocab.VARIANT_REQUIREMENTS) -> RowRule:
    return RowRule("variant_metadata", lambda df: checks.metadata_lacking(type_column, metadata, requirements))


def condition(rule: str, broken: str, detail: str) -> RowRule:
    """Any rule of one row: an SQL condition that is TRUE where it is broken, and what to say then."""
    return RowRule(rule, lambda df: [(F.expr(broken), detail)])


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _comparable(df: DataFrame, columns: Sequence[str]) -> list:
    """The columns' types, with whole numbers as one type; keys are compared as texts, so these must agree."""
    types = [df.schema[c].dataType for c in columns]
    return [T.LongType() if isinstance(t, T.IntegralType) else t for t in types]


class _Slots:
    """The numbers of the rules, and the columns that hold a part of a key: a number (``n0``) or a text (``s0``)."""

    def __init__(self, tables: Mapping[str, RuledTable]) -> None:
        self.known: list[tuple[str, str, int]] = []
        self.columns: set[str] = set()
        self.counted: dict[tuple[str, str, int], list[tuple[str, str]]] = {}
        for name, table in tables.items():
            own = next((r for r in table.rules if isinstance(r, Unique) and list(r.columns) == _names(table.key)), None)
            if own is not None:
                self.counted[name, own.rule, _KEYS] = self._fixed(table)
            for r in table.rules:
                sort = _ROWS if isinstance(r, RowRule) else _KEYS if isinstance(r, Unique) else _LINKS
                if (name, r.rule, sort) not in self.known:
                    self.known.append((name, r.rule, sort))
                self.columns.update(self.parts(table.rows, table.key if sort == _ROWS else r.columns))
        self.width = 1 + max((int(c[1:]) for c in self.columns), default=-1)
        self.counters = max(map(len, self.counted.values()), default=0)

    @staticmethod
    def _fixed(table: RuledTable) -> list[tuple[str, str]]:
        """The rules and texts of a table that one condition gives, and no other detail of a rule of that name can."""
        found = [(r.rule, d) for r in table.rules if isinstance(r, RowRule) for d in r.details(table.rows)]
        open_rules = {rule for rule, d in found if isinstance(d, Column)}
        pairs = Counter((rule, d[1]) for rule, d in found if rule not in open_rules)
        return [pair for pair, n in pairs.items() if n == 1]

    @staticmethod
    def parts(df: DataFrame, columns: str | Sequence[str]) -> dict[str, Column]:
        """The parts of a key, each with the column that holds it."""
        numbers = [isinstance(df.schema[c].dataType, T.IntegralType) for c in _names(columns)]
        return {f"{'n' if number else 's'}{k}": F.col(c).cast("long" if number else "string")
                for k, (c, number) in enumerate(zip(_names(columns), numbers))}

    def entry(self, slot: tuple[str, str, int], df: DataFrame, columns: str | Sequence[str], kind: int | Column = _COUNTED,
              detail: Column | None = None, conditions: Mapping[tuple[str, str], Column] | None = None) -> Column:
        """An entry of a row, as a struct of the same type for all rules; of a key, with what it counts beside."""
        parts = self.parts(df, columns)
        empty = {c: F.lit(None).cast("long" if c[0] == "n" else "string") for c in self.columns}
        kind = F.lit(kind) if isinstance(kind, int) else kind
        detail = F.lit(None) if detail is None else detail
        flags = [conditions[pair] for pair in self.counted.get(slot, [])] if conditions else []
        flags += [F.lit(False)] * (self.counters - len(flags))
        return F.struct(F.lit(self.known.index(slot)).alias("slot"), kind.cast("int").alias("kind"),
                        *[parts.get(c, empty[c]).alias(c) for c in sorted(self.columns)], detail.cast("string").alias("detail"),
                        *[f.alias(f"b{k}") for k, f in enumerate(flags)])

    def named(self, position: int) -> Column:
        """The table, the rule or the sort of the slot of a row."""
        return F.array(*[F.lit(k[position]) for k in self.known])[F.col("slot")]

    def beside(self, counter: int, position: int) -> Column:
        """The rule or the text of a counter of the slot of a row."""
        pairs = [self.counted.get(k, [])[counter:counter + 1] for k in self.known]
        return F.array(*[F.lit(p[0][position] if p else None).cast("string") for p in pairs])[F.col("slot")]

    def key(self) -> Column:
        """The key as one text."""
        held = [[F.col(c).cast("string") for c in (f"n{k}", f"s{k}") if c in self.columns] for k in range(self.width)]
        return F.concat_ws("|", *[F.coalesce(*h) for h in held])


def _entries(name: str, table: RuledTable, tables: Mapping[str, RuledTable], slots: _Slots) -> DataFrame | None:
    """The entries of every row of one table, from one scan."""
    df, made = table.rows, []

    def whole(columns: Sequence[str], entry: Column) -> Column:
        return F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), entry)

    counted = {pair for slot, pairs in slots.counted.items() if slot[0] == name for pair in pairs}
    conditions: dict[tuple[str, str], Column] = {}
    for r in table.rules:
        for d in r.details(df) if isinstance(r, RowRule) else ():
            if isinstance(d, tuple) and (r.rule, d[1]) in counted:
                conditions[r.rule, d[1]] = d[0]
            else:
                broken, detail = d if isinstance(d, tuple) else (d.isNotNull(), d)
                detail = F.lit(detail) if isinstance(detail, str) else detail
                made.append(F.when(broken, slots.entry((name, r.rule, _ROWS), df, table.key, detail=detail)))
    for r in table.rules:
        if isinstance(r, RowRule):
            continue
        if isinstance(r, Unique):
            made.append(slots.entry((name, r.rule, _KEYS), df, r.columns, conditions=conditions))
        else:
            if _comparable(df, r.columns) != _comparable(tables[r.parent].rows, r.parent_columns):
                raise ValueError(f"{name}.{r.columns} and {r.parent}.{r.parent_columns} have different types")
            made.append(whole(r.columns, slots.entry((name, r.rule, _LINKS), df, r.columns)))
    for child, other in tables.items():
        for r in other.rules:
            if isinstance(r, Link) and r.parent == name:
                kind = F.when(F.expr(r.target), _SUITABLE).otherwise(_PARENT) if r.target else _SUITABLE
                made.append(whole(r.parent_columns, slots.entry((child, r.rule, _LINKS), df, r.parent_columns, kind)))
    # one array of plain structs: compiled, which arrays made by lambdas are not
    return df.select(F.explode(F.array(*made)).alias("e")).select("e.*").where("slot IS NOT NULL") if made else None


def violations(tables: Mapping[str, RuledTable]) -> DataFrame:
    """Every violation of every rule: ``table_name, rule, key, detail, n_rows``. The names of a table's links must differ."""
    for name, table in tables.items():
        names = [r.rule for r in table.rules if not isinstance(r, RowRule)]
        if len(set(names)) < len(names):
            raise ValueError(f"keys and links of {name} need different names: {names}")
    slots = _Slots(tables)
    parts = [e for e in (_entries(name, table, tables, slots) for name, table in tables.items()) if e is not None]
    if not parts:
        raise ValueError("no rules")
    # when partial counts outgrow a task's memory Spark sorts them by the grouping columns, and their first one is what it compares
    # without opening the rows: a part of the key, of which there are many, not the few slots
    counted = reduce(DataFrame.union, parts).groupBy(*sorted(slots.columns), "slot", "detail").agg(
        F.count_if(F.col("kind") == _COUNTED).alias("n"), F.max("kind").alias("best"),
        *[F.count_if(f"b{k}").alias(f"b{k}") for k in range(slots.counters)])
    sort, n, best = slots.named(2), F.col("n"), F.col("best")
    detail = (
        F.when(sort == _ROWS, F.col("detail"))
        .when((sort == _KEYS) & (n > 1), n.cast("string"))
        .when((sort == _LINKS) & (n > 0) & (best < _SUITABLE), F.when(best < _PARENT, "no parent").otherwise("unsuitable parent"))
    )

    def found(rule: Column, said: Column, rows: Column) -> Column:
        return F.when(said.isNotNull() & (rows > 0), F.struct(rule.alias("rule"), said.alias("detail"), rows.alias("n_rows")))

    violated = [found(slots.named(1), detail, n)]
    violated += [found(slots.beside(k, 0), slots.beside(k, 1), F.col(f"b{k}")) for k in range(slots.counters)]
    some = reduce(Column.__or__, [detail.isNotNull(), *[F.col(f"b{k}") > 0 for k in range(slots.counters)]])
    listed = counted.where(some).select(slots.named(0).alias("table_name"), slots.key().alias("key"), F.explode(F.array(*violated)).alias("v"))
    return listed.where("v IS NOT NULL").select("table_name", "v.rule", "key", "v.detail", "v.n_rows")
