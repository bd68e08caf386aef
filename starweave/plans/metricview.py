"""Metric views: measures over a star or snowflake, evaluated at any grain as one lazy DataFrame.

``MetricView.query(dims, measures, where)`` compiles each measure to leaf aggregates and an expression over them. All
leaves of one filter context share one aggregation of one scan: a filtered measure is a conditional aggregate. Other contexts
(totals that ignore a filter, other periods, another relationship) are joined on the dimensions that they keep. Contexts over the same
rows are derived from one aggregate at the finest grain that they need, whose exchange Spark reuses; distinct counts too, their
values are among its keys. Only the dimension tables that the query touches are joined: relationships are
many-to-one left joins on a unique key, so leaving one out changes no row.

Every leaf has a home, the table whose rows it aggregates. A leaf of another table than the view's own is aggregated over that table, at
its own grain, under the dimensions and filters that reach it (many-to-one from there); those that don't, leave it alone. The
results of several homes are stitched together on the dimensions that they share, so one query may have measures of several facts.

Time functions change the set of visible days, as they do in the language: the calendar's days are grouped by the date dimensions
of the query and moved, widened or cut; facts, aggregated by day, then join these days. The sets are of the calendar's
size, whatever the facts' number. Filters on the date table choose the visible days, and never the facts of other periods.
Where all days up to the last visible one count (to date, or FILTER over ALL with MAX), running sums take the place of that join: a
distinct count counts each value on its first day.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from starweave.functions.scalar import FUNCTIONS, switch
from starweave.model import Relationship, SemanticModel, Table, identifier
from starweave.operators.scoring import settled
from starweave.operators.timeintel import in_parts
from starweave.plans.dax import Bin, Call, DaxError, Items, Lit, Neg, Ref, TableRef, parse, snake, walk

AGGREGATES: dict[str, Callable[[Column], Column]] = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "COUNTA": F.count}
ITERATORS = {"SUMX": F.sum, "AVERAGEX": F.avg, "MINX": F.min, "MAXX": F.max, "COUNTX": F.count}
COUNTS = {"COUNT", "COUNTA", "COUNTX", "COUNTROWS"}
ADDITIVE = {"SUM", "SUMX", "COUNTBLANK", *COUNTS}
#: How partial results of a leaf are put together; other leaves need the rows.
MERGE: dict[str, Callable[[Column], Column]] = dict.fromkeys(ADDITIVE, F.sum) | {"MIN": F.min, "MINX": F.min, "FIRSTDATE": F.min, "MAX": F.max, "MAXX": F.max, "LASTDATE": F.max, "HASBLANK": F.max}
MERGE |= {k: (lambda c: F.coalesce(F.sum(c), F.lit(0))) for k in COUNTS}
DISTINCT = ("DISTINCTCOUNT", "DISTINCTCOUNTNOBLANK")
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
PERIODS = ("DAY", *MONTHS)
TO_DATE = {"YTD": "YEAR", "QTD": "QUARTER", "MTD": "MONTH"}
VIRTUAL = ("VALUES", "DISTINCT", "SUMMARIZE", "SUMMARIZECOLUMNS", "ADDCOLUMNS", "CROSSJOIN", "GENERATE", "FILTER", "TOPN")
REJECTED = {
    "SELECTEDVALUE": "depends on the consumer's selection", "HASONEVALUE": "depends on the consumer's selection", "ALLSELECTED": "depends on the consumer's selection",
    "ISFILTERED": "depends on the consumer's filters", "ISCROSSFILTERED": "depends on the consumer's filters", "EARLIER": "nested row context", "EARLIEST": "nested row context",
    "USERNAME": "row-level security is out of scope", "USERPRINCIPALNAME": "row-level security is out of scope", "CUSTOMDATA": "row-level security is out of scope",
    "SELECTEDMEASURE": "only inside a calculation item",
}


@dataclass(frozen=True)
class Context:
    """What a leaf is evaluated under, beyond the query's dimensions and filter."""

    filters: tuple = ()  # predicates, as trees
    semi: tuple = ()  # (column of the fact, table, column): restricted to keys that a table's rows hold
    removed: frozenset = frozenset()  # lower-case "table" or "table[column]" whose filters are ignored; "*" for all
    kept: frozenset | None = None  # ALLEXCEPT: all but these are ignored
    time: tuple = ()  # steps from the visible days to those that count, outermost first
    axis: tuple | None = None  # (table, column) of these days
    home: str | None = None  # lower-case name of the table whose rows are aggregated; None for the view's own
    cross: tuple = ()  # relationships that filters cross from the many side too
    far: tuple = ()  # predicates that reach the home only that way
    role: tuple | None = None  # (from table, from column, to table, to column) of the inactive relationship in use


@dataclass(frozen=True)
class Bound:
    """A column of the frame at hand."""

    name: str


@dataclass(frozen=True)
class Virtual:
    """A table expression over the values of columns."""

    keys: tuple = ()  # (table, column)
    filters: tuple = ()
    tops: tuple = ()  # (n, expression, ascending)
    names: tuple = ()  # (name, expression) of added columns


@dataclass(frozen=True)
class Shared:
    """An aggregate that several contexts are derived from."""

    frame: DataFrame
    names: dict  # of leaves, by what they aggregate
    dims: frozenset
    by_day: bool


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    column: str
    grain: str | None = None  # of dates: date, month, quarter or year


@dataclass
class Plan:
    leaves: dict = field(default_factory=dict)  # (signature, context) -> (alias, build, additive)

    def leaf(self, signature: object, context: Context, build: Callable, additive: bool, kind: str) -> str:
        key = (repr(signature), kind, context)
        if key not in self.leaves:
            self.leaves[key] = (f"_leaf{len(self.leaves)}", build, additive, context, kind)
        return self.leaves[key][0]


class MetricView:
    """A fact table of a model with the dimensions reachable from it and the measures defined over it."""

    def __init__(self, model: SemanticModel, fact: str, source: Callable[[Table], DataFrame], base_filter: str | None = None, join: str = "left", calculation_items: dict[str, str] | None = None, joins: dict[str, str] | None = None):
        """``join`` is the kind of all joins, ``joins`` that of single tables."""
        self.model, self.fact, self.source, self.join = model, model.table(fact), source, join
        self.joins = {k.lower(): v for k, v in (joins or {}).items()}
        if self.fact is None:
            raise DaxError(f"unknown table {fact}")
        self.base_filter = parse(base_filter) if base_filter else None
        self.extra: dict[str, str] = {}
        self.dimensions: dict[str, Dimension] = {}
        self.items = calculation_items or {}
        self.root, self.homes = self, {}
        self.stored: list = []  # aggregates of stored.py that queries may read
        self.in_parts_only = False
        self.measures_by_name = {k: m.expression for k, (_, m) in model.measures().items()}

    # --- definition

    def with_measure(self, name: str, expression: str) -> MetricView:
        self.measures_by_name[name.lower()] = expression
        return self

    def with_dimension(self, name: str, table: str, column: str, grain: str | None = None) -> MetricView:
        self.dimensions[name.lower()] = Dimension(name, table, column, grain)
        return self

    def with_stored(self, *stored) -> MetricView:
        """Queries that ``stored`` aggregates (``stored.opened``) cover don't read the facts."""
        self.stored = [*self.stored, *stored]
        self.homes = {}
        return self

    def dimension(self, name: str) -> Dimension:
        if (d := self.dimensions.get(name.lower())) is not None:
            return d
        found = [(t.name, c) for t in self.reachable() for c in t.columns if name.lower() in (c.name.lower(), snake(c.name), f"{t.name}[{c.name}]".lower())]
        if not found:
            raise DaxError(f"unknown dimension {name}")
        table, column = found[0]  # the first name wins, fact first
        return Dimension(name, table, column.name, "date" if (column.data_type or "") in ("date",) else None)

    # --- homes

    def at(self, home: str | None) -> MetricView:
        """The view with another table as its own; filters and dimensions that don't reach it have no effect there."""
        if home is None:
            return self.root
        if home not in self.root.homes:
            other = copy.copy(self.root)
            other.fact = self.model.table(home)
            self.root.homes[home] = other
        return self.root.homes[home]

    def reaches(self, node, role: tuple | None = None) -> bool:
        """Whether all columns of an expression are the own table's or reachable from it; not if only some of them are."""
        tables = {self.resolve(n)[1][0].lower() for n in walk(node) if isinstance(n, Ref) and self.resolve(n)[0] == "column"}
        inside = tables & set(self.paths(role))
        if inside and inside != tables:
            raise DaxError(f"a filter over {sorted(tables)} reaches {self.fact.name} only in part")
        return not tables or bool(inside)

    def homed(self, context: Context, table: str) -> Context:
        """The context as rows of ``table`` see it."""
        home = table.lower()
        if home == self.root.fact.name.lower():
            home = None
            if not self.root.crossed_tables(context):
                return replace(context, home=None)
        view = self.at(home)
        role = context.role if context.role and context.role[0] in view.paths() else None
        known = set(view.paths(role))
        near = tuple(p for p in context.filters if view.reaches(p, role))
        far = tuple(p for p in context.filters if p not in near and any(self.at(t).reaches(p) for t in view.crossed_tables(context)))
        seen = {"filters": near, "far": context.far + far, "role": role, "semi": tuple(s for s in context.semi if s[0].startswith(f"{snake(table)}__"))}
        if home is not None and home in context.removed:
            seen["removed"] = context.removed | {"*"}
        if context.axis is not None and context.axis[0].lower() not in known:
            seen |= {"time": (), "axis": None}
        return replace(context, home=home, **seen)

    # --- filters from the many side

    def crossing(self, context: Context) -> list[Relationship]:
        """Relationships that filters cross in both directions: those of the context and the model's own."""
        return [r for r in self.model.relationships if r in context.cross or r.cross_filter == "BOTH" and r.is_active]

    def crossed_tables(self, context: Context) -> list[str]:
        """Lower-case tables whose filters reach this one over such relationships, one after another."""
        found, here = [], set(self.paths(context.role))
        while more := [r.from_table.lower() for r in self.crossing(context) if r.to_table.lower() in here and r.from_table.lower() not in (*found, *here)]:
            found += more
            for t in more:
                here |= set(self.at(t).paths())
        return found

    def seen_tables(self, context: Context) -> set[str]:
        """Tables whose columns can group or filter the own rows in a context."""
        return set(self.paths(context.role)).union(*[self.at(t).paths() for t in self.crossed_tables(context)])

    def restricted(self, rows: DataFrame, dims: list[Dimension], where, context: Context, left: list[Relationship]) -> DataFrame:
        """The own rows once for each group of the dimensions that reach them from the many side, and where such filters hold.

        Each relationship gives the different keys and groups of its many side, itself restricted in this way, so a table's rows are
        never multiplied by those of another.
        """
        here = set(self.paths(context.role))
        for r in [r for r in left if r.to_table.lower() in here and r.from_table.lower() not in here]:
            view, rest = self.at(r.from_table.lower()), [x for x in left if x != r]
            inner = replace(context, home=r.from_table.lower(), filters=(), role=None)
            inside = view.reach_over(rest, inner)
            own = [d for d in dims if d.table.lower() in inside]
            predicates = [p for p in [*(conjuncts(where) if where is not None else []), *context.far] if self.tables_of(p) and self.tables_of(p) <= inside and not self.tables_of(p) <= here]
            predicates = [p for p in predicates if not all(self.ignores(Dimension("", *c), context) for c in self.columns_of(p))]
            if not own and not predicates:
                continue
            used = {r.from_table.lower()}
            near = set(view.paths())
            found = [view.row(p, used) for p in predicates if self.tables_of(p) <= near]
            values = [view.period(d, used).alias(d.name) for d in own if d.table.lower() in near]
            used |= {x.to_table.lower() for x in rest if x.to_table.lower() in near}
            many = view.frame(used)
            for p in found:
                many = many.where(p)
            beyond = [d for d in own if d.table.lower() not in near]
            many = view.restricted(many, beyond, where, inner, rest)
            keys = many.select(F.col(qualified(r.from_table, r.from_column)).alias("_key"), *values, *[F.col(f"`{d.name}`") for d in beyond]).where("_key is not null").distinct()
            rows = rows.join(keys, F.col(qualified(r.to_table, r.to_column)) == F.col("_key"), "inner" if own else "left_semi").drop("_key")
            dims = [d for d in dims if d not in own]
        return rows

    def reach_over(self, left: list[Relationship], context: Context) -> set[str]:
        here = set(self.paths())
        while more := [r for r in left if r.to_table.lower() in here and r.from_table.lower() not in here]:
            for r in more:
                here |= set(self.at(r.from_table.lower()).paths())
        return here

    def columns_of(self, node) -> list[tuple]:
        return [self.resolve(n)[1] for n in walk(node) if isinstance(n, Ref) and self.resolve(n)[0] == "column"]

    def tables_of(self, node) -> set[str]:
        return {c[0].lower() for c in self.columns_of(node)}

    # --- joins

    def paths(self, role: tuple | None = None) -> dict[str, list[Relationship]]:
        """Lower-case table -> relationships from the fact to it (active many-to-one, or the role's own)."""
        rels = [r for r in self.model.relationships if r.is_active and r.cardinality in ("MANY_TO_ONE", "ONE_TO_ONE")]
        if role:
            rels = [r for r in rels if (r.from_table.lower(), r.to_table.lower()) != (role[0], role[2])]
            rels += [replace(r, is_active=True) for r in self.model.relationships if (r.from_table.lower(), r.from_column.lower(), r.to_table.lower(), r.to_column.lower()) == role]
        found: dict[str, list[Relationship]] = {self.fact.name.lower(): []}
        todo = [self.fact.name.lower()]
        while todo:
            here = todo.pop(0)
            for r in rels:
                if r.from_table.lower() == here and r.to_table.lower() not in found:
                    found[r.to_table.lower()] = [*found[here], r]
                    todo.append(r.to_table.lower())
        return found

    def reachable(self) -> list[Table]:
        return [self.model.table(t) for t in self.paths()]

    def load(self, table: str) -> DataFrame:
        """A table's rows, its columns named ``table__column``."""
        t = self.model.table(table)
        rows = self.source(t)
        calculated = [c for c in t.columns if c.expression]
        if calculated:
            rows = rows.withColumns({c.name: F.expr(c.expression) for c in calculated})
        lower = {c.lower(): c for c in rows.columns}
        names = [c.name for c in t.columns] or rows.columns
        return rows.select(*[F.col(f"`{lower[n.lower()]}`").alias(qualified(t.name, n)) for n in names if n.lower() in lower])

    def frame(self, used: set, role: tuple | None = None, semi: tuple = (), inward: bool = False) -> DataFrame:
        """The fact with left joins to just the tables asked for and those on the way, then to the lookups.

        ``inward``, where all joins are left ones: tables are joined with those behind them first, so that the fact's rows are dealt out
        once for each of its own relationships and not for each table on the way.
        """
        paths = self.paths(role)
        joined, out = {self.fact.name.lower()}, self.load(self.fact.name)
        behind: dict[str, list] = {}
        for key, table, column in semi:
            keys = self.load(table).select(F.col(qualified(table, column)).alias("_key")).where("_key is not null").distinct()
            out = out.join(keys, F.col(key) == F.col("_key"), "left_semi")
        for t in sorted(u for u in used if isinstance(u, str)):
            if t not in paths:
                raise DaxError(f"table {t} is not reachable from {self.fact.name}")
            for r in paths[t]:
                if r.to_table.lower() not in joined:
                    joined.add(r.to_table.lower())
                    behind.setdefault(r.from_table.lower(), []).append(r)
                    if not inward:
                        out = out.join(self.load(r.to_table), related(r), self.joins.get(r.to_table.lower(), self.join))

        def with_behind(rows: DataFrame, table: str) -> DataFrame:
            for r in behind.get(table, []):
                rows = rows.join(with_behind(self.load(r.to_table), r.to_table.lower()), related(r), "left")
            return rows

        if inward:
            out = with_behind(out, self.fact.name.lower())
        for node in sorted((u for u in used if isinstance(u, Call)), key=repr):
            out = self.looked_up(out, node)
        return out

    def looked_up(self, rows: DataFrame, node: Call) -> DataFrame:
        """LOOKUPVALUE(result, search, value, ...): the result where it is the only one, else null (or the alternative)."""
        name, pairs = lookup_name(node), list(zip(node.args[1::2], node.args[2::2], strict=False))
        result = node.args[0]
        found = self.load(result.table).groupBy(*[F.col(qualified(k.table, k.name)).alias(f"{name}_{i}") for i, (k, _) in enumerate(pairs)])
        c = F.col(qualified(result.table, result.name))
        found = found.agg(F.when(F.min(c).eqNullSafe(F.max(c)), F.max(c)).alias(name))
        on = None
        for i, (_, value) in enumerate(pairs):
            same = self.row(value, set()) == F.col(f"{name}_{i}")
            on = same if on is None else on & same
        return rows.join(found, on, "left")

    # --- compilation

    def resolve(self, ref: Ref) -> tuple[str, object]:
        """('measure', text) or ('column', (table, column))."""
        if ref.table is None:
            if ref.name.lower() in self.measures_by_name:
                return "measure", self.measures_by_name[ref.name.lower()]
            own = [(t.name, c.name) for t in [self.root.fact, *self.root.reachable()] for c in t.columns if c.name.lower() == ref.name.lower()]
            if not own:
                raise DaxError(f"unknown measure or column [{ref.name}]")
            return "column", own[0]
        t = self.model.table(ref.table)
        if t is None:
            raise DaxError(f"unknown table {ref.table}")
        if (own := next((c.name for c in t.columns if c.name.lower() == ref.name.lower()), None)) is not None:
            return "column", (t.name, own)
        if ref.name.lower() in self.measures_by_name:
            return "measure", self.measures_by_name[ref.name.lower()]
        raise DaxError(f"unknown column {ref.table}[{ref.name}]")

    def row(self, node, used: set[str]) -> Column:
        """A row expression as a column; ``used`` gathers the tables."""
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Ref):
            kind, at = self.resolve(node)
            if kind == "measure":
                raise DaxError(f"measure [{node.name}] in a row context")
            used.add(at[0].lower())
            return F.col(qualified(*at))
        if isinstance(node, Call) and node.name == "RELATED":
            return self.row(node.args[0], used)
        if isinstance(node, Call) and node.name == "LOOKUPVALUE":
            used.add(node)
            for value in node.args[2::2]:
                self.row(value, used)
            found = F.col(lookup_name(node))
            return found if len(node.args) % 2 else F.coalesce(found, self.row(node.args[-1], used))
        return self.operation(node, lambda n: self.row(n, used))

    def operation(self, node, go: Callable) -> Column:
        if isinstance(node, Bound):
            return F.col(node.name)
        if isinstance(node, Neg):
            return -go(node.value)
        if isinstance(node, Bin):
            if node.op == "IN":
                return go(node.left).isin(*[v.value for v in node.right.values])
            if node.op in ("=", "<>") and isinstance(node.right, Call) and node.right.name == "BLANK":
                return go(node.left).isNull() if node.op == "=" else go(node.left).isNotNull()
            a, b = go(node.left), go(node.right)
            return {
                "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "^": lambda: F.pow(a, b), "=": lambda: a == b, "<>": lambda: a != b,
                "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "&&": lambda: a & b, "||": lambda: a | b,
                "&": lambda: F.concat(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))),
            }[node.op]()
        if isinstance(node, Call):
            if node.name in REJECTED:
                raise DaxError(f"{node.name}: {REJECTED[node.name]}")
            if node.name == "SWITCH":
                value = None if node.args[0] in (Lit(True), Call("TRUE")) else go(node.args[0])
                pairs, rest = node.args[1:], None
                if len(pairs) % 2:
                    pairs, rest = pairs[:-1], go(pairs[-1])
                return switch(value, [(go(w), go(t)) for w, t in zip(pairs[::2], pairs[1::2], strict=True)], rest)
            if node.name in FUNCTIONS:
                f, literal = FUNCTIONS[node.name]
                values = [constant(a) if k in literal else go(a) for k, a in enumerate(node.args)]
                try:
                    return f(*values)
                except (TypeError, PySparkException) as e:
                    raise DaxError(f"{node.name} with {len(values)} arguments in this place") from e
            raise DaxError(f"{node.name} is not known here")
        if isinstance(node, TableRef):
            raise DaxError(f"table {node.name} where a value is needed")
        raise DaxError(f"can't compile {node}")

    def measure(self, node, context: Context, plan: Plan, seen: tuple = ()) -> Column:
        """A measure as a column over leaves; leaves are entered into the plan."""
        go = lambda n: self.measure(n, context, plan, seen)
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Ref):
            kind, at = self.resolve(node)
            if kind == "column":
                raise DaxError(f"column {at[0]}[{at[1]}] outside of an aggregation")
            if node.name.lower() in seen:
                raise DaxError(f"measure [{node.name}] refers to itself")
            return self.measure(parse(at), context, plan, (*seen, node.name.lower()))
        if not isinstance(node, Call):
            return self.operation(node, go)
        name, args = node.name, node.args
        if name in AGGREGATES and len(args) == 1 and isinstance(args[0], Ref):
            return self.aggregate(AGGREGATES[name], args[0], context, plan, name, self.table_of(args[0]))
        if name in ITERATORS:
            table, extra = self.real_table(args[0])
            if table is not None:
                return self.aggregate(ITERATORS[name], args[1], replace(context, filters=context.filters + extra), plan, name, self.named(table))
            return self.nested(ITERATORS[name], self.virtual(args[0]), args[1], context, plan)
        if name == "COUNTROWS":
            table, extra = self.real_table(args[0])
            inner = replace(context, filters=context.filters + extra)
            if table is not None:
                return self.aggregate(F.count, Lit(1), inner, plan, name, self.named(table))
            if args[0].name in ("VALUES", "DISTINCT") and isinstance(args[0].args[0], Ref):
                return self.measure(Call("DISTINCTCOUNT", args[0].args), inner, plan, seen)
            return self.nested(lambda v: F.count_if(v > 0), self.virtual(args[0]), Call("COUNTROWS", (TableRef(self.fact.name),)), context, plan)
        if name == "DISTINCTCOUNTNOBLANK":
            return self.aggregate(F.count_distinct, args[0], context, plan, name, self.table_of(args[0]))
        if name == "DISTINCTCOUNT":
            blank = self.aggregate(lambda c: F.max(c.isNull().cast("int")), args[0], context, plan, "HASBLANK", self.table_of(args[0]))
            return self.aggregate(F.count_distinct, args[0], context, plan, name, self.table_of(args[0])) + blank
        if name == "COUNTBLANK":
            return self.aggregate(lambda c: F.count_if(c.isNull()), args[0], context, plan, name, self.table_of(args[0]))
        if name in ("FIRSTDATE", "LASTDATE"):
            return self.aggregate(F.min if name == "FIRSTDATE" else F.max, args[0], context, plan, name, self.table_of(args[0]))
        if name in ("LASTNONBLANKVALUE", "FIRSTNONBLANKVALUE", "LASTNONBLANK", "FIRSTNONBLANK"):
            pick = F.max_by if name.startswith("LAST") else F.min_by
            key = lambda v, at: F.when(v.isNotNull(), at)
            value = (lambda v: pick(v, key(v, F.col("_key0")))) if name.endswith("VALUE") else (lambda v: pick(F.col("_key0"), key(v, F.col("_key0"))))
            return self.nested(value, self.virtual(Call("VALUES", args[:1])), args[1], context, plan)
        if name == "CONCATENATEX":
            return self.concatenated(args, context, plan)
        if name == "RANKX":
            return self.rank_leaf(args, context, plan)
        if name == "CALCULATE":
            for k, a in enumerate(args[1:], 1):
                if isinstance(a, Call) and a.name in ("LASTNONBLANK", "FIRSTNONBLANK"):
                    pick, rest = F.max_by if a.name.startswith("LAST") else F.min_by, Call(name, (args[0], *args[1:k], *args[k + 1 :]))
                    return self.nested(lambda v, pick=pick: pick(v, F.when(F.col("_given").isNotNull(), F.col("_key0"))), self.virtual(Call("VALUES", a.args[:1])), rest, context, plan, given=a.args[1])
                if isinstance(a, Call) and (a.name == "TOPN" or a.name == "FILTER" and self.real_table(a)[0] is None and self.has_measure(a.args[1])):
                    rest = Call(name, (args[0], *args[1:k], *args[k + 1 :]))
                    if not self.additive(args[0]):
                        raise DaxError(f"CALCULATE over {a.name} needs an additive measure")
                    return self.nested(F.sum, self.virtual(a), rest, context, plan)
            for a in args[1:]:
                context = self.modified(a, context)
            return self.measure(args[0], context, plan, seen)
        if name in ("TOTALYTD", "TOTALQTD", "TOTALMTD"):
            more = tuple(a for a in args[2:] if not isinstance(a, Lit))
            return self.measure(Call("CALCULATE", (args[0], Call(f"DATES{name[5:]}", args[1:2]), *more)), context, plan, seen)
        if name.startswith(("OPENINGBALANCE", "CLOSINGBALANCE")):
            unit = name[14:]
            edge = Call(f"ENDOF{unit}", args[1:2]) if name.startswith("CLOSING") else Call("PREVIOUSDAY", (Call(f"STARTOF{unit}", args[1:2]),))
            return self.measure(Call("CALCULATE", (args[0], edge, *[a for a in args[2:] if not isinstance(a, Lit)])), context, plan, seen)
        return self.operation(node, go)

    # --- tables inside expressions

    def real_table(self, node) -> tuple[TableRef | None, tuple]:
        """A table of the model under FILTERs, and their predicates; None for tables of values."""
        extra: tuple = ()
        while isinstance(node, Call) and node.name in ("FILTER", "RELATEDTABLE") and node.args:
            extra += node.args[1:2] if node.name == "FILTER" else ()
            node = node.args[0]
        return (node, extra) if isinstance(node, TableRef) else (None, ())

    def named(self, table: TableRef) -> str:
        if (t := self.model.table(table.name)) is None:
            raise DaxError(f"unknown table {table.name}")
        return t.name

    def table_of(self, ref) -> str:
        """The table of a column that is aggregated."""
        if not isinstance(ref, Ref):
            raise DaxError("an aggregate needs a column")
        kind, at = self.resolve(ref)
        if kind == "measure":
            raise DaxError(f"measure [{ref.name}] in a row context")
        return at[0]

    def virtual(self, node) -> Virtual:
        if not isinstance(node, Call) or node.name not in VIRTUAL:
            raise DaxError(f"an iterator over {getattr(node, 'name', node)}")
        a, columns = node.args, []
        if node.name in ("FILTER", "TOPN"):
            inner = self.virtual(a[0] if node.name == "FILTER" else a[1])
            if node.name == "FILTER":
                return replace(inner, filters=(*inner.filters, a[1]))
            rising = len(a) > 3 and str(a[3].name if isinstance(a[3], TableRef) else a[3].value).upper() in ("ASC", "1", "TRUE")
            return replace(inner, tops=(*inner.tops, (int(constant(a[0])), a[2], rising)))
        if node.name in ("CROSSJOIN", "GENERATE"):
            parts = [self.virtual(x) for x in a]
            return Virtual(*(tuple(dict.fromkeys(x for p in parts for x in getattr(p, f))) for f in ("keys", "filters", "tops", "names")))
        if node.name == "ADDCOLUMNS":
            inner, rest = self.virtual(a[0]), a[1:]
            return replace(inner, names=inner.names + tuple((n.value.lower(), e) for n, e in zip(rest[::2], rest[1::2], strict=True)))
        names, filters = [], ()
        if node.name == "SUMMARIZE" and not self.is_column(a[0]):
            filters, a = self.real_table(a[0])[1], a[1:]
        k = 0
        while k < len(a):
            if self.is_column(a[k]):
                columns.append(self.resolve(a[k])[1])
            elif isinstance(a[k], Lit) and k + 1 < len(a):
                names.append((a[k].value.lower(), a[k + 1]))
                k += 1
            elif isinstance(a[k], Call) and a[k].name == "FILTER":
                filters += (a[k].args[1],)
            else:
                raise DaxError(f"{node.name} over {a[k]}")
            k += 1
        return Virtual(tuple(columns), filters, (), tuple(names))

    def is_column(self, node) -> bool:
        return isinstance(node, Ref) and self.resolve(node)[0] == "column"

    def has_measure(self, node) -> bool:
        return any(isinstance(n, Ref) and self.resolve(n)[0] == "measure" or isinstance(n, Call) and n.name in (AGGREGATES | ITERATORS) and n.name not in ("MIN", "MAX") for n in walk(node))

    def additive(self, node) -> bool:
        while isinstance(node, Ref) and self.resolve(node)[0] == "measure":
            node = parse(self.resolve(node)[1])
        return isinstance(node, Call) and (node.name in ADDITIVE and self.real_table(node.args[0])[0] is not None or node.name in ("SUM", "COUNT", "COUNTA") or node.name == "CALCULATE" and self.additive(node.args[0]))

    # --- filter arguments

    def modified(self, arg, context: Context) -> Context:
        """The context under one filter argument of CALCULATE."""
        if (opened := self.open_condition(arg)) is not None:
            step, axis = opened
            if context.axis not in (None, axis):
                raise DaxError("time functions over two date columns at once")
            return replace(context, time=(*context.time, step), axis=axis)
        if isinstance(arg, (Bin, Items)) or isinstance(arg, Call) and arg.name in ("NOT", "AND", "OR", "ISBLANK"):
            return replace(context, filters=(*context.filters, arg))
        if not isinstance(arg, Call):
            raise DaxError("this filter argument isn't known")
        n, a = arg.name, arg.args
        if n == "KEEPFILTERS":
            return self.modified(a[0], context)
        if n == "FILTER":
            if isinstance(a[0], Call) and a[0].name in ("ALL", "VALUES"):
                context = self.modified(a[0], context) if a[0].name == "ALL" else context
            return replace(context, filters=(*context.filters, a[1]))
        if n in ("ALL", "REMOVEFILTERS"):
            if not a:
                return replace(context, removed=frozenset("*"))
            names = {x.name.lower() if isinstance(x, TableRef) else f"{x.table}[{x.name}]".lower() for x in a}
            if self.fact.name.lower() in names:
                names = {"*"}
            return replace(context, removed=context.removed | names)
        if n == "ALLEXCEPT":
            return replace(context, kept=frozenset(f"{x.table}[{x.name}]".lower() for x in a[1:]))
        if n == "DATESBETWEEN":
            bounds = [Bin(op, a[0], v) for op, v in ((">=", a[1]), ("<=", a[2])) if v not in (Lit(None), Call("BLANK"))]
            return replace(context, filters=(*context.filters, *bounds))
        if n == "USERELATIONSHIP":
            return replace(context, role=(a[0].table.lower(), a[0].name.lower(), a[1].table.lower(), a[1].name.lower()))
        if n == "CROSSFILTER":
            ends = {(x.table.lower(), x.name.lower()) for x in a[:2]}
            found = next((r for r in self.model.relationships if {(r.from_table.lower(), r.from_column.lower()), (r.to_table.lower(), r.to_column.lower())} == ends), None)
            way = constant(a[2])
            if found is None or way not in ("BOTH", "ONEWAY"):
                raise DaxError(f"CROSSFILTER by {way}: " + ("no such relationship" if found is None else "not known"))
            return replace(context, cross=(*context.cross, found)) if way == "BOTH" else context
        if n == "TREATAS":
            table, column = a[0].args[0].table, a[0].args[0].name
            return replace(context, semi=(*context.semi, (qualified(a[1].table, a[1].name), table, column)))
        steps, axis = self.time_steps(arg)
        if context.axis not in (None, axis):
            raise DaxError("time functions over two date columns at once")
        return replace(context, time=(*context.time, *steps), axis=axis)

    def open_condition(self, arg) -> tuple | None:
        """(step, axis) of a condition over a table's values that looks at the outer context's first or last one, else None.

        FILTER(ALL(table or columns), condition), a condition alone, or DATESBETWEEN with such a bound.
        """
        if isinstance(arg, Call) and arg.name == "FILTER" and isinstance(arg.args[0], Call) and arg.args[0].name == "ALL":
            parts = conjuncts(arg.args[1])
        elif isinstance(arg, Call) and arg.name == "DATESBETWEEN":
            parts = [Bin(op, arg.args[0], v) for op, v in ((">=", arg.args[1]), ("<=", arg.args[2])) if v not in (Lit(None), Call("BLANK"))]
        elif isinstance(arg, Bin):
            parts = conjuncts(arg)
        else:
            return None
        ends = {"MAX": "_high", "LASTDATE": "_high", "MIN": "_low", "FIRSTDATE": "_low"}
        looks = lambda n: isinstance(n, Call) and n.name in ends and len(n.args) == 1 and self.is_column(n.args[0])
        if not any(looks(n) for p in parts for n in walk(p)):
            return None
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
        parts = [Bin(turned[p.op], p.right, p.left) if isinstance(p, Bin) and p.op in turned and not self.is_column(p.left) and self.is_column(p.right) else p for p in parts]
        ordered = [self.resolve(p.left)[1] for p in parts if isinstance(p, Bin) and p.op in ("<", "<=", ">", ">=") and self.is_column(p.left)]
        table = next(self.resolve(n.args[0])[1][0] for p in parts for n in walk(p) if looks(n))
        axis = ordered[0] if ordered else next(((table, r.to_column) for r in self.model.relationships if r.to_table.lower() == table.lower()), None)
        if axis is None:
            raise DaxError(f"no axis for a condition over {table}")
        names: dict[tuple, str] = {}

        def inside(node):
            if looks(node):
                at = self.resolve(node.args[0])[1]
                end = ends[node.name]
                return Bound(end) if at == axis else Bound(("_most" if end == "_high" else "_least") + names.setdefault(at, f"_attribute{len(names)}"))
            if isinstance(node, Ref):
                kind, at = self.resolve(node)
                if kind == "measure" or at[0] != axis[0]:
                    raise DaxError(f"[{node.name}] in a condition over {axis[0]}")
                return Bound("_at") if at == axis else Bound(names.setdefault(at, f"_attribute{len(names)}"))
            if isinstance(node, Call):
                return Call(node.name, tuple(map(inside, node.args)))
            if isinstance(node, Bin):
                return Bin(node.op, inside(node.left), inside(node.right))
            return Neg(inside(node.value)) if isinstance(node, Neg) else node

        conditions = tuple(map(inside, parts))
        return ("range", (conditions, tuple(names.items())), "DAY"), axis

    def time_steps(self, node) -> tuple[tuple, tuple]:
        """The steps of a time function, innermost first, and the column that they go over."""
        if isinstance(node, Ref):
            kind, at = self.resolve(node)
            if kind != "column":
                raise DaxError(f"[{node.name}] where a date column is needed")
            return (), at
        if not isinstance(node, Call) or not node.args:
            raise DaxError("this filter argument isn't known")
        n, a = node.name, node.args
        unit = lambda x: str(x.name if isinstance(x, TableRef) else x.value).upper()
        if n == "SAMEPERIODLASTYEAR":
            step = ("shift", -1, "YEAR")
        elif n == "DATEADD":
            step = ("shift", int(constant(a[1])), unit(a[2]))
        elif n == "PARALLELPERIOD":
            step = ("parallel", int(constant(a[1])), unit(a[2]))
        elif n.startswith(("PREVIOUS", "NEXT")):
            step = ("neighbour", -1 if n[0] == "P" else 1, n.removeprefix("PREVIOUS").removeprefix("NEXT"))
        elif n in ("DATESYTD", "DATESQTD", "DATESMTD"):
            step = ("to_date", None, TO_DATE[n[5:]])
        elif n == "DATESINPERIOD":
            step = ("trailing", (a[1], int(constant(a[2]))), unit(a[3]))
        elif n in ("LASTDATE", "FIRSTDATE"):
            step = ("edge", n[0] == "L", "DAY")
        elif n.startswith(("STARTOF", "ENDOF")):
            step = ("edge", n[0] == "E", n.removeprefix("STARTOF").removeprefix("ENDOF"))
        else:
            raise DaxError(f"{n} as a filter: {REJECTED.get(n, 'not known')}")
        if step[2] not in PERIODS or step[0] == "parallel" and step[2] == "DAY":
            raise DaxError(f"{n} by {step[2]}")
        steps, axis = self.time_steps(a[0])
        return (*steps, step), axis

    def aggregate(self, function: Callable, expression, context: Context, plan: Plan, kind: str, table: str) -> Column:
        """A leaf over the rows of ``table``."""
        context = self.homed(context, table)
        view = self.at(context.home)
        if kind in ("AVERAGE", "AVERAGEX") and (context.time or self.root.stored or self.root.in_parts_only):  # its parts can be put together, it can't
            total, n = (self.aggregate(f, expression, context, plan, k, table) for f, k in ((F.sum, "SUMX"), (F.count, "COUNTX")))
            return F.try_divide(total, n)

        def value(used: set[str]) -> Column:
            return F.when(view.holds(context, used), view.row(expression, used)) if context.filters else view.row(expression, used)

        def build(used: set[str]) -> Column:
            if context.filters and kind in ("COUNTBLANK", "HASBLANK"):
                inner = F.when(view.holds(context, used), view.row(expression, used).isNull().cast("int")).otherwise(0)
                return F.sum(inner) if kind == "COUNTBLANK" else F.max(inner)
            return function(value(used))

        build.value, build.expression = value, expression
        return F.col(plan.leaf(expression, context, build, kind in ADDITIVE, kind))

    def nested(self, function: Callable, table: Virtual, expression, context: Context, plan: Plan, given=None) -> Column:
        """An iterator over the values of columns: the inner measure at their grain first, then the outer aggregate."""
        kind = f"NESTED{len(plan.leaves)}"
        return F.col(plan.leaf((table, expression, given), context, (function, table, expression, given), False, kind))

    def concatenated(self, args: tuple, context: Context, plan: Plan) -> Column:
        """CONCATENATEX: the rows of a table, or the different values of columns; in the order asked for, else of the values."""
        sep = constant(args[2]) if len(args) > 2 else ""
        falls = len(args) > 4 and constant(args[4]) in ("DESC", 0, False)
        real, extra = self.real_table(args[0])
        order = args[3] if len(args) > 3 else None

        def text(pairs: Column) -> Column:
            return F.array_join(F.transform(F.sort_array(pairs, not falls), lambda x: x["v"].cast("string")), sep)

        if real is None:
            held = (lambda v: text(F.collect_list(F.when(v.isNotNull(), F.struct((v if order is None else F.col("_given")).alias("k"), v.alias("v"))))))
            return self.nested(held, self.virtual(args[0]), args[1], context, plan, given=order)
        inner = self.homed(replace(context, filters=context.filters + extra), self.named(real))
        view = self.at(inner.home)

        def build(used: set) -> Column:
            v = view.row(args[1], used)
            pair = F.struct((v if order is None else view.row(order, used)).alias("k"), v.alias("v"))
            return text(F.collect_list(F.when(view.holds(inner, used) & v.isNotNull(), pair)))

        return F.col(plan.leaf(args, inner, build, False, "CONCATENATEX"))

    def holds(self, context: Context, used: set) -> Column:
        out = F.lit(True)
        for p in context.filters:
            out = out & self.row(p, used)
        return out

    def rank_leaf(self, args: tuple, context: Context, plan: Plan) -> Column:
        """RANKX(ALL(columns or table), measure, , order, ties)."""
        if not (isinstance(args[0], Call) and args[0].name in ("ALL", "VALUES", "ALLSELECTED") and args[0].args):
            raise DaxError("RANKX needs ALL or VALUES of columns or a table")
        over = frozenset(x.name.lower() if isinstance(x, TableRef) else f"{x.table}[{x.name}]".lower() for x in args[0].args)
        if len(args) > 2 and args[2] != Lit(None):
            raise DaxError("RANKX of another value")
        rising = len(args) > 3 and args[3] != Lit(None) and str(constant(args[3])).upper() in ("ASC", "1", "TRUE")
        dense = len(args) > 4 and str(constant(args[4])).upper() == "DENSE"
        return F.col(plan.leaf(args, context, (over, args[1], rising, dense, args[0].name == "ALL"), False, "RANKX"))

    # --- queries

    def query(self, dims: Sequence[str] = (), measures: Sequence[str] = (), where: str | None = None, order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """Measures at the grain of ``dims``; ``where`` is a predicate over columns, ``order_by`` takes ``-name`` for descending."""
        found = [self.dimension(d) for d in dims]
        plan, columns = Plan(), []
        for m in measures:
            if m.lower() not in self.measures_by_name:
                raise DaxError(f"unknown measure [{m}]")
            columns.append((m, self.measure(parse(self.measures_by_name[m.lower()]), Context(), plan, (m.lower(),))))
        out = self.evaluate(found, plan, parse(where) if where else None)
        out = out.select(*[F.col(f"`{d.name}`") for d in found], *[c.alias(m) for m, c in columns])
        if order_by:
            out = out.orderBy(*[F.desc(f"`{o[1:]}`") if o.startswith("-") else F.asc(f"`{o}`") for o in order_by])
        return out if limit is None else out.limit(limit)

    def evaluate(self, dims: list[Dimension], plan: Plan, where, anchor: Context | None = None, keys: list[Dimension] = ()) -> DataFrame:
        """All leaves at the grain of ``dims`` and ``keys``; the groups are those that the anchor's context has."""
        anchor = replace(anchor or Context(), filters=())
        groups: dict[tuple, list] = {}
        signs = {}
        for (signature, *_), (alias, build, additive, context, kind) in plan.leaves.items():
            signs[alias] = (signature, kind, context.filters)
            special = alias if kind.startswith("NESTED") or kind == "RANKX" else False
            groups.setdefault((replace(context, filters=()), special), []).append((alias, build, additive, context, kind))
        every = [*dims, *keys]
        # the groups are those of the tables that have leaves and that all dimensions reach
        homes = list(dict.fromkeys((None, ()) if special else (c.home, c.cross) for c, special in groups)) or [(None, ())]
        seen = lambda c: self.at(c.home).seen_tables(c)
        anchored = [(anchor if h is None else self.homed(replace(anchor, cross=cross), h)) if not cross else self.homed(replace(anchor, cross=cross), h or self.fact.name) for h, cross in homes]
        anchors = [(c, False) for c in dict.fromkeys([*anchored, anchor]) if all(d.table.lower() in seen(c) for d in every)]
        if not anchors:
            raise DaxError(f"no measure's table is reached by all of {[d.name for d in every]}")
        anchors = [a for a in anchors if a[0] in anchored] or anchors
        if every or not groups:
            groups = {a: groups.get(a, []) for a in anchors} | groups
        here = lambda d, c: d.table.lower() in seen(c)
        kept = {c: [d for d in dims if here(d, c) and not self.ignores(d, c)] + [k for k in keys if here(k, c) and not self.ignores_key(k, c, anchor)] for c, _ in groups}
        shared = {h: self.at(h).finest({g: leaves for g, leaves in groups.items() if g[0].home == h}, kept, where, signs) for h in {c.home for c, _ in groups}}

        def part(context: Context, special: object, leaves: list) -> DataFrame:
            own, view = kept[context], self.at(context.home)
            if special:
                return self.rank_part(own, leaves[0], where) if leaves[0][4] == "RANKX" else self.nest(own, leaves[0], where)
            if context in shared[context.home]:
                return view.derived(shared[context.home][context], own, leaves, where, context, signs)
            return view.group(own, leaves, where, context)

        first = anchors if every else list(groups)[:1]
        out = stitched([part(*g, groups[g]) for g in first], [d.name for d in kept[first[0][0]]])
        for g, leaves in groups.items():
            if g not in first:
                out = self.attach(out, part(*g, leaves), kept[g[0]])
        return out

    def ignores(self, d: Dimension, c: Context) -> bool:
        own = {"*", d.table.lower(), f"{d.table}[{d.column}]".lower()}
        return bool(own & c.removed) or c.kept is not None and f"{d.table}[{d.column}]".lower() not in c.kept

    def ignores_key(self, d: Dimension, c: Context, anchor: Context) -> bool:
        """An inner key is ignored only by what the inner expression removes."""
        return self.ignores(d, replace(c, removed=c.removed - anchor.removed, kept=c.kept if anchor.kept is None else None))

    def period(self, d: Dimension, used: set) -> Column:
        used.add(d.table.lower())
        return grained(F.col(qualified(d.table, d.column)), d.grain)

    # --- filters

    def filtered(self, where, context: Context) -> tuple[list, list]:
        """The predicates that hold for the rows, and those that choose the visible days of a time context."""
        reach = lambda p: context.home is None and not self.crossed_tables(context) or self.reaches(p, context.role)
        rows, days = [p for p in conjuncts(self.base_filter) if reach(p)] if self.base_filter else [], []
        for part in conjuncts(where) if where is not None else []:
            if not reach(part):
                continue
            columns = [self.resolve(n)[1] for n in walk(part) if isinstance(n, Ref)]
            if columns and all(self.ignores(Dimension("", *c), context) for c in columns):
                continue
            on_axis = [self.on_axis(Dimension("", *c), context) for c in columns]
            if context.time and any(on_axis):
                if not all(on_axis):
                    raise DaxError("a filter over dates and other columns at once, under a time function")
                days.append(part)
            else:
                rows.append(part)
        return rows, days

    def on_axis(self, d: Dimension, context: Context) -> bool:
        """Whether a dimension follows from the day that the context's time functions go over."""
        table, column = (x.lower() for x in context.axis or ("", ""))
        return d.table.lower() == table and (table != self.fact.name.lower() or d.column.lower() == column)

    # --- rows, by context

    def group(self, dims: list[Dimension], leaves: list, where, context: Context) -> DataFrame:
        used: set = set()
        predicates, day_predicates = self.filtered(where, context)
        found = [self.row(p, used) for p in predicates]
        moving = [d for d in dims if context.time and self.on_axis(d, context)]
        crossed = self.crossing(context) if self.crossed_tables(context) else []
        inside = set(self.paths(context.role))
        beyond = [d for d in dims if crossed and d.table.lower() not in inside]
        values = [self.period(d, used).alias(d.name) if d not in beyond else F.col(f"`{d.name}`") for d in dims if d not in moving]
        aggregates = [build(used).alias(alias) for alias, build, *_ in leaves]
        used |= {r.to_table.lower() for r in crossed if r.to_table.lower() in inside}
        day = self.day(context, used) if context.time else None
        running = running_step(context) and all(kind in MERGE or kind in DISTINCT for *_, kind in leaves)
        first = {alias: build.value(used) for alias, build, *_, kind in leaves if running and kind in DISTINCT}
        rows = self.frame(used, context.role, context.semi)
        for p in found:
            rows = rows.where(p)
        if crossed:
            rows = self.restricted(rows, beyond, where, context, crossed)
        if running:
            names = [d.name for d in dims if d not in moving]
            daily = rows.groupBy(day.alias("_fact_day"), *values).agg(*[a for a, leaf in zip(aggregates, leaves, strict=True) if leaf[0] not in first]) if len(first) < len(leaves) else rows.select(day.alias("_fact_day"), *values).distinct()
            firsts = [first_days(rows, v.alias("_v"), day.alias("_fact_day"), values, names, context, alias) for alias, v in first.items()]
            return self.upto(daily, firsts, dims, names, leaves, day_predicates, context)
        if context.time:
            days = self.visible(moving, day_predicates, context)
            if all(kind in MERGE for *_, kind in leaves):
                names = [d.name for d in dims if d not in moving]
                return self.over_days(rows.groupBy(day.alias("_fact_day"), *values).agg(*aggregates), dims, names, leaves, days)
            rows = rows.withColumn("_fact_day", day).join(days, F.col("_fact_day").eqNullSafe(F.col("_day")))
            values = [F.col(f"`{d.name}`") if d in moving else self.period(d, set()).alias(d.name) for d in dims]
        if not aggregates:
            return rows.select(*values).distinct()
        return rows.groupBy(*values).agg(*aggregates) if values else rows.agg(*aggregates)

    def upto(self, daily: DataFrame, firsts: list[DataFrame], dims: list[Dimension], names: list[str], leaves: list, predicates: list, context: Context) -> DataFrame:
        """Leaves over all days up to each group's last visible day, since the period's begin or ever, by running sums.

        A combination of the other keys has as many rows in a window as it has days, whatever the facts' number; where the axis
        isn't of days, the windows are cut into parts, and what comes before each part is added.
        """
        for f in firsts:
            daily = daily.unionByName(f, allowMissingColumns=True)
        keys, at = [F.col(f"`{n}`") for n in names], F.col("_fact_day")
        kinds = {alias: kind for alias, *_, kind in leaves}
        whole = {alias: F.min if MERGE.get(kind) is F.min else F.max if MERGE.get(kind) is F.max else F.sum for alias, kind in kinds.items()}
        if firsts:
            daily = daily.groupBy(at, *keys).agg(*[f(a).alias(a) for a, f in whole.items()])
        daily = daily.where("_fact_day is not null")
        period = period_of(context, at)
        if self.is_date(context.axis):
            inside = Window.partitionBy(*keys, *period).orderBy(at)
            so_far = daily.withColumns({a: f(a).over(inside) for a, f in whole.items()})
        else:
            so_far = running_totals(daily, names, "_fact_day", whole)
        zero = [a for a, kind in kinds.items() if kind in COUNTS or kind in DISTINCT]
        so_far = so_far.withColumns({a: F.coalesce(F.col(a), F.lit(0)) for a in zero})
        moving = [d for d in dims if d.name not in names]
        direct = all((d.table, d.column) == context.axis and (d.grain or not self.is_date(context.axis)) for d in moving)
        if direct and not predicates:
            so_far = so_far.withColumns({d.name: grained(at, d.grain) for d in moving})
        else:
            seen = self.calendar(context.axis)
            for p in predicates:
                seen = seen.where(self.row(p, set()))
            days = seen.select(*[self.period(d, set()).alias(d.name) for d in moving], self.axis_value(context.axis).alias("_day")).distinct()
            so_far = so_far.join(days, at == F.col("_day"))
        out = [F.col(f"`{d.name}`") for d in dims]
        if not kinds:
            return so_far.select(*out).distinct()
        last = [F.max_by(a, at).alias(a) for a in kinds]
        return so_far.groupBy(*out).agg(*last) if dims else so_far.agg(*last)

    def over_days(self, daily: DataFrame, dims: list[Dimension], names: list[str], leaves: list, days: DataFrame) -> DataFrame:
        """Leaves by day put together over each group's days. No row is lost to the null-safe join; the days hold no null."""
        slim = daily.select("_fact_day", *[F.col(f"`{n}`") for n in names], *[alias for alias, *_ in leaves])
        met = slim.join(days, F.col("_fact_day").eqNullSafe(F.col("_day")))
        keys = [F.col(f"`{d.name}`") for d in dims]
        merged = [MERGE[kind](F.col(alias)).alias(alias) for alias, *_, kind in leaves]
        if not merged:
            return met.select(*keys).distinct()
        return met.groupBy(*keys).agg(*merged) if keys else met.agg(*merged)

    def finest(self, groups: dict, kept: dict, where, signs: dict) -> dict:
        """Context -> the aggregate that it is derived from: one for all contexts over the same rows, at the finest grain that they need.

        The aggregate has the leaves of all of them, and the values of a distinct count among its keys, so a total of such counts is
        taken from it too. Contexts over other rows, alone, over two date columns or with several distinct counts read the rows themselves.
        """
        scopes: dict[tuple, list[Context]] = {}
        for (c, special), leaves in groups.items():
            apart = [kind for *_, kind in leaves if kind not in MERGE]
            if not special and not self.crossed_tables(c) and all(kind in DISTINCT for kind in apart) and not (apart and c.time and not running_step(c)):
                scopes.setdefault((tuple(map(repr, self.filtered(where, c)[0])), c.role, c.semi), []).append(c)
        out = {}
        for contexts in scopes.values():
            leaves = {signs[leaf[0]]: leaf for c in contexts for leaf in groups[(c, False)]}
            counted = {sign for sign, leaf in leaves.items() if leaf[4] in DISTINCT}
            one_axis = len({c.axis for c in contexts if c.time}) < 2 and len({(sign[0], sign[2]) for sign in counted}) < 2
            stored = self.covering(contexts, leaves, kept, where) if leaves and one_axis else None
            if (len(contexts) > 1 or stored) and leaves and one_axis:
                alike = len({frozenset(signs[leaf[0]] for leaf in groups[(c, False)]) for c in contexts}) == 1
                shared = self.shared(contexts, leaves, kept, where, alike, stored)
                out |= dict.fromkeys(contexts, shared)
        return out

    def column_names(self, nodes: Sequence) -> set[str]:
        return {qualified(*c) for n in nodes for c in self.columns_of(n)}

    def covering(self, contexts: list[Context], leaves: dict, kept: dict, where):
        """The smallest stored aggregate that has all that these contexts read, if there is one."""
        c = contexts[0]
        if not self.root.stored or c.role or c.semi or self.join != "left" or self.joins:
            return None
        predicates, used = self.filtered(where, c)[0], set()
        for p in predicates:
            self.row(p, used)
        names = self.column_names(predicates) | {qualified(d.table, d.column) for c in contexts for d in kept[c]} | {qualified(*c.axis) for c in contexts if c.time}
        for sign, leaf in leaves.items():
            if leaf[4] in DISTINCT:
                names |= self.column_names([leaf[1].expression, *sign[2]])
                leaf[1].value(used)
        if any(not isinstance(u, str) for u in used):  # looked up elsewhere
            return None
        fit = [s for s in self.root.stored if s.fact.lower() == self.fact.name.lower() and s.has(names)]
        fit = [s for s in fit if all(leaf[4] in DISTINCT or s.leaf(self, sign, leaf[3]) is not None for sign, leaf in leaves.items())]
        return min(fit, key=lambda s: s.rows, default=None)

    def shared(self, contexts: list[Context], leaves: dict, kept: dict, where, alike: bool, stored=None) -> Shared:
        used: set = set()
        found = [self.row(p, used) for p in self.filtered(where, contexts[0])[0]]
        dims = list(dict.fromkeys(d for c in contexts for d in kept[c]))
        timed = next((c for c in contexts if c.time), None)
        keys = [self.period(d, used).alias(d.name) for d in dims]
        keys += [self.day(timed, used).alias("_fact_day")] if timed else []
        keys += [next(leaf[1].value(used) for leaf in leaves.values() if leaf[4] in DISTINCT).alias("_v")] if any(leaf[4] in DISTINCT for leaf in leaves.values()) else []
        names = {sign: f"_shared{k}" for k, (sign, leaf) in enumerate(leaves.items()) if leaf[4] in MERGE}
        if stored:
            aggregates = [stored.leaf(self, sign, leaves[sign][3]).alias(n) for sign, n in names.items()]
            rows = stored.frame
        else:
            aggregates = [leaves[sign][1](used).alias(n) for sign, n in names.items()]
            rows = self.frame(used, contexts[0].role, contexts[0].semi)
        for p in found:
            rows = rows.where(p)
        aggregates += [(F.sum("_rows") if stored else F.count(F.lit(1))).alias("_rows")]
        frame = rows.groupBy(*keys).agg(*aggregates) if keys else rows.agg(*aggregates)
        if keys and not (alike and names and not any(map(running_step, contexts))):
            # contexts read different columns, and filter days and values. A group has rows, which the optimizer can't know: what asks
            # for that, or else for the leaves, keeps the plan up to the exchange the same for all contexts, so that it runs once
            filled = F.col("_rows") > 0
            kept_all = filled | (F.xxhash64(*names.values()) == 0) if names else filled
            frame = frame.where(kept_all).withColumns({k: F.when(filled, F.col(k)) for k in ("_fact_day", "_v") if k in frame.columns}).drop("_rows")
        return Shared(frame, names, frozenset(d.name for d in dims), timed is not None)

    def derived(self, shared: Shared, dims: list[Dimension], leaves: list, where, context: Context, signs: dict) -> DataFrame:
        """A context's part of a shared aggregate."""
        frame = shared.frame
        own = [(alias, kind, F.col(shared.names[signs[alias]])) for alias, *_, kind in leaves if kind in MERGE]
        counted = [(alias, kind) for alias, *_, kind in leaves if kind in DISTINCT]
        if not context.time:
            keys = [F.col(f"`{d.name}`") for d in dims]
            if not shared.by_day and {d.name for d in dims} == shared.dims and "_v" not in frame.columns:
                return frame.select(*keys, *[c.alias(alias) for alias, _, c in own])
            merged = [MERGE[kind](c).alias(alias) for alias, kind, c in own] + [F.count_distinct("_v").alias(alias) for alias, _ in counted]
            if not merged:
                return frame.select(*keys).distinct()
            return frame.groupBy(*keys).agg(*merged) if keys else frame.agg(*merged)
        moving = [d for d in dims if self.on_axis(d, context)]
        others = [d.name for d in dims if d not in moving]
        day_keys = [F.col("_fact_day"), *[F.col(f"`{n}`") for n in others]]
        _, days = self.filtered(where, context)
        if running_step(context):
            merged = [MERGE[kind](c).alias(alias) for alias, kind, c in own]
            daily = frame.groupBy(*day_keys).agg(*merged) if merged else frame.select(*day_keys).distinct()
            firsts = [first_days(frame, F.col("_v"), day_keys[0], day_keys[1:], others, context, alias) for alias, _ in counted]
            return self.upto(daily, firsts, dims, others, leaves, days, context)
        slim = frame.select(*day_keys, *[c.alias(alias) for alias, _, c in own])
        return self.over_days(slim, dims, others, leaves, self.visible(moving, days, context))

    # --- days

    def day(self, context: Context, used: set) -> Column:
        used.add(context.axis[0].lower())
        return self.axis_value(context.axis)

    def is_date(self, axis: tuple) -> bool:
        """Whether an axis is of days: it is unless it holds numbers."""
        return not isinstance(self.load(axis[0]).schema[qualified(*axis)].dataType, NumericType)

    def axis_value(self, axis: tuple) -> Column:
        c = F.col(qualified(*axis))
        return c.cast("date") if self.is_date(axis) else c

    def calendar(self, axis: tuple) -> DataFrame:
        """The days of a date table; for a date column of the fact, all days of the years that it spans."""
        if axis[0] != self.fact.name or not self.is_date(axis):
            return self.load(axis[0])
        name = qualified(*axis)
        span = self.load(axis[0]).agg(F.trunc(F.min(name), "year").alias("a"), F.trunc(F.max(name), "year").alias("b"))
        return span.select(F.explode(F.sequence("a", F.date_sub(F.add_months("b", 12), 1))).alias(name))

    def visible(self, dims: list[Dimension], predicates: list, context: Context) -> DataFrame:
        """``_day`` of each group of the date dimensions, after the context's steps."""
        if not dims and not predicates and context.time[0][0] != "range":
            raise DaxError("another period needs a date dimension or a filter on dates")
        rows = self.calendar(context.axis)
        for p in predicates:
            rows = rows.where(self.row(p, set()))
        day = self.axis_value(context.axis)
        days = rows.select(*[self.period(d, set()).alias(d.name) for d in dims], day.alias("_day")).where("_day is not null")
        for step in context.time:
            days = self.ranged(days, [d.name for d in dims], step, context) if step[0] == "range" else moved(days, [d.name for d in dims], step, self.row)
        return days

    def ranged(self, days: DataFrame, names: list[str], step: tuple, context: Context) -> DataFrame:
        """The calendar's days for which an open condition holds, given the first and last visible day of each group."""
        _, (conditions, attributes), _ = step
        if not self.is_date(context.axis):
            raise DaxError("a condition over MAX and MIN of other values than dates can only be 'up to MAX'")
        whole = self.calendar(context.axis).select(self.axis_value(context.axis).alias("_at"), *[F.col(qualified(*c)).alias(n) for c, n in attributes]).where("_at is not null").distinct()
        keys = [F.col(f"`{n}`") for n in names]
        ends = [F.min("_day").alias("_low"), F.max("_day").alias("_high")]
        if attributes:
            days = days.join(whole, F.col("_day") == F.col("_at"))
            ends += [f(n).alias(f"{end}{n}") for _, n in attributes for f, end in ((F.min, "_least"), (F.max, "_most"))]
        span = days.groupBy(*keys).agg(*ends) if keys else days.agg(*ends)
        equal = None
        for c, n in attributes:
            for p in conditions:
                if isinstance(p, Bin) and p.op == "=" and p.left == Bound(n) and isinstance(p.right, Bound):
                    same = F.col(n) == F.col(p.right.name)
                    equal = same if equal is None else equal & same
        if equal is None:  # every day from the first to the last that the conditions allow
            reach = whole.agg(F.min("_at").alias("_begin"), F.max("_at").alias("_end"))
            bounds = lambda *ops: [self.row(p.right, set()).cast("date") for p in conditions if isinstance(p, Bin) and p.left == Bound("_at") and p.op in ops]
            lows, highs = bounds(">", ">=", "="), bounds("<", "<=", "=")
            span = span.crossJoin(F.broadcast(reach))  # one row
            span = span.withColumns({"_from": F.greatest("_begin", *lows) if lows else F.col("_begin"), "_till": F.least("_end", *highs) if highs else F.col("_end")})
            found = span.where("_from <= _till").withColumn("_at", F.explode(F.sequence("_from", "_till")))
            if attributes:
                found = found.join(whole, "_at")
        else:
            found = span.join(whole, equal)
        for p in conditions:
            found = found.where(self.row(p, set()))
        return found.select(*keys, F.col("_at").alias("_day")).distinct()

    # --- iterators and ranks

    def nest(self, dims: list[Dimension], leaf: tuple, where) -> DataFrame:
        alias, (function, table, expression, given), _, own, _ = leaf
        keys = [Dimension(f"_key{k}", *c) for k, c in enumerate(table.keys)]
        columns = {c: f"_key{k}" for k, c in enumerate(table.keys)}
        plan, named = Plan(), dict(table.names)
        compiled = lambda e: self.measure(self.bound(e, columns, named), own, plan)
        value, filters = compiled(expression), [compiled(p) for p in table.filters]
        tops = [(n, compiled(e), rising) for n, e, rising in table.tops]
        held = compiled(given) if given is not None else F.lit(None)
        inner = self.evaluate(dims, plan, where, own, keys).withColumns({"_value": value, "_given": held})
        for p in filters:
            inner = inner.where(p)
        outer = [F.col(f"`{d.name}`") for d in dims]
        for n, by, rising in tops:
            order = by.asc() if rising else by.desc_nulls_last()
            inner = inner.withColumn("_rank", F.rank().over(Window.partitionBy(*outer).orderBy(order))).where(F.col("_rank") <= n)
        out = function(F.col("_value")).alias(alias)
        return inner.groupBy(*outer).agg(out) if dims else inner.agg(out)

    def bound(self, node, columns: dict, named: dict):
        """The tree with references to inner keys and added columns replaced."""
        go = lambda n: self.bound(n, columns, named)
        if isinstance(node, Ref):
            if node.table is None and (name := node.name.lower()) in named:
                return self.bound(named[name], columns, {k: v for k, v in named.items() if k != name})  # by that name a measure is meant
            if self.is_column(node):
                at = self.resolve(node)[1]
                return Bound(columns[at]) if at in columns else node
            return node
        if isinstance(node, Call):
            if node.name in AGGREGATES | ITERATORS or node.name in ("DISTINCTCOUNT", "DISTINCTCOUNTNOBLANK", "COUNTROWS", "COUNTBLANK", "CALCULATE") or node.name in VIRTUAL:
                return node  # columns in there are not the row's own
            return Call(node.name, tuple(map(go, node.args)))
        if isinstance(node, Bin):
            return Bin(node.op, go(node.left), go(node.right))
        return Neg(go(node.value)) if isinstance(node, Neg) else node

    def rank_part(self, dims: list[Dimension], leaf: tuple, where) -> DataFrame:
        alias, (over, expression, rising, dense, every), _, own, _ = leaf
        ranked = [d for d in dims if {d.table.lower(), f"{d.table}[{d.column}]".lower()} & over]
        plan = Plan()
        value = self.measure(expression, own, plan)
        if every and where is not None:  # all values take part, whatever the filter shows
            left = [p for p in conjuncts(where) if not all(self.ignores(Dimension("", *self.resolve(n)[1]), Context(removed=over)) for n in walk(p) if isinstance(n, Ref))]
            where = None
            for p in left:
                where = p if where is None else Bin("&&", where, p)
        rows = self.evaluate(dims, plan, where, own).select(*[F.col(f"`{d.name}`") for d in dims], value.alias("_value"))
        within = [d.name for d in dims if d not in ranked]
        return with_rank(rows, "_value", within, dense, alias, rising).select(*[F.col(f"`{d.name}`") for d in dims], alias)

    def attach(self, out: DataFrame, part: DataFrame, dims: list[Dimension]) -> DataFrame:
        if not dims:
            return out.crossJoin(F.broadcast(part))  # one row: a total
        renamed = part.withColumnsRenamed({d.name: f"_right_{k}" for k, d in enumerate(dims)})
        on = None
        for k, d in enumerate(dims):
            same = F.col(f"`{d.name}`").eqNullSafe(F.col(f"_right_{k}"))
            on = same if on is None else on & same
        return out.join(renamed, on, "left").drop(*[f"_right_{k}" for k in range(len(dims))])

    # --- windows over a queried frame, and views

    def ranked(self, dims: Sequence[str], measure: str, within: Sequence[str] = (), dense: bool = True, name: str = "rank", where: str | None = None) -> DataFrame:
        return with_rank(self.query(dims, [measure], where), measure, within, dense, name)

    def top(self, dims: Sequence[str], measure: str, n: int, where: str | None = None) -> DataFrame:
        """The first ``n`` by the measure with all that tie with the last; each task keeps its own first ``n`` before they meet."""
        rank = F.rank().over(Window.partitionBy().orderBy(F.desc_nulls_last(f"`{measure}`")))
        return self.query(dims, [measure], where).withColumn("_rank", rank).where((F.col("_rank") <= n) & F.col(f"`{measure}`").isNotNull()).drop("_rank")

    def table(self, text: str, where: str | None = None) -> DataFrame:
        """A table expression as a frame: SUMMARIZECOLUMNS, SUMMARIZE, ADDCOLUMNS, CROSSJOIN, GENERATE, FILTER, TOPN over columns' values.

        Rows are the combinations that facts have; key columns bear the columns' names.
        """
        table = self.virtual(parse(text))
        keys = [Dimension(f"_key{k}", *c) for k, c in enumerate(table.keys)]
        columns, named, plan = {c: d.name for c, d in zip(table.keys, keys, strict=True)}, dict(table.names), Plan()
        compiled = lambda e: self.measure(self.bound(e, columns, named), Context(), plan)
        added = {n: compiled(e) for n, e in table.names}
        filters, tops = [compiled(p) for p in table.filters], [(n, compiled(e), rising) for n, e, rising in table.tops]
        rows = self.evaluate([], plan, parse(where) if where else None, keys=keys)
        for p in filters:
            rows = rows.where(p)
        for n, by, rising in tops:
            rows = rows.withColumn("_rank", F.rank().over(Window.partitionBy().orderBy(by.asc() if rising else by.desc_nulls_last()))).where(F.col("_rank") <= n)
        return rows.select(*[F.col(d.name).alias(d.column) for d in keys], *[c.alias(n) for n, c in added.items()])

    def register(self, spark, name: str, tables: Sequence[str] = ()) -> None:
        """Pass-through views for SQL users: the fact's own columns, or those of a wide view."""
        self.wide(tables).createOrReplaceTempView(name)

    def wide(self, tables: Sequence[str], prefix: bool = False) -> DataFrame:
        """Fact rows with all columns of the dimension tables; names that repeat are prefixed."""
        rows = self.frame({t.lower() for t in tables})
        taken: set[str] = set()
        out = []
        for c in rows.columns:
            short = c.split("__", 1)[1]
            name = c if prefix or short in taken else short
            taken.add(name)
            out.append(F.col(c).alias(name))
        return rows.select(*out)

    def calculation_item(self, item: str, measure: str) -> str:
        """The expression of a calculation item applied to a measure."""
        named = "[" + measure.replace("]", "]]") + "]"
        return re.sub(r"SELECTEDMEASURE\s*\(\s*\)", lambda _: named, self.items[item], flags=re.I)


def qualified(table: str, column: str) -> str:
    return f"{snake(table)}__{snake(column)}"


def stitched(parts: list[DataFrame], dims: list[str]) -> DataFrame:
    """Results of several tables side by side: one row for each group that any of them has."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if len(parts) == 1:
        return out
    leaves = [F.first(c, ignorenulls=True).alias(c) for c in out.columns if c not in dims]
    return out.groupBy(*[F.col(f"`{d}`") for d in dims]).agg(*leaves) if leaves else out.distinct()


def constant(node) -> object:
    if isinstance(node, Lit):
        return node.value
    if isinstance(node, Neg):
        return -constant(node.value)
    if isinstance(node, TableRef):
        return node.name.upper()
    raise DaxError("a constant is needed here")


def grained(c: Column, grain: str | None) -> Column:
    return {None: lambda: c, "date": lambda: c.cast("date"), "month": lambda: F.trunc(c, "month"), "quarter": lambda: F.trunc(c, "quarter"), "year": lambda: F.year(c)}[grain]()


#: The open condition under which running sums do: everything up to the last visible value of the axis.
UP_TO_LAST = ("range", ((Bin("<=", Bound("_at"), Bound("_high")),), ()), "DAY")


def running_step(context: Context) -> bool:
    """Whether the context's days are those up to the last visible one, of the same period or of all."""
    return len(context.time) == 1 and (context.time[0][0] == "to_date" or context.time[0] == UP_TO_LAST)


def period_of(context: Context, day: Column) -> list[Column]:
    kind, _, unit = context.time[0]
    return [first_of(day, unit).alias("_period")] if kind == "to_date" else []


def first_days(rows: DataFrame, value: Column, day: Column, keys: list[Column], names: list[str], context: Context, alias: str) -> DataFrame:
    """``alias``: how many values have their first day of the period, or ever, on each ``_fact_day`` of the keys."""
    slim = rows.select(value, day, *keys).where("_v is not null and _fact_day is not null")
    own = [F.col(f"`{n}`") for n in names]
    first = slim.groupBy("_v", *own, *period_of(context, F.col("_fact_day"))).agg(F.min("_fact_day").alias("_fact_day"))
    return first.groupBy("_fact_day", *own).agg(F.count(F.lit(1)).alias(alias))


def running_totals(rows: DataFrame, keys: list[str], order: str, whole: dict[str, Callable]) -> DataFrame:
    """Running aggregates of ``rows`` (one for each of the keys and ``order``) without a window over all of a key's rows.

    The axis is cut at 200 quantiles; aggregates run inside the parts, and what the parts before hold is added.
    """
    dealt = in_parts(rows, order)
    own = [F.col(f"`{k}`") for k in keys]
    parts = dealt.groupBy(*own, "_part").agg(*[f(a).alias(f"_all{a}") for a, f in whole.items()])
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[c.alias(f"_own{i}") for i, c in enumerate(own)], F.col("_part").alias("_of"), *[f(f"_all{a}").over(before).alias(f"_before{a}") for a, f in whole.items()])
    on = F.col("_part") == F.col("_of")
    for i, c in enumerate(own):
        on = on & c.eqNullSafe(F.col(f"_own{i}"))
    inside = Window.partitionBy(*own, "_part").orderBy(order)
    both = {F.sum: lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y), F.min: F.least, F.max: F.greatest}
    found = dealt.withColumns({a: f(a).over(inside) for a, f in whole.items()}).join(parts, on)
    return found.select(order, *own, *[both[f](F.col(a), F.col(f"_before{a}")).alias(a) for a, f in whole.items()])


def conjuncts(node) -> list:
    return [*conjuncts(node.left), *conjuncts(node.right)] if isinstance(node, Bin) and node.op == "&&" else [node]


def lookup_name(node: Call) -> str:
    return f"_lookup_{identifier(repr(node))}"


def stepped(day: Column, n: int, unit: str) -> Column:
    return F.date_add(day, n) if unit == "DAY" else F.add_months(day, n * MONTHS[unit])


def first_of(day: Column, unit: str) -> Column:
    return day if unit == "DAY" else F.trunc(day, unit)


def last_of(day: Column, unit: str) -> Column:
    return day if unit == "DAY" else F.date_sub(stepped(F.trunc(day, unit), 1, unit), 1)


def moved(days: DataFrame, names: list[str], step: tuple, row: Callable) -> DataFrame:
    """The days of each group after one step of a time function. A month's last day stands for the rest of its month."""
    kind, how, unit = step
    keys, day = [F.col(f"`{n}`") for n in names], F.col("_day")
    if kind == "shift":
        to = stepped(day, how, unit)
        if unit == "DAY":
            return days.select(*keys, to.alias("_day"))
        till = F.when(day == F.last_day(day), F.last_day(to)).otherwise(to)
        return days.select(*keys, F.explode(F.sequence(to, till)).alias("_day")).distinct()
    if kind == "parallel":
        begins = days.select(*keys, stepped(first_of(day, unit), how, unit).alias("_from")).distinct()
        return begins.select(*keys, F.explode(F.sequence("_from", last_of(F.col("_from"), unit))).alias("_day"))
    low, high = F.min("_day"), F.max("_day")
    if kind == "neighbour":
        at = stepped(first_of(low if how < 0 else high, unit), how, unit)
        low, high = at, last_of(at, unit)
    elif kind == "to_date":
        low = first_of(high, unit)
    elif kind == "edge":
        low = high = last_of(high, unit) if how else first_of(low, unit)
    else:
        at, n = how
        ends = {"MAX": high, "LASTDATE": high, "MIN": low, "FIRSTDATE": low}
        anchor = ends[at.name] if isinstance(at, Call) and at.name in ends else row(at, set())
        away = stepped(anchor, n, unit)
        if unit != "DAY":
            away = F.when(anchor == F.last_day(anchor), F.last_day(away)).otherwise(away) if n < 0 else away
        low, high = (F.date_add(away, 1), anchor) if n < 0 else (anchor, F.date_sub(away, 1))
    span = days.groupBy(*keys).agg(low.alias("_low"), high.alias("_high")) if keys else days.agg(low.alias("_low"), high.alias("_high"))
    return span.where("_low <= _high").select(*keys, F.explode(F.sequence("_low", "_high")).alias("_day"))


def related(r: Relationship) -> Column:
    return F.col(qualified(r.from_table, r.from_column)) == F.col(qualified(r.to_table, r.to_column))


def with_rank(rows: DataFrame, value: str, within: Sequence[str], dense: bool, name: str, rising: bool = False) -> DataFrame:
    """Ranks by a value, the largest first unless ``rising``; nulls come last.

    Without columns to rank within, all rows would meet in one task. So the different values are counted, dealt out by their
    quantiles, and ranked inside of these; what comes before each part is added. The rows are settled first: sums of doubles taken twice
    may differ in their last bits, and then neither meet their ranks nor lie in the same part.
    """
    v = F.col(f"`{value}`")
    order = v.asc_nulls_last() if rising else v.desc_nulls_last()
    if within:
        rank = F.dense_rank() if dense else F.rank()
        return rows.withColumn(name, rank.over(Window.partitionBy(*[F.col(f"`{w}`") for w in within]).orderBy(order)))
    rows = settled(rows, parts=None)
    values = rows.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    marks = values.agg(F.percentile_approx(F.col("_v").cast("double"), [k / 200 for k in range(1, 200)], 2000).alias("_marks"))
    below = F.size(F.filter(F.coalesce("_marks", F.array().cast("array<double>")), lambda m: m < F.col("_v").cast("double")))
    part = F.when(F.col("_v").isNull(), 1000).otherwise(below if rising else -below)
    dealt = values.crossJoin(F.broadcast(marks)).withColumn("_part", part).drop("_marks")  # one row of 199 marks
    size = F.count(F.lit(1)) if dense else F.sum("_n")
    before = dealt.groupBy("_part").agg(size.alias("_size"))  # 201 rows at most
    before = before.select("_part", F.coalesce(F.sum("_size").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    step = F.lit(1) if dense else F.col("_n")
    local = Window.partitionBy("_part").orderBy(F.col("_v").asc_nulls_last() if rising else F.col("_v").desc_nulls_last())
    ranks = dealt.withColumn("_inside", F.coalesce(F.sum(step).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = ranks.join(F.broadcast(before), "_part").select("_v", (F.col("_inside") + F.col("_before") + 1).cast("int").alias(name))
    return rows.join(ranks, v.eqNullSafe(F.col("_v"))).drop("_v")
