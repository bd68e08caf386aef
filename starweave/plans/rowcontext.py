"""Calculated columns with nested row contexts: ``SUMX(FILTER(T, T[k] = EARLIER(T[k]) && T[x] <= EARLIER(T[x])), T[v])``.

The nested rows are never paired with the outer ones. Equalities with EARLIER become keys; one comparison becomes a running aggregate
along its order: the nested rows' values, aggregated by different places, and the outer rows pass through one window. Keys of more than
``MANY`` rows are cut in parts by quantiles, plus what comes before each part, so no window holds such a key whole. Aggregates over the
same rows share all this. Conditions over the nested row alone filter it. Other forms are rejected with their reason.

Blanks: a comparison with null holds for no row. Where no nested row is left, counts are 0 and the other aggregates null.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.operators.scoring import settled
from starweave.plans.dax import Bin, Call, DaxError, Lit, Neg, Ref, TableRef, parse, walk
from starweave.plans.metricview import Bound, MetricView, conjuncts

TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
PARTIAL = {
    "COUNTROWS": {"n": F.count}, "COUNTX": {"n": F.count}, "SUMX": {"s": F.sum}, "AVERAGEX": {"s": F.sum, "n": F.count}, "MINX": {"s": F.min}, "MAXX": {"s": F.max},
}
#: Keys with more rows than this are cut in as many parts as ``PARTS``.
MANY, PARTS = 100_000, 200
MERGED = {"COUNTROWS": F.sum, "COUNTX": F.sum, "SUMX": F.sum, "AVERAGEX": F.sum, "MINX": F.min, "MAXX": F.max}


def is_nested(node) -> bool:
    return any(isinstance(n, Call) and n.name in ("EARLIER", "EARLIEST") for n in walk(node))


def outer_side(node):
    """An expression over the outer row alone, without its EARLIER; or null."""
    refs = [n for n in walk(node) if isinstance(n, Ref)]
    inside = [n for e in walk(node) if isinstance(e, Call) and e.name in ("EARLIER", "EARLIEST") for n in walk(e) if isinstance(n, Ref)]
    if not inside or len(refs) != len(inside):
        return None

    def bare(n):
        if isinstance(n, Call) and n.name in ("EARLIER", "EARLIEST"):
            if len(n.args) > 1 and n.args[1] != Lit(1):
                raise DaxError("EARLIER over more than one level")
            return n.args[0]
        return changed(n, bare)

    return bare(node)


def changed(node, f):
    """The node with its children replaced."""
    if isinstance(node, Bin):
        return replace(node, left=f(node.left), right=f(node.right))
    if isinstance(node, Neg):
        return Neg(f(node.value))
    if isinstance(node, Call):
        return Call(node.name, tuple(map(f, node.args)))
    return node


def calculated(view: MetricView, table: str, columns: dict[str, str]) -> DataFrame:
    """The rows of a table, columns named ``table__column``, with calculated columns."""
    here = view.at(table.lower()) if table.lower() != view.root.fact.name.lower() else view.root
    rows = here.load(here.fact.name)
    found: dict = {}  # the aggregates of each set of nested rows

    def put(node):
        if isinstance(node, Call) and node.name in PARTIAL and is_nested(node):
            of = found.setdefault(repr(node.args[0]), {})
            return Bound(of.setdefault(repr(node), (f"_nested{sum(map(len, found.values()))}", node))[0])
        return changed(node, put)

    trees = {name: put(parse(text)) for name, text in columns.items()}
    for of in found.values():
        rows = nested(here, rows, dict(of.values()))
    for name, tree in trees.items():
        used: set = set()
        if is_nested(tree):
            raise DaxError("EARLIER outside of an aggregate over FILTER of the own table")
        value = here.row(tree, used)
        if used - {here.fact.name.lower()}:
            raise DaxError(f"a calculated column reads other tables: {sorted(map(str, used))}")
        rows = rows.withColumn(name, value)
    return rows.drop(*[name for of in found.values() for name, _ in of.values()])


def nested(view: MetricView, rows: DataFrame, nodes: dict[str, Call]) -> DataFrame:
    """Adds aggregates, by their names, of the nested rows that each row sees. All of them are over the same FILTER."""
    source = next(iter(nodes.values())).args[0]
    if not (isinstance(source, Call) and source.name == "FILTER" and isinstance(source.args[0], TableRef) and source.args[0].name.lower() == view.fact.name.lower()):
        raise DaxError("EARLIER needs an aggregate over FILTER of the own table")
    equal, ranges, plain = [], [], []
    for p in conjuncts(source.args[1]):
        if not is_nested(p):
            plain.append(p)
            continue
        if not (isinstance(p, Bin) and p.op in TURNED):
            raise DaxError("EARLIER in a condition other than =, <, <=, > or >=")
        op, inner, outer = (p.op, p.left, outer_side(p.right)) if is_nested(p.right) else (TURNED[p.op], p.right, outer_side(p.left))
        if outer is None or is_nested(inner):
            raise DaxError("EARLIER mixed with columns of the nested row on one side")
        (equal if op == "=" else ranges).append((op, inner, outer))
    if len(ranges) > 1:
        raise DaxError("more than one order with EARLIER")
    if any(len(node.args) > 1 and is_nested(node.args[1]) for node in nodes.values()):
        raise DaxError("EARLIER in what is aggregated")
    column = lambda n: view.row(n, set())
    groups = [*[f"_key{i}" for i in range(len(equal))], *(["_at"] if ranges else [])]
    inner = view.load(view.fact.name)
    for p in plain:
        inner = inner.where(column(p))
    values = {name: F.lit(1) if node.name == "COUNTROWS" else column(node.args[1]) for name, node in nodes.items()}
    inner = inner.select(*[column(i).alias(g) for g, (_, i, _) in zip(groups, [*equal, *ranges], strict=True)], *[v.alias(f"{n}_value") for n, v in values.items()]).dropna(subset=groups)
    partial = {f"{name}_{p}": f(f"{name}_value") for name, node in nodes.items() for p, f in PARTIAL[node.name].items()}
    merged = {f"{name}_{p}": MERGED[node.name] for name, node in nodes.items() for p in PARTIAL[node.name]}
    parts = inner.groupBy(*groups).agg(*[c.alias(p) for p, c in partial.items()])
    outer = {g: column(o) for g, (_, _, o) in zip(groups, [*equal, *ranges], strict=True)}
    if ranges:
        asked = view.load(view.fact.name).select(*[o.alias(g) for g, o in outer.items()]).dropna()
        found = running(rows.withColumns(outer), parts, inner.select(*groups).unionByName(asked), groups[:-1], ranges[0][0], merged)
    elif groups:
        same = F.lit(True)
        for g, o in outer.items():
            same = same & (o == F.col(g))
        found = rows.join(parts, same, "left")
    else:
        found = rows.crossJoin(F.broadcast(parts))  # one row
    result = {"COUNTROWS": lambda n: F.coalesce(f"{n}_n", F.lit(0)), "COUNTX": lambda n: F.coalesce(f"{n}_n", F.lit(0)), "AVERAGEX": lambda n: F.try_divide(f"{n}_s", f"{n}_n")}
    own = [result.get(node.name, lambda n: F.col(f"{n}_s"))(n).alias(n) for n, node in nodes.items()]
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *own)


def running(rows: DataFrame, parts: DataFrame, places: DataFrame, keys: list[str], op: str, merged: dict) -> DataFrame:
    """``rows`` with the merged ``parts`` of the same keys whose _at compares by ``op`` with theirs; null keys or places see none.

    ``places`` has the keys and _at of all nested and outer rows; it shows which keys have many.
    """
    way = F.desc if op in (">", ">=") else F.asc
    # among equals, what is asked comes after the parts if they count, else before
    first = 0 if op in ("<=", ">=") else 2
    many = settled(places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > MANY), parts=None)  # few
    cut = not many.isEmpty()
    if cut:
        wide = [F.col(k).alias(f"{k}_many") for k in keys]
        large = lambda frame: frame.join(F.broadcast(many.select(*wide, F.lit(True).alias("_many"))), all_equal(keys, [f"{k}_many" for k in keys]), "left").drop(*[f"{k}_many" for k in keys])
        quantiles = F.percentile_approx("_at", [k / PARTS for k in range(1, PARTS)], 10 * PARTS)
        marks = settled(large(places).where("_many").agg(quantiles.alias("_marks")), parts=None)  # one row
        part = F.when(F.col("_many"), 1 + F.coalesce(F.size(F.filter("_marks", lambda m: m < F.col("_at"))), F.lit(0))).otherwise(0)
        dealt = lambda frame: large(frame).crossJoin(F.broadcast(marks)).withColumn("_part", part).drop("_many", "_marks")
    else:
        dealt = lambda frame: frame.withColumn("_part", F.lit(0))
    blank = F.col("_at").isNull()
    for k in keys:
        blank = blank | F.col(k).isNull()
    # rows that see nothing are dealt out by what they hold, so that they don't meet in one window
    apart = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(10_000)).cast("int")
    asked = dealt(rows).withColumn("_part", F.when(blank, apart).otherwise(F.col("_part"))).withColumn("_kind", F.lit(1))
    own = dealt(parts)
    both = asked.unionByName(own.withColumn("_kind", F.lit(first)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_part").orderBy(way("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select(*[F.col(f"`{c}`") for c in rows.columns], "_part", "_kind", *[f(p).over(inside).alias(p) for p, f in merged.items()]).where("_kind = 1")
    if not cut:
        return seen
    # what comes before each part of a key of many rows, also of parts without nested rows
    earlier = Window.partitionBy(*keys).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    spine = many.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(PARTS))).alias("_part"))
    sums = own.where("_part > 0").select(*keys, "_part", *merged).unionByName(spine, allowMissingColumns=True).groupBy(*keys, "_part").agg(*[f(p).alias(p) for p, f in merged.items()])
    before = sums.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("_part").alias("_of"), *[f(p).over(earlier).alias(f"_before{p}") for p, f in merged.items()])
    met = seen.join(before, all_equal([*keys, "_part"], [*[f"{k}_of" for k in keys], "_of"]), "left")
    both_of = {F.sum: lambda p: F.coalesce(F.col(p) + F.col(f"_before{p}"), p, f"_before{p}"), F.min: lambda p: F.least(p, f"_before{p}"), F.max: lambda p: F.greatest(p, f"_before{p}")}
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[both_of[f](p).alias(p) for p, f in merged.items()])


def all_equal(left: list[str], right: list[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & (F.col(a) == F.col(b))
    return same
