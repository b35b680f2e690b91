"""SPARQL algebra to DataFrames over the quad table.

A solution is a row with a column for each variable, holding a term as one string (an IRI as it is; a literal from its quote on, with
datatype or language), null where unbound. Term equality is string equality, so patterns are equi-joins. A pattern outside
GRAPH sees the default graph, which is empty. Constants become filters on the raw columns, before terms are formed, so they reach the
scan. Patterns of a group are ordered: connected ones first, most constants first. A filter ?v = constant || ?v = ?w
becomes a join by equality, not a nested loop. Sides that share only variables that may be unbound are split into bound and unbound rows,
so what can be joined by equality is; unbound rows, which fit any row, are alone joined with all. MINUS takes away only what shares a
bound variable. EXISTS whose inner expressions name outer variables starts from the distinct outer bindings, under a key by which the
outer rows are then chosen. If it holds patterns and filters only, its patterns are parted where they share outer variables only: a part is
joined by equality, and a comparison with it is decided by the least and greatest of its values, so rows aren't paired. Otherwise each of its
groups starts from the outer bindings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import STRING, XSD
from ..operators.closure import closure
from .parser import Bgp, Const, Node, Path, Select, SparqlError, Var, parse

KEY = "_key"  # how the names of seeds' keys begin
NUMBERS = [XSD + x for x in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]


@dataclass
class Rel:
    """Solutions; sure: variables bound in every row, maybe: in some."""

    df: DataFrame
    sure: set[str]
    maybe: set[str]

    @property
    def all(self) -> set[str]:
        return self.sure | self.maybe


def lexical(t: Column) -> Column:
    return F.when(t.startswith('"'), F.substr(t, F.lit(2), F.char_length(t) - F.locate('"', F.reverse(t)) - 1)).otherwise(t)


def tail(t: Column) -> Column:
    """What stands after a literal's last quote: ^^datatype or @language."""
    return F.when(t.startswith('"'), F.substring_index(t, '"', -1))


def number(t: Column) -> Column:
    return F.when(tail(t).isin(*["^^" + n for n in NUMBERS]), lexical(t).try_cast("double"))


def as_literal(c: Column, datatype: str = STRING) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"^^' + datatype))


def number_literal(c: Column) -> Column:
    """A number as a term: whole ones as integers."""
    whole = c == F.floor(c)
    return F.when(whole & (F.abs(c) < 1e15), as_literal(c.cast("long"), XSD + "integer")).otherwise(as_literal(c, XSD + "decimal"))


def comparable(t: Column) -> Column:
    """A value that's equal where terms are equal by =: numbers by value, others as they are."""
    return F.when(t.isNotNull(), F.struct(number(t).isNull().alias("other"), F.coalesce(number(t), F.lit(0.0)).alias("number"), F.when(number(t).isNull(), t).otherwise("").alias("term")))


class Compiler:
    def __init__(self, quads: DataFrame):
        self.quads, self.spark, self.n = quads, quads.sparkSession, 0
        self.seeds: list[Rel | None] = [None]  # what the groups of the innermost EXISTS start from
        obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), "o", F.lit('"'), F.coalesce(F.concat(F.lit("@"), "o_lang"), F.concat(F.lit("^^"), F.coalesce("o_dt", F.lit(STRING)))))).otherwise(F.col("o"))
        self.object = obj

    # --- scans and paths

    def scan(self, graph, s, p, o) -> DataFrame:
        """g, s, p, o terms of the quads that fit the constants."""
        df = self.quads
        for c, t in (("g", graph), ("s", s), ("p", p)):
            if isinstance(t, Const):
                df = df.filter(F.col(c) == t.term)
        if isinstance(o, Const):
            if o.term.startswith('"'):
                text, rest = o.term[1:].rsplit('"', 1)
                df = df.filter((F.col("o") == text) & (F.col("o_kind") == "literal"))
                df = df.filter(F.col("o_lang") == rest[1:]) if rest.startswith("@") else df.filter(F.coalesce("o_dt", F.lit(STRING)) == rest[2:]).filter("o_lang IS NULL")
            else:
                df = df.filter((F.col("o") == o.term) & (F.col("o_kind") != "literal"))
        return df.select("g", "s", "p", self.object.alias("o"))

    def path(self, p, graph, s=None, o=None) -> DataFrame:
        """(g, s, o) pairs of a path within each graph; s, o: constants known at the ends."""
        if isinstance(p, Const):
            return self.scan(graph, s, p, o).select("g", "s", "o").distinct()
        if p.op == "iri":
            return self.path(p.args[0], graph, s, o)
        if p.op == "^":
            inner = self.path(p.args[0], graph, o, s)
            return inner.select("g", F.col("o").alias("s"), F.col("s").alias("o"))
        if p.op == "/":
            a = self.path(p.args[0], graph, s, None).withColumnRenamed("o", "_m")
            b = self.path(p.args[1], graph, None, o).withColumnRenamed("s", "_m")
            return a.join(b, ["g", "_m"]).select("g", "s", "o")
        if p.op == "|":
            return self.path(p.args[0], graph, s, o).unionByName(self.path(p.args[1], graph, s, o))
        if p.op == "!":
            return self.scan(graph, s, None, o).filter(~F.col("p").isin(*p.args)).select("g", "s", "o")
        if p.op in ("+", "*"):
            edges = self.path(p.args[0], graph)
            if isinstance(o, Const) and not isinstance(s, Const):
                turned = edges.select("g", F.col("o").alias("s"), F.col("s").alias("o"))
                pairs = closure(turned, turned.filter(F.col("s") == o.term), "g").select("g", F.col("o").alias("s"), F.col("s").alias("o"))
            else:
                pairs = closure(edges, edges.filter(F.col("s") == s.term) if isinstance(s, Const) else None, "g").select("g", "s", "o")
        else:
            pairs = self.path(p.args[0], graph, s, o)
        if p.op in ("*", "?"):
            every = self.scan(graph, None, None, None)
            nodes = every.select("g", F.col("s").alias("n")).unionByName(every.select("g", F.col("o").alias("n"))).distinct()
            for end in (s, o):
                if isinstance(end, Const):
                    nodes = nodes.unionByName(every.select("g", F.lit(end.term).alias("n"))).distinct()
            pairs = pairs.unionByName(nodes.select("g", F.col("n").alias("s"), F.col("n").alias("o")))
        return pairs.distinct()

    def pattern(self, s, p, o, graph) -> Rel:
        terms = {"s": s, "o": o, "g": graph}
        if isinstance(p, Path):
            df = self.path(p, graph, s if isinstance(s, Const) else None, o if isinstance(o, Const) else None)
            for c, t in (("s", s), ("o", o)):
                if isinstance(t, Const):
                    df = df.filter(F.col(c) == t.term)
        else:
            df = self.scan(graph, s, p, o)
            terms["p"] = p
        columns: dict[str, str] = {}
        for c, t in terms.items():
            if isinstance(t, Var):
                if t.name in columns:
                    df = df.filter(F.col(columns[t.name]) == F.col(c))
                else:
                    columns[t.name] = c
        df = df.select(*[F.col(c).alias(v) for v, c in columns.items()]) if columns else df.select(F.lit(1).alias("_one"))
        return Rel(df, set(columns), set())

    def bgp(self, patterns: list, graph) -> Rel:
        if graph is None:  # the default graph is empty
            names = {t.name for x in patterns for t in x if isinstance(t, Var)}
            return Rel(self.spark.createDataFrame([], ", ".join(f"`{v}` string" for v in sorted(names)) or "_one int"), names, set())
        out = None
        for rel in self.parts([(x, graph) for x in patterns], set()):
            out = rel if out is None else self.join(out, rel)
        return out

    def parts(self, patterns: list, outer: set[str]) -> list[Rel]:
        """The solutions of patterns (pattern, graph), apart for those that share no variables but the outer ones."""
        left, out = list(patterns), []
        weight = lambda x: sum(isinstance(t, Const) * w for t, w in zip(x[0], (4, 1, 3), strict=True))
        while left:
            rel = None
            while linked := [x for x in left if rel is None or _variables(x) & (rel.all - outer)]:
                best = max(linked, key=lambda x: (weight(x), -left.index(x)))
                left.remove(best)
                one = self.pattern(*best[0], best[1])
                rel = one if rel is None else self.join(rel, one)
            out.append(rel)
        return out

    # --- joins

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("_one")), set(), set())

    def join(self, a: Rel, b: Rel, how: str = "inner", cond: Callable[[DataFrame, Rel], Column] | None = None) -> Rel:
        """Compatible rows; how: inner, left, semi, anti, or minus (anti, of rows that share a bound variable)."""
        shared = a.all & b.all
        visible = {v for v in shared if not v.startswith(KEY)}
        if how == "minus":
            if not visible:
                return a
            if not visible & a.sure & b.sure:  # no variable that surely is bound on both sides
                return self.split(a, b, visible, "minus")
            how = "anti"
        elif shared and not shared & a.sure & b.sure:
            if how == "left":  # the matches, and the rows without one
                both = self.join(a, b, "inner", cond)
                alone = self.join(a, b, "anti", cond)
                every = sorted(both.all)
                df = both.df.select(*every).unionByName(alone.df.select(*[F.col(v) if v in a.all else F.lit(None).cast("string").alias(v) for v in every]))
                return Rel(df, a.sure, both.all - a.sure)
            return self.split(a, b, shared, how, cond)
        return self.joined(a, b, how, cond)

    def split(self, a: Rel, b: Rel, shared: set[str], how: str, cond=None) -> Rel:
        """A join by parts: the rows of one side in which a shared variable is bound, and those in which it isn't."""
        mine = sorted(shared & a.maybe)
        v, of = (mine[0], a) if mine else (sorted(shared & b.maybe)[0], b)
        bound = Rel(of.df.filter(F.col(v).isNotNull()), of.sure | {v}, of.maybe - {v})
        free = Rel(of.df.filter(F.col(v).isNull()).drop(v), of.sure, of.maybe - {v})
        if of is b and how in ("anti", "minus"):
            return self.join(self.join(a, bound, how, cond), free, how, cond)
        if of is b and how == "semi":
            yes = self.join(a, bound, "semi", cond)
            return self.together([yes, self.join(self.join(a, bound, "anti", cond), free, "semi", cond)])
        parts = [self.join(x, b, how, cond) if of is a else self.join(a, x, how, cond) for x in (bound, free)]
        return self.together(parts)

    def together(self, sides: list[Rel]) -> Rel:
        every, sure = set().union(*(s.all for s in sides)), set.intersection(*(s.sure for s in sides))
        df = None
        for s in sides:
            own = s.df.select(*[F.col(v) if v in s.all else F.lit(None).cast("string").alias(v) for v in sorted(every)]) if every else s.df
            df = own if df is None else df.unionByName(own)
        return Rel(df, sure, every - sure)

    def joined(self, a: Rel, b: Rel, how: str, cond) -> Rel:
        shared = sorted(a.all & b.all)
        drop = lambda df: df.drop("_one")
        left, right = a.df, drop(b.df)
        names = {v: f"_r_{v}" for v in shared}
        right = right.withColumnsRenamed(names)
        on = F.lit(True)
        for v in shared:
            same = F.col(v) == F.col(names[v])
            if v in a.maybe:
                same = same | F.col(v).isNull()
            if v in b.maybe:
                same = same | F.col(names[v]).isNull()
            on = on & same
        if not b.all - set(shared) and not shared:
            right = b.df.withColumnRenamed("_one", "_other")
        if cond is not None:
            both = Rel(left, a.sure | b.sure, a.maybe | b.maybe)
            on = on & F.coalesce(cond(None, both), F.lit(False))
        if how in ("semi", "anti"):
            out = left.join(right, on, f"left_{how}")
            return Rel(out, a.sure, a.maybe)
        out = left.join(right, on, "left" if how == "left" else "inner")
        columns = [F.coalesce(F.col(v), F.col(names[v])).alias(v) if v in shared and v in a.maybe else F.col(v) for v in sorted(a.all)] + [F.col(v) for v in sorted(b.all - a.all)]
        out = out.select(*columns) if columns else out.select(F.lit(1).alias("_one"))
        if how == "left":
            return Rel(out, a.sure, (a.maybe | b.all) - a.sure)
        sure = a.sure | b.sure
        return Rel(out, sure, (a.maybe | b.maybe) - sure)

    # --- groups

    def group(self, parts: list, graph) -> Rel:
        out: Rel | None = self.seeds[-1]
        filters = [x.args[0] for x in parts if isinstance(x, Node) and x.op == "filter"]
        thetas = [(e, x) for e in filters if (x := _choice(e))]
        waiting = thetas

        def joined(a: Rel, b: Rel) -> Rel:
            nonlocal waiting
            a, b, waiting = self.widened(a, b, waiting)
            return self.join(a, b)

        for x in parts:
            if isinstance(x, Node) and x.op == "filter":
                continue
            base = out or self.unit()
            if isinstance(x, Bgp):
                rels = [self.bgp(x.patterns, graph)] if graph is None else self.parts([(y, graph) for y in x.patterns], set())
                while rels:
                    rel = next((r for r in rels if out and r.all & out.all), rels[0])
                    rels = [r for r in rels if r is not rel]
                    out = rel if out is None else joined(out, rel)
            elif x.op == "optional":
                inner = x.args[0].args[0]
                conds = [y.args[0] for y in inner if isinstance(y, Node) and y.op == "filter"] if x.args[0].op == "group" else []
                plain = [c for c in conds if not _nested(c)]
                body = Node("group", ([y for y in inner if not (isinstance(y, Node) and y.op == "filter" and y.args[0] in plain)],)) if x.args[0].op == "group" else x.args[0]
                rel = self.eval(body, graph)

                def cond(_, both, plain=plain):
                    c = F.lit(True)
                    for e in plain:
                        c = c & F.coalesce(self.truth(e, both), F.lit(False))
                    return c

                out = self.join(base, rel, "left", cond if plain else None)
            elif x.op == "minus":
                rel = self.eval(x.args[0], graph)
                out = self.join(base, rel, "minus")
            elif x.op == "bind":
                name, e = x.args
                if name in base.all:
                    raise SparqlError(f"?{name} is bound already")
                out = Rel(base.df.withColumn(name, self.term(e, base)), base.sure, base.maybe | {name})
            else:
                rel = self.eval(x, graph)
                out = rel if out is None else joined(out, rel)
        out = out or self.unit()
        done = [e for e, _ in thetas if all(e is not f for f, _ in waiting)]
        for e in filters:
            if all(e is not f for f in done):
                out = self.filter(out, e, graph)
        return out

    def filter(self, rel: Rel, e, graph) -> Rel:
        if isinstance(e, Node) and e.op in ("exists", "not exists"):
            how = "semi" if e.op == "exists" else "anti"
            if not _correlated(e.args[0]) & rel.all:
                return self.join(rel, self.unseeded(e.args[0], graph), how)
            names, key = sorted(_names(e.args[0]) & rel.all), f"{KEY}{len(self.seeds)}"
            keyed = rel.df.withColumn(key, F.to_json(F.struct(*[F.col(v) for v in names])))
            seed = Rel(keyed.select(key, *names).distinct(), (rel.sure & set(names)) | {key}, rel.maybe & set(names))
            found = self.supported(seed, e.args[0], graph)
            if found is None:
                self.seeds.append(seed)
                try:
                    found = self.eval(e.args[0], graph)
                finally:
                    self.seeds.pop()
            out = self.joined(Rel(keyed, rel.sure | {key}, rel.maybe), Rel(found.df.select(key).distinct(), {key}, set()), how, None)
            return Rel(out.df.drop(key), rel.sure, rel.maybe)
        if isinstance(e, Node) and e.op == "&&":
            return self.filter(self.filter(rel, e.args[0], graph), e.args[1], graph)
        return Rel(rel.df.filter(F.coalesce(self.truth(e, rel), F.lit(False))), rel.sure, rel.maybe)

    def supported(self, seed: Rel, x, graph) -> Rel | None:
        """The outer bindings for which a conjunction of patterns and conditions has a solution; None if x is something else."""
        outer = {v for v in seed.all if not v.startswith(KEY)}
        flat = _conjunction(x, graph, outer)
        if flat is None or any(g is None for _, g in flat[0]) or seed.maybe & set().union(*(_variables(y) for y in flat[0])):
            return None
        parts, conds = self.parts(flat[0], outer), flat[1]
        for k, rel in enumerate(parts):
            for e in conds:
                if _names(e) and _names(e) <= rel.all:
                    parts[k] = rel = self.filter(rel, e, graph)
        conds = [e for e in conds if not _names(e) or not any(_names(e) <= rel.all for rel in parts)]
        while True:
            for e in [e for e in conds if _names(e) <= seed.all]:
                seed = self.filter(seed, e, graph)
            conds = [e for e in conds if not _names(e) <= seed.all]
            if not parts:
                return seed
            own = [(rel, [e for e in conds if _names(e) & (rel.all - seed.all)]) for rel in parts]
            if ready := [(rel, mine) for rel, mine in own if all(_names(e) <= rel.all | seed.all for e in mine)]:
                rel, mine = ready[0]
                seed = self.having(seed, rel, mine)
                conds = [e for e in conds if all(e is not y for y in mine)]
            else:  # a condition ties parts: one becomes outer for the others
                rel = next((r for r in parts if r.all & seed.all), parts[0])
                seed = self.join(seed, rel)
            parts = [r for r in parts if r is not rel]

    def having(self, a: Rel, b: Rel, conds: list) -> Rel:
        """The rows of a for which one of b agrees in the shared variables and meets conds, which name variables of both. Equalities are keys. A
        single comparison beside them is decided by the least and greatest of b's values for each key; more are tried pair by pair."""
        if not conds:
            return self.join(a, b, "semi")
        shared, equal, others = sorted(a.all & b.all), [], []
        for e in conds:
            sides = _sides(e, a.all, b.all)
            (equal if sides and sides[0] == "=" else others).append((e, sides))
        left = a.df.withColumns({f"_a{k}": comparable(self.term(s[1], a)) for k, (_, s) in enumerate(equal)})
        right = b.df.withColumns({f"_b{k}": comparable(self.term(s[2], b)) for k, (_, s) in enumerate(equal)})
        keys = [F.col(v).alias(f"_r_{v}") for v in shared] + [F.col(f"_b{k}") for k in range(len(equal))]
        on = F.lit(True)
        for v in shared:
            on = on & (F.col(v) == F.col(f"_r_{v}"))
        for k in range(len(equal)):
            on = on & (F.col(f"_a{k}") == F.col(f"_b{k}"))
        if not others:
            right = right.select(*keys).distinct()
        elif len(others) == 1 and others[0][1]:
            op, mine, its = others[0][1]
            x, y = self.term(its, b), self.term(mine, a)
            plain = lambda t: F.when(number(t).isNull() & t.startswith('"'), lexical(t))
            if op == "!=":
                right = right.groupBy(*keys).agg(F.min(comparable(x)).alias("_least"), F.max(comparable(x)).alias("_most"))
                met = (F.col("_least") != comparable(y)) | (F.col("_most") != comparable(y))
            else:
                best, of = {"<": (F.max, lambda p, q: p < q), "<=": (F.max, lambda p, q: p <= q), ">": (F.min, lambda p, q: p > q), ">=": (F.min, lambda p, q: p >= q)}[op]
                right = right.groupBy(*keys).agg(best(number(x)).alias("_number"), best(plain(x)).alias("_text"))
                met = F.coalesce(of(number(y), F.col("_number")), F.lit(False)) | F.coalesce(of(plain(y), F.col("_text")), F.lit(False))
            on = on & F.coalesce(met, F.lit(False))
        else:
            both = Rel(left, a.sure | b.sure, a.maybe | b.maybe)
            right = right.select(*keys, *sorted(b.all - a.all))
            for e, _ in others:
                on = on & F.coalesce(self.truth(e, both), F.lit(False))
        return Rel(left.join(right, on, "left_semi").select(*a.df.columns), a.sure, a.maybe)

    def unseeded(self, x, graph) -> Rel:
        self.seeds.append(None)
        try:
            return self.select(x, graph) if isinstance(x, Select) else self.eval(x, graph)
        finally:
            self.seeds.pop()

    def eval(self, x, graph) -> Rel:
        if isinstance(x, Bgp):
            return self.bgp(x.patterns, graph)
        if x.op == "group":
            return self.group(x.args[0], graph)
        if x.op == "graph":
            return self.eval(x.args[1], x.args[0])
        if x.op == "union":
            return self.together([self.eval(y, graph) for y in x.args[0]])
        if x.op == "values":
            names, rows = x.args
            maybe = {n for k, n in enumerate(names) if any(r[k] is None for r in rows)}
            return Rel(self.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in names)), set(names) - maybe, maybe)
        if x.op == "select":
            return self.unseeded(x.args[0], graph)
        raise SparqlError(f"{x.op} isn't supported here")

    def widened(self, a: Rel, b: Rel, thetas: list) -> tuple[Rel, Rel, list]:
        """For filters ?v = constant || ?v = ?w, with ?w on one side and ?v on the other: the side of ?w gets ?v with every value allowed, so both join by equality."""
        left = []
        for e, (v, consts, w) in thetas:
            widen = lambda r, v=v, consts=consts, w=w: Rel(r.df.withColumn(v, F.explode(F.array_distinct(F.array(F.col(w), *[F.lit(c) for c in consts])))), r.sure | {v}, r.maybe)
            if w in a.sure and v not in a.all and v in b.sure:
                a = widen(a)
            elif w in b.sure and v not in b.all and v in a.sure:
                b = widen(b)
            else:
                left.append((e, (v, consts, w)))
        return a, b, left

    # --- expressions: terms, truth values, numbers, strings

    def term(self, e, rel: Rel) -> Column:
        if isinstance(e, Var):
            return F.col(e.name) if e.name in rel.all else F.lit(None).cast("string")
        if isinstance(e, Const):
            return F.lit(e.term)
        if e.op in ("+", "-", "*", "/", "neg"):
            return number_literal(self.num(e, rel))
        if e.op in ("&&", "||", "!", "=", "!=", "<", ">", "<=", ">=", "in"):
            return as_literal(self.truth(e, rel).cast("string"), XSD + "boolean")
        if e.op == "call":
            return self.call(e.args[0], e.args[1], rel)
        raise SparqlError(f"{e.op} isn't supported here")

    def text(self, e, rel: Rel) -> Column:
        return lexical(self.term(e, rel))

    def num(self, e, rel: Rel) -> Column:
        if isinstance(e, Node) and e.op in ("+", "-", "*", "/"):
            a, b = (self.num(x, rel) for x in e.args)
            return a + b if e.op == "+" else a - b if e.op == "-" else a * b if e.op == "*" else F.try_divide(a, b)
        if isinstance(e, Node) and e.op == "neg":
            return -self.num(e.args[0], rel)
        return number(self.term(e, rel))

    def truth(self, e, rel: Rel) -> Column:
        """True, false, or null for an error; three-valued as in SQL."""
        if isinstance(e, Node):
            if e.op == "&&":
                return self.truth(e.args[0], rel) & self.truth(e.args[1], rel)
            if e.op == "||":
                return self.truth(e.args[0], rel) | self.truth(e.args[1], rel)
            if e.op == "!":
                return ~self.truth(e.args[0], rel)
            if e.op == "in":
                found = [self.truth(Node("=", (e.args[0], x)), rel) for x in e.args[1]]
                out = F.lit(False)
                for f in found:
                    out = out | f
                return out
            if e.op in ("=", "!=", "<", ">", "<=", ">="):
                a, b = self.term(e.args[0], rel), self.term(e.args[1], rel)
                x, y = number(a), number(b)
                if e.op in ("=", "!="):
                    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)
                    return same if e.op == "=" else ~same
                s, t = lexical(a), lexical(b)
                of = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[e.op]
                return F.when(x.isNotNull() & y.isNotNull(), of(x, y)).when(x.isNull() & y.isNull() & a.startswith('"') & b.startswith('"'), of(s, t))
            if e.op == "call":
                if b := self.test(e.args[0], e.args[1], rel):
                    return b[0]
            if e.op in ("exists", "not exists"):
                raise SparqlError("EXISTS must stand alone or in a conjunction")
        t = self.term(e, rel)
        s, x = lexical(t), number(t)
        return F.when(tail(t) == "^^" + XSD + "boolean", s.isin("true", "1")).when(x.isNotNull(), x != 0).when(t.startswith('"'), s != "")

    def test(self, name: str, args: list, rel: Rel) -> tuple[Column] | None:
        """Functions with a truth value, in a tuple."""
        s = lambda k: self.text(args[k], rel)
        if name == "BOUND":
            return (self.term(args[0], rel).isNotNull(),)
        t = self.term(args[0], rel) if args else None
        out = {
            "STRSTARTS": lambda: s(0).startswith(s(1)), "STRENDS": lambda: s(0).endswith(s(1)), "CONTAINS": lambda: s(0).contains(s(1)), "ISIRI": lambda: ~t.startswith('"') & ~t.startswith("_:"), "ISURI": lambda: ~t.startswith('"') & ~t.startswith("_:"),
            "ISLITERAL": lambda: t.startswith('"'), "ISBLANK": lambda: t.startswith("_:"), "ISNUMERIC": lambda: t.isNotNull() & number(t).isNotNull(), "SAMETERM": lambda: t == self.term(args[1], rel),
            "REGEX": lambda: F.regexp_like(s(0), F.concat(F.when(F.lit(len(args) > 2) & (s(2) != "") if len(args) > 2 else F.lit(False), F.concat(F.lit("(?"), s(2) if len(args) > 2 else F.lit(""), F.lit(")"))).otherwise(""), s(1))),
            "LANGMATCHES": lambda: F.when(s(1) == "*", s(0) != "").otherwise((F.lower(s(0)) == F.lower(s(1))) | F.lower(s(0)).startswith(F.concat(F.lower(s(1)), F.lit("-")))),
        }.get(name)
        return (out(),) if out else None

    def call(self, name: str, args: list, rel: Rel) -> Column:
        if b := self.test(name, args, rel):
            return as_literal(b[0].cast("string"), XSD + "boolean")
        s, n, t = (lambda k: self.text(args[k], rel)), (lambda k: self.num(args[k], rel)), (lambda k: self.term(args[k], rel))
        date = lambda k: F.try_to_timestamp(F.replace(F.regexp_replace(s(k), "(Z|[+-][0-9]{2}:[0-9]{2})$", ""), F.lit("T"), F.lit(" ")))
        kept = lambda k, c: F.when(tail(t(k)).startswith("@"), F.concat(F.lit('"'), c, F.lit('"'), tail(t(k)))).otherwise(as_literal(c))
        integer = lambda c: as_literal(c.cast("long"), XSD + "integer")
        table: dict[str, Callable[[], Column]] = {
            "STR": lambda: as_literal(s(0)), "LANG": lambda: as_literal(F.when(t(0).startswith('"'), F.when(tail(t(0)).startswith("@"), F.substr(tail(t(0)), F.lit(2))).otherwise(""))),
            "DATATYPE": lambda: F.when(tail(t(0)).startswith("^^"), F.substr(tail(t(0)), F.lit(3))).when(tail(t(0)).startswith("@"), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"),
            "IRI": lambda: s(0), "URI": lambda: s(0), "STRLEN": lambda: integer(F.char_length(s(0))), "UCASE": lambda: kept(0, F.upper(s(0))), "LCASE": lambda: kept(0, F.lower(s(0))),
            "SUBSTR": lambda: kept(0, F.substr(s(0), n(1).cast("int"), n(2).cast("int")) if len(args) > 2 else F.substr(s(0), n(1).cast("int"))),
            "STRBEFORE": lambda: as_literal(F.when(F.position(s(1), s(0)) > 0, F.substr(s(0), F.lit(1), F.position(s(1), s(0)) - 1)).otherwise("")),
            "STRAFTER": lambda: as_literal(F.when(F.position(s(1), s(0)) > 0, F.substr(s(0), F.position(s(1), s(0)) + F.char_length(s(1)))).otherwise("")),
            "CONCAT": lambda: as_literal(F.concat(*[self.text(a, rel) for a in args])), "REPLACE": lambda: kept(0, F.regexp_replace(s(0), s(1), s(2))), "ENCODE_FOR_URI": lambda: as_literal(F.replace(F.url_encode(s(0)), F.lit("+"), F.lit("%20"))),
            "ABS": lambda: number_literal(F.abs(n(0))), "CEIL": lambda: number_literal(F.ceil(n(0)).cast("double")), "FLOOR": lambda: number_literal(F.floor(n(0)).cast("double")), "ROUND": lambda: number_literal(F.floor(n(0) + 0.5).cast("double")),
            "YEAR": lambda: integer(F.year(date(0))), "MONTH": lambda: integer(F.month(date(0))), "DAY": lambda: integer(F.dayofmonth(date(0))), "HOURS": lambda: integer(F.hour(date(0))), "MINUTES": lambda: integer(F.minute(date(0))), "SECONDS": lambda: integer(F.second(date(0))),
            "MD5": lambda: as_literal(F.md5(s(0))), "SHA1": lambda: as_literal(F.sha1(s(0))), "SHA256": lambda: as_literal(F.sha2(s(0), 256)), "SHA512": lambda: as_literal(F.sha2(s(0), 512)), "UUID": lambda: F.concat(F.lit("urn:uuid:"), F.uuid()), "STRUUID": lambda: as_literal(F.uuid()),
            "IF": lambda: F.when(self.truth(args[0], rel), t(1)).when(~self.truth(args[0], rel), t(2)), "COALESCE": lambda: F.coalesce(*[self.term(a, rel) for a in args]), "STRDT": lambda: F.concat(F.lit('"'), s(0), F.lit('"^^'), s(1)), "STRLANG": lambda: F.concat(F.lit('"'), s(0), F.lit('"@'), F.lower(s(1))),
        }
        if name not in table:
            raise SparqlError(f"unknown function {name}")
        return table[name]()

    # --- select

    def aggregate(self, e: Node, rel: Rel) -> Column:
        name, inner, distinct, separator = e.args
        if name == "COUNT":
            c = F.lit(1) if inner is None else self.term(inner, rel)
            if inner is None and distinct:
                c = F.struct(*[F.coalesce(F.col(v), F.lit("")) for v in sorted(rel.all)])
            return as_literal(F.countDistinct(c) if distinct else F.count(c), XSD + "integer")
        t = self.term(inner, rel)
        if name in ("SUM", "AVG"):
            x = number(t)
            y = (F.sum_distinct(x) if distinct else F.sum(x)) if name == "SUM" else F.try_divide(F.sum_distinct(x), F.countDistinct(x).cast("double")) if distinct else F.avg(x)
            return number_literal(F.coalesce(y, F.lit(0.0)))
        if name in ("MIN", "MAX"):
            key = F.struct(number(t).alias("n"), lexical(t).alias("s"))
            return F.min_by(t, F.when(t.isNotNull(), key)) if name == "MIN" else F.max_by(t, F.when(t.isNotNull(), key))
        if name == "SAMPLE":
            return F.min(t)
        s = lexical(t)
        return as_literal(F.array_join(F.array_sort(F.collect_set(s) if distinct else F.collect_list(s)), separator))

    def select(self, q: Select, graph=None) -> Rel:
        rel = self.eval(q.where, graph)
        grouped = q.group is not None or any(isinstance(c, tuple) and _aggregates(c[1]) for c in q.columns) or any(_aggregates(h) for h in q.having)
        if grouped:
            keys = [(name or f"_k{k}", e) for k, (name, e) in enumerate(q.group or [])]
            df = rel.df.withColumns({n: self.term(e, rel) for n, e in keys if not (isinstance(e, Var) and e.name == n)}) if keys else rel.df
            own = Rel(df, rel.sure, rel.all | {n for n, _ in keys})
            found: dict[str, tuple[Node, str]] = {}

            def pull(e):
                if isinstance(e, Node):
                    if e.op == "aggregate":
                        key = repr(e)
                        found.setdefault(key, (e, f"_a{len(found)}"))
                        return Var(found[key][1])
                    return Node(e.op, tuple([pull(y) for y in a] if isinstance(a, list) else pull(a) if isinstance(a, Node) else a for a in e.args))
                return e

            columns = [(c[0], pull(c[1])) if isinstance(c, tuple) else c for c in q.columns]
            having, order = [pull(h) for h in q.having], [(pull(e), d) for e, d in q.order]
            if not found:
                found["_"] = (Node("aggregate", ("COUNT", None, False, " ")), "_a0")
            out = df.groupBy(*[n for n, _ in keys]).agg(*[self.aggregate(e, own).alias(n) for e, n in found.values()])
            rel = Rel(out, set(), {n for n, _ in keys} | {n for _, n in found.values()})
            for h in having:
                rel = Rel(rel.df.filter(F.coalesce(self.truth(h, rel), F.lit(False))), rel.sure, rel.maybe)
        else:
            columns, order = q.columns, q.order
        for c in columns:
            if isinstance(c, tuple):
                rel = Rel(rel.df.withColumn(c[0], self.term(c[1], rel)), rel.sure, rel.maybe | {c[0]})
        names = [c[0] if isinstance(c, tuple) else c for c in columns] or sorted(v for v in rel.all if not v.startswith("_"))
        df = rel.df
        for v in names:
            if v not in rel.all:
                df = df.withColumn(v, F.lit(None).cast("string"))
        if order:  # unbound first, then by number, then by text
            keys = []
            for e, down in order:
                t = self.term(e, Rel(df, rel.sure, rel.maybe | set(names)))
                keys += [x.desc_nulls_last() if down else x.asc_nulls_first() for x in (number(t), lexical(t))]
            if q.distinct:
                df = df.select(*names).distinct()
            df = df.orderBy(*keys)
        out = df.select(*names)
        if q.distinct and not order:
            out = out.distinct()
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        sure = rel.sure & set(names)
        return Rel(out, sure, set(names) - sure)


def _names(x) -> set[str]:
    """All variables that a part of a query names, but for those of subselects that it doesn't hand out."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Bgp):
        return {t.name for q in x.patterns for t in q if isinstance(t, Var)}
    if isinstance(x, Select):
        return {c[0] if isinstance(c, tuple) else c for c in x.columns} or _names(x.where)
    if isinstance(x, Node) and x.op == "values":
        return set(x.args[0])
    if isinstance(x, Node):
        return set().union(*(_names(y) for y in x.args), {x.args[0]} if x.op == "bind" else set())
    return set().union(*map(_names, x)) if isinstance(x, (list, tuple)) else set()


def _variables(x: tuple) -> set[str]:
    """Variables of a pattern with its graph."""
    return {t.name for t in (*x[0], x[1]) if isinstance(t, Var)}


def _conjunction(x, graph, outer: set[str]) -> tuple[list, list] | None:
    """Patterns with their graphs, and conditions, of a group that has nothing else, nor in groups within; each condition must name outer
    variables and those of its own group only, as it sees no others."""
    if isinstance(x, Bgp):
        return [(p, graph) for p in x.patterns], []
    if isinstance(x, Node) and x.op == "graph":
        return _conjunction(x.args[1], x.args[0], outer)
    if not (isinstance(x, Node) and x.op == "group"):
        return None
    patterns, conds, own = [], [], []
    for y in x.args[0]:
        if isinstance(y, Node) and y.op == "filter":
            work = [y.args[0]]
            while work:
                e = work.pop()
                if isinstance(e, Node) and e.op == "&&":
                    work += reversed(e.args)
                else:
                    own.append(e)
        elif (inner := _conjunction(y, graph, outer)) is None:
            return None
        else:
            patterns, conds = patterns + inner[0], conds + inner[1]
    seen = outer.union(*map(_variables, patterns))
    return None if any(_nested(e) or not _names(e) <= seen for e in own) else (patterns, conds + own)


def _sides(e, a: set[str], b: set[str]) -> tuple | None:
    """For a comparison of an expression of a's variables with one of b's: the operator, a's side and b's side, in this order."""
    if not (isinstance(e, Node) and e.op in ("=", "!=", "<", ">", "<=", ">=")):
        return None
    x, y = e.args
    if _names(x) <= a and _names(y) <= b:
        return e.op, x, y
    turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    return (turned.get(e.op, e.op), y, x) if _names(y) <= a and _names(x) <= b else None


def _correlated(x) -> set[str]:
    """Variables that expressions of a group, or of one within, name and that its own patterns don't bind."""
    if isinstance(x, (list, tuple)):
        return set().union(*map(_correlated, x))
    if not isinstance(x, Node):
        return set()
    if x.op == "group":
        said = [y for y in x.args[0] if isinstance(y, Node) and y.op in ("filter", "bind")]
        rest = [y for y in x.args[0] if not any(y is z for z in said)]
        return (_names(said) - _names([y for y in rest if not (isinstance(y, Node) and y.op == "minus")])) | _correlated(rest)
    return _correlated(list(x.args))


def _nested(e) -> bool:
    return isinstance(e, Node) and (e.op in ("exists", "not exists") or any(_nested(a) for a in e.args if isinstance(a, Node)))


def _aggregates(e) -> bool:
    return isinstance(e, Node) and (e.op == "aggregate" or any(_aggregates(y) for a in e.args for y in (a if isinstance(a, list) else [a])))


def _choice(e) -> tuple[str, list[str], str] | None:
    """For a disjunction of ?v = IRI, once or more, and ?v = ?w, once: v, the constants, w."""
    parts, work = [], [e]
    while work:
        x = work.pop()
        if not isinstance(x, Node) or x.op not in ("||", "="):
            return None
        if x.op == "||":
            work += reversed(x.args)
        else:
            parts.append(x.args)
    if not all(isinstance(a, Var) for a, _ in parts) or len({a.name for a, _ in parts}) != 1:
        return None
    if not all(isinstance(b, Var) or (isinstance(b, Const) and not b.term.startswith('"')) for _, b in parts):
        return None
    consts, others = [b.term for _, b in parts if isinstance(b, Const)], [b.name for _, b in parts if isinstance(b, Var)]
    return (parts[0][0].name, consts, others[0]) if consts and len(others) == 1 else None


def query(quads: DataFrame, text: str, prefixes: dict[str, str] | None = None, terms: bool = False) -> DataFrame:
    """Runs a SELECT over the quads. Columns are the variables' strings, null where unbound; terms=True keeps literals' datatypes."""
    rel = Compiler(quads).select(parse(text, prefixes))
    return rel.df if terms else rel.df.select(*[lexical(F.col(c)).alias(c) for c in rel.df.columns])
