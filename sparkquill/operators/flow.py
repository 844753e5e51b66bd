"""What reaches a dangerous call in Python: external input, something unknown, or constants alone.

Within a function origins are followed through assignments, branches and loops by its syntax tree, file by file; what comes out is
small: from parameters, inputs and results of calls to sinks, arguments of calls and returned values. Across functions and files
these are edges of one graph, in which calls meet definitions by equal keys (module and name), and origins spread along it.

External are what INPUTS names, and the parameters of functions that nothing in the project calls, of methods, and of functions
that are decorated or handed on as values. Numbers made of a text (CLEAN) can hold no code. A method of an unknown object, like a
function of another project, gives what its object and arguments hold, and something unknown.
"""

from __future__ import annotations

import ast
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.operators import graph, imports

SINKS = ("eval", "exec", "os.system")
INPUTS = re.compile(r"^(?:input|raw_input|os\.getenv|(?:sys\.(?:argv|stdin)|os\.environ|(?:\w+\.)?request\.(?:args|form|json|data|values|GET|POST|cookies|headers|get_json|query_params))(?:\..*)?)$")
CLEAN = ("int", "float", "bool", "len", "ast.literal_eval")
#: kind: flow (a to b); call (a: its number, b: the function it stands in, keys: modules it may mean, null for its own, slots: its
#: arguments); def (a: its number, b: its name, slots: its parameters, free: anybody may call it).
FLOWS = "path string, lang string, kind string, a string, b string, keys array<string>, name string, slots array<string>, free boolean"
UNKNOWN, CONSTANT = "unknown", "constant"
#: Labels of origins begin with a digit, in the order in which they count.
_LABELS = {UNKNOWN: "2", CONSTANT: "3"}
_Origins = dict[str, frozenset]
_NOTHING: frozenset = frozenset()


def _dotted(node: ast.AST) -> str | None:
    """a.b.c of such an expression."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def _merged(*states: _Origins) -> _Origins:
    out: _Origins = {}
    for state in states:
        for name, origins in state.items():
            out[name] = out.get(name, _NOTHING) | origins
    return out


class _File:
    """Rows (kind, a, b, keys, name, slots, free) of one file's tree."""

    def __init__(self, path: str, tree: ast.Module):
        self.path, self.rows = path, set()
        self.functions = {x.name for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))}
        self.modules, self.members = {}, {}
        for node in ast.walk(tree):
            self._imported(node)
        called = {id(x.func) for x in ast.walk(tree) if isinstance(x, ast.Call)}
        self.handed = {x.id for x in ast.walk(tree) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and id(x) not in called}
        self.owner, self.within = None, ""
        # What functions see of the module: all that its names ever hold, and anything for those that functions assign.
        self.outer: _Origins = {}
        shared = {name: frozenset([UNKNOWN]) for x in ast.walk(tree) if isinstance(x, ast.Global) for name in x.names}
        seen, env = shared, {}
        for node in tree.body:
            env = self.step(node, env)
            seen = _merged(seen, env)
        self.outer = seen
        self.rows.clear()
        self.run(tree.body, dict(shared))

    def _imported(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for x in node.names:
                self.modules[x.asname or x.name] = x.name.replace(".", "/")
        elif isinstance(node, ast.ImportFrom):
            base = (node.module or "").replace(".", "/")
            if node.level:
                base = "/".join([*self.path.split("/")[: -node.level], *filter(None, [base])])
            for x in node.names:
                self.members[x.asname or x.name] = (base, x.name)
                self.modules[x.asname or x.name] = f"{base}/{x.name}".lstrip("/")

    def flow(self, origins: frozenset, to: str) -> None:
        self.rows.update(("flow", x, to, None, None, None, None) for x in origins)

    # ---- expressions: what they hold

    def of(self, node: ast.AST | None, env: _Origins) -> frozenset:
        if node is None or isinstance(node, ast.Constant):
            return frozenset([CONSTANT])
        name = _dotted(node)
        if name and name not in env and INPUTS.match(name):
            return frozenset([f"i|{self.path}:{node.lineno} {name}"])
        if isinstance(node, ast.Name):
            return env.get(node.id, self.outer.get(node.id, frozenset([UNKNOWN])))
        if isinstance(node, ast.Call):
            return self.call(node, env)
        if isinstance(node, ast.Subscript):
            self.of(node.slice, env)
            return self.of(node.value, env)
        if isinstance(node, ast.NamedExpr):
            env[node.target.id] = self.of(node.value, env)
            return env[node.target.id]
        if isinstance(node, ast.IfExp):
            self.of(node.test, env)
            return self.of(node.body, env) | self.of(node.orelse, env)
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            env = dict(env)
            for part in node.generators:
                self.bind(part.target, part.iter, env)
                for x in part.ifs:
                    self.of(x, env)
            parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            return frozenset().union(*(self.of(x, env) for x in parts))
        if isinstance(node, ast.Lambda):
            self.of(node.body, {**env, **{x.arg: frozenset([UNKNOWN]) for x in node.args.args}})
            return frozenset([UNKNOWN])
        held = frozenset().union(*(self.of(x, env) for x in ast.iter_child_nodes(node) if isinstance(x, (ast.expr, ast.keyword))))
        if isinstance(node, (ast.Yield, ast.YieldFrom)):
            self.flow(held, f"r|{self.path}|{self.within}")
            return frozenset([UNKNOWN])
        return frozenset([CONSTANT]) if isinstance(node, ast.Compare) or not held else held - {CONSTANT} or held

    def call(self, node: ast.Call, env: _Origins) -> frozenset:
        name = _dotted(node.func)
        held = {f"{'*' if isinstance(x, ast.Starred) else k}": self.of(x, env) for k, x in enumerate(node.args)}
        held.update({x.arg or "*": self.of(x.value, env) for x in node.keywords})
        if name in SINKS:
            self.flow(frozenset().union(*list(held.values())[:1]), f"s|{self.path}|{node.lineno}")
            return frozenset([UNKNOWN])
        if name and INPUTS.match(name):
            return frozenset([f"i|{self.path}:{node.lineno} {name}"])
        if name in CLEAN:
            return frozenset([CONSTANT])
        head, _, last = (name or "").rpartition(".")
        keys, callee = None, None
        if name in self.functions and name not in env:
            callee = name
        elif head == "self" and self.owner:
            callee = f"{self.owner}.{last}"
        elif name in self.members:
            keys, callee = [self.members[name][0]], self.members[name][1]
        elif head in self.modules:
            keys, callee = [self.modules[head]], last
        if callee is None:
            own = self.of(node.func.value, env) if isinstance(node.func, ast.Attribute) else frozenset([UNKNOWN])
            whole = own.union(*held.values())
            return whole if whole == {CONSTANT} else whole - {CONSTANT}
        number = f"{self.path}:{node.lineno}:{node.col_offset}:{node.end_col_offset}"
        for slot, origins in held.items():
            self.flow(origins, f"a|{number}|{slot}")
        self.rows.add(("call", number, self.within, keys and tuple(keys), callee, tuple(held), None))
        return frozenset([f"v|{number}"])

    # ---- statements: what names hold after them

    def bind(self, target: ast.AST, value: ast.AST | frozenset, env: _Origins) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            paired = isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts)
            held = value if paired or isinstance(value, frozenset) else self.of(value, env)
            for k, x in enumerate(target.elts):
                self.bind(x, self.of(value.elts[k], env) if paired else held, env)
            return
        held = value if isinstance(value, frozenset) else self.of(value, env)
        if isinstance(target, ast.Name):
            env[target.id] = held
        elif isinstance(target, ast.Starred):
            self.bind(target.value, held, env)
        elif isinstance(target, (ast.Attribute, ast.Subscript)):
            base = target.value
            while isinstance(base, (ast.Attribute, ast.Subscript)):
                base = base.value
            if isinstance(base, ast.Name):
                env[base.id] = self.of(base, env) | held

    def run(self, body: list[ast.stmt], env: _Origins) -> _Origins:
        for node in body:
            env = self.step(node, env)
        return env

    def step(self, node: ast.stmt, env: _Origins) -> _Origins:
        if isinstance(node, ast.Assign):
            for target in node.targets:
                self.bind(target, node.value, env)
        elif isinstance(node, ast.AnnAssign):
            if node.value:
                self.bind(node.target, node.value, env)
        elif isinstance(node, ast.AugAssign):
            self.bind(node.target, self.of(node.target, env) | self.of(node.value, env), env)
        elif isinstance(node, ast.Return):
            self.flow(self.of(node.value, env), f"r|{self.path}|{self.within}")
        elif isinstance(node, ast.If):
            self.of(node.test, env)
            return _merged(self.run(node.body, dict(env)), self.run(node.orelse, dict(env)))
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            while True:
                inner = dict(env)
                if isinstance(node, ast.While):
                    self.of(node.test, inner)
                else:
                    self.bind(node.target, node.iter, inner)
                after = _merged(env, self.run(node.body, inner))
                if after == env:
                    return self.run(node.orelse, env)
                env = after
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                held = self.of(item.context_expr, env)
                if item.optional_vars:
                    self.bind(item.optional_vars, held, env)
            return self.run(node.body, env)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            tried = self.run(node.body, dict(env))
            ends = [self.run(node.orelse, dict(tried))]
            ends += [self.run(x.body, {**_merged(env, tried), **({x.name: frozenset([UNKNOWN])} if x.name else {})}) for x in node.handlers]
            return self.run(node.finalbody, _merged(*ends))
        elif isinstance(node, ast.Match):
            held = self.of(node.subject, env)
            bound = lambda case: {x.name: held for x in ast.walk(case.pattern) if isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name}
            return _merged(env, *(self.run(x.body, {**env, **bound(x)}) for x in node.cases))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(node, env)
        elif isinstance(node, ast.ClassDef):
            before, self.owner = self.owner, node.name
            self.run(node.body, dict(env))
            self.owner = before
        else:
            for x in ast.iter_child_nodes(node):
                if isinstance(x, ast.expr):
                    self.of(x, env)
        return env

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, env: _Origins) -> None:
        before, owner = self.within, self.owner
        name = f"{owner}.{node.name}" if owner else f"{before}.{node.name}" if before else node.name
        a = node.args
        names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
        method = owner is not None and not any(_dotted(x) == "staticmethod" for x in node.decorator_list)
        own = names[1:] if method else names
        rest = [x.arg for x in (a.vararg, a.kwarg) if x]
        inner = dict(env) if before else {}
        inner.update({x: frozenset([f"p|{self.path}|{name}|{x}"]) for x in (*own, *rest)})
        if method and names:
            inner[names[0]] = frozenset([UNKNOWN])
        free = bool(owner or before or node.decorator_list or node.name in self.handed)
        self.rows.add(("def", f"{self.path}|{name}", None, None, name, (*own, *(f"*{x}" for x in rest)), free))
        for x in filter(None, (*a.defaults, *a.kw_defaults)):
            self.of(x, env)
        self.within, self.owner = name, None
        if method:
            self.owner = owner
        self.run(node.body, inner)
        self.within, self.owner = before, owner


def of_file(path: str, content: str) -> list[tuple]:
    """Rows of FLOWS after lang of a Python file; none if it doesn't parse."""
    try:
        file = _File(path, ast.parse(content))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return sorted(file.rows, key=repr)


def flows(files: DataFrame) -> DataFrame:
    """FLOWS of files (path, lang, content)."""
    names = [field.split()[0] for field in FLOWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, "python", *row) for path, content in zip(batch["path"], batch["content"], strict=True) for row in of_file(path, content)]
            yield pd.DataFrame(rows, columns=names)

    return files.where("lang = 'python' AND content IS NOT NULL").select("path", "content").mapInPandas(run, FLOWS)


def _edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst), and (node, label) of what spreads along them: calls meet the definitions they may mean by path and name."""
    defs = rows.where("kind = 'def'").select(F.col("path").alias("to"), F.col("a").alias("def"), "name", F.col("slots").alias("params"), "free")
    calls = rows.where("kind = 'call'").select("path", F.col("a").alias("call"), F.concat_ws("|", "path", "b").alias("within"), "keys", "name", "slots")
    files = imports.keys(rows.select("path", "lang").distinct()).select("key", F.col("dst").alias("to"))
    abroad = calls.where("keys IS NOT NULL").withColumn("key", F.explode("keys")).join(files, "key").drop("key")
    met = calls.where("keys IS NULL").withColumn("to", F.col("path")).unionByName(abroad).join(defs, ["to", "name"])

    def fits(slot):
        return F.filter("params", lambda p, i: (slot == i.cast("string")) | (slot == p) | (slot == "*") | p.startswith("*"))

    def passed(slot):
        return F.transform(fits(slot), lambda p: F.struct(F.concat(F.lit("a|"), "call", F.lit("|"), slot).alias("src"), F.concat(F.lit("p|"), "def", F.lit("|"), F.ltrim(p, F.lit("*"))).alias("dst")))

    into = met.select(F.inline(F.flatten(F.transform("slots", passed))))
    back = met.select(F.concat(F.lit("r|"), "def").alias("src"), F.concat(F.lit("v|"), "call").alias("dst"))
    lost = calls.join(met.select("call").distinct(), "call", "left_anti").select(F.concat(F.lit("v|"), "call").alias("dst"), F.concat(F.array(F.lit(UNKNOWN)), F.transform("slots", lambda s: F.concat(F.lit("a|"), "call", F.lit("|"), s))).alias("sources"))
    edges = rows.where("kind = 'flow'").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(into).unionByName(back).unionByName(lost.select(F.explode("sources").alias("src"), "dst"))
    called = met.where("within != def").select("def").distinct()
    entries = defs.where("free").unionByName(defs.where("NOT free").join(called, "def", "left_anti"), allowMissingColumns=True)
    params = entries.select("def", "to", "name", F.explode("params").alias("p")).withColumn("p", F.ltrim("p", F.lit("*")))
    starts = params.select(F.concat(F.lit("p|"), "def", F.lit("|"), "p").alias("node"), F.concat(F.lit("1parameter "), "p", F.lit(" of "), "name", F.lit(" in "), "to").alias("label"))
    inputs = edges.where(F.col("src").startswith("i|")).select(F.col("src").alias("node"), F.concat(F.lit("0input at "), F.substring_index("src", "i|", -1)).alias("label"))
    others = rows.sparkSession.createDataFrame([(x, f"{digit}{x}") for x, digit in _LABELS.items()], "node string, label string")
    return edges, starts.unionByName(inputs).unionByName(others)


def reaching(rows: DataFrame, bound: int = graph.BOUND) -> DataFrame:
    """(path, line, origin): of each place of a dangerous call what may be run there, the worst first: an input, a parameter from outside, UNKNOWN,
    or CONSTANT where nothing else is. rows: FLOWS of a whole project."""
    found = graph.spread(*_edges(rows), bound).where(F.col("node").startswith("s|"))
    at = F.regexp_extract("node", r"^s\|(.*)\|(\d+)$", 1), F.regexp_extract("node", r"\|(\d+)$", 1).cast("int")
    return found.select(at[0].alias("path"), at[1].alias("line"), F.substring("label", F.lit(2), F.length("label")).alias("origin"))


def judged(found: DataFrame, rows: DataFrame, confidence: int) -> DataFrame:
    """found (path, lang, line, rule_id, confidence, message, ...) with dangerous calls of Python judged by what reaches them: what holds constants alone
    is dropped, what external input reaches is sure, and said. found is a stored table: where it has no such call nothing is drawn."""
    ours = (F.col("lang") == "python") & (F.col("rule_id") == "dangerous_call")
    if found.where(ours).isEmpty():
        return found
    external = ~F.col("origin").isin(UNKNOWN, CONSTANT)
    told = found.where(ours).join(reaching(rows), ["path", "line"], "left").where(F.coalesce(F.col("origin") != CONSTANT, F.lit(True)))
    told = told.withColumn("message", F.when(external, F.concat("message", F.lit(": "), "origin")).otherwise(F.col("message")))
    told = told.withColumn("confidence", F.when(external, confidence).otherwise(F.col("confidence"))).select(*found.columns)
    return found.where(~F.coalesce(ours, F.lit(False))).unionByName(told)
