"""The engine's parts against loops in Python and known answers."""

import fnmatch
import io
import json
import os
import random
import re
import subprocess
import sys
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquill import cli, sample, session
from sparkquill.functions.text import glob_to_regex, portable
from sparkquill.operators import detectors as d
from sparkquill.operators import flow, graph
from sparkquill.operators.outline import handlers, outline
from sparkquill.operators.structure import measure, structure
from sparkquill.plans import facts as stored
from sparkquill.plans import gate
from sparkquill.sources import files as sources
from sparkquill.sources import project as source
from sparkquill.sources import rules as catalogs
from sparkquill.sources.rules import Rule
from sparkquill.streaming.watch import watch

BAD = '''import os
def handle(a, b, c, d, e, f, g, h, i, j):
    password = "hunter2hunter2"
    for x in a:
        if x:
            for y in b:
                if y and x:
                    while c:
                        if d or e:
                            try:
                                os.system(x)
                            except Exception:
                                pass
    logger.info(password)
    return eval(f)
'''
GOOD = '''def handle(request, store):
    for item in request:
        if item:
            store.add(item)
    if store.full or store.closed:
        return None
    return store
'''


def files(spark, *rows):
    return sources.with_traits(spark.createDataFrame(list(rows), "path string, content string"))


@given(st.text("ab*?./", min_size=1, max_size=8), st.text("ab./", max_size=8))
def test_globs_without_directories_are_those_of_fnmatch(glob, name):
    if "/" in glob or "/" in name or "**" in glob:
        return
    assert bool(re.search(glob_to_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


def test_globs_with_directories():
    assert re.search(glob_to_regex("src/*.py"), "src/a.py") and not re.search(glob_to_regex("src/*.py"), "src/b/a.py")
    assert re.search(glob_to_regex("src/**/a.py"), "src/b/c/a.py")
    assert re.search(glob_to_regex("*.ts"), "x/y.ts") and re.search(glob_to_regex("[!a]b"), "cb")
    assert portable("(?P<n>a)") == "(?<n>a)"


def edges_of(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def strong(edges):
    """node -> least node of its strongly connected component, for nodes on a cycle; by search."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in {x for e in edges for x in e}}
    return {a: min(b for b in far[a] if a in far[b]) for a in far if a in far[a]}


def knots():
    rng = random.Random(1)
    edges = {(f"{g}{rng.choice('abcdefgh')}", f"{g}{rng.choice('abcdefgh')}") for g in range(12) for _ in range(11)}
    return edges | {(f"{g}a", f"{g + 1}b") for g in range(11)}


@pytest.mark.parametrize("bound", [0, 20, graph.BOUND])
def test_components_are_those_of_a_search(spark, bound):
    edges = knots()
    inner = graph.cyclic_edges(edges_of(spark, edges), bound)
    assert {r.node: r.component for r in graph.members(inner).collect()} == strong(edges)
    found = graph.cycles(inner, bound).collect()
    for r in found:
        nodes = r.cycle.split(">")
        assert nodes[0] == nodes[-1] == r.component and len(nodes) == r.length + 1 == len(set(nodes)) + 1
        assert set(zip(nodes, nodes[1:], strict=False)) <= edges
        assert r.n_nodes == sum(c == r.component for c in strong(edges).values())
    cycles = {r.component: (r.n_nodes, r.length, r.cycle) for r in found}
    assert sorted(map(tuple, graph.circles(edges_of(spark, edges), bound).collect())) == sorted((node, c, *cycles[c]) for node, c in strong(edges).items())


@given(st.sets(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=18))
def test_circles_of_a_graph_held_whole(edges):
    """Against every simple path."""

    def back(path):
        for a, b in edges:
            if a == path[-1] and b == path[0]:
                yield [*path, b]
            elif a == path[-1] and b not in path:
                yield from back([*path, b])

    far = strong(edges)
    found = {node: (component, n, length, cycle) for node, component, n, length, cycle in graph._circles(sorted(edges))}
    assert set(found) == set(far)
    for node, (component, n, length, cycle) in found.items():
        best = min(back([component]), key=lambda p: (len(p), p))
        assert component == far[node] and n == sum(c == component for c in far.values())
        assert length == len(best) - 1 and cycle == ">".join(best)


@pytest.mark.parametrize("n", [32, 500, 5_000])
def test_rings_take_a_few_jobs_whatever_their_length(spark, n):
    edges = [(f"r{k:05}", f"r{(k + 1) % n:05}") for k in range(n)]
    spark.sparkContext.setJobGroup(f"ring {n}", "ring")
    began = time.time()
    rows = graph.circles(edges_of(spark, edges)).collect()
    took, jobs = time.time() - began, spark.sparkContext.statusTracker().getJobIdsForGroup(f"ring {n}")
    spark.sparkContext.setJobGroup("", "")
    assert len(rows) == n and {r.length for r in rows} == {n} and {r.component for r in rows} == {"r00000"}
    assert len(jobs) <= 8 and took < 15


def test_tables_of_rounds_are_deleted(spark):
    session.forget()
    before = set(os.listdir(session.shared_folder(spark).removeprefix("file:")))
    assert graph.circles(edges_of(spark, {("a", "b"), ("b", "a")})).count() == 2
    session.forget()
    assert not {x for x in set(os.listdir(session.shared_folder(spark).removeprefix("file:"))) - before if x.startswith("table-")}


def test_circles_of_any_length(spark):
    ring = lambda name, n: {(f"{name}{k:02}", f"{name}{(k + 1) % n:02}") for k in range(n)}
    edges = ring("s", 7) | ring("t", 20) | ring("u", 5) | ring("v", 6) | {("u00", "v03"), ("v04", "u02"), ("loop", "loop"), ("s00", "t00"), ("end", "s01"), ("t03", "after")}
    for bound in (30, graph.BOUND):
        found = {r.component: (r.n_nodes, r.length) for r in graph.circles(edges_of(spark, edges), bound).collect()}
        assert found == {"s00": (7, 7), "t00": (20, 20), "u00": (11, 5), "loop": (1, 1)}
    assert graph.cyclic_edges(edges_of(spark, {("a", "b"), ("b", "c")})).count() == 0
    assert d.cycle_members(edges_of(spark, {("a", "b")})).count() == 0
    assert graph.circles(spark.createDataFrame([(None, "a"), ("a", None)], "src string, dst string")).count() == 0


def test_a_long_circle_of_imports_blocks(spark):
    rows = [(f"app/m{k}.py", f"import app.m{(k + 1) % 8}\n") for k in range(8)]
    issues = gate.collect_issues(files(spark, *rows))
    assert gate.verdict(issues).first().exit_code == 2
    assert [r.found.count(">") for r in issues.where("rule_id = 'dependency_cycle'").collect()] == [8] * 8  # one for each file


@given(st.text("{}x", max_size=30))
def test_depth_counts(text):
    depth = most = 0
    for c in text:
        depth += (c == "{") - (c == "}")
        most = max(most, depth)
    assert most == max([0, *(text[:k].count("{") - text[:k].count("}") for k in range(len(text) + 1))])


def test_brace_nesting(spark):
    rows = {r.path: r.max_depth for r in d.brace_nesting(spark.createDataFrame([("a", "{{}{{}}}"), ("b", ""), ("c", "}}{")], "path string, content string")).collect()}
    assert rows == {"a": 3, "b": 0, "c": 0}


def test_contrast_pair(spark):
    (bad,) = [r for r in measure("python", BAD) if r[0] == "function"]
    assert bad[5] == 10 and bad[4] >= 6 and bad[3] >= 10
    (good,) = [r for r in measure("python", GOOD) if r[0] == "function"]
    assert good[5] == 2 and good[4] == 2 and good[3] <= 5
    verdicts = [gate.verdict(gate.collect_issues(files(spark, ("app/x.py", text)))).first().exit_code for text in (BAD, GOOD)]
    assert verdicts == [2, 0]


def test_python_is_measured_by_its_trees(spark):
    rows = gate.collect_issues(files(spark, ("app/x.py", BAD), ("app/y.py", "def f(:\n" + "def g(a):\n" + "  if x: pass\n" * 20), ("app/z.py", "if x: pass\n" * 40))).collect()
    found = {(r.path, r.rule_id, r.found, r.line, r.confidence) for r in rows}
    assert {("app/x.py", "too_high_params", "handle", 2, d.SYNTAX), ("app/x.py", "too_high_nesting", "handle", 2, d.SYNTAX), ("app/x.py", "empty_handler", "", 12, d.SYNTAX)} <= found
    assert [(r.rule_id, r.confidence) for r in rows if r.path == "app/x.py" and r.line == 12] == [("empty_handler", d.SYNTAX)]  # one issue for one handler
    assert ("app/y.py", "too_high_complexity", "g", 2, d.STRIPPED) in found
    assert not any(path == "app/z.py" and rule == "too_high_complexity" for path, rule, *_ in found)


def test_handlers_are_judged_by_what_they_hold(spark):
    shape = "def f():\n    try:\n        g()\n    except{what}:\n        {body}\n"
    cases = [("", "pass", "empty_handler"), (" ValueError", "...", "empty_handler"), (" Exception as e", "'why'", "empty_handler"), ("", "raise", None), ("", "log.error('x')", "bare_except"), (" Exception", "x = 1", "broad_catch"),
        (" Exception", "logger.exception('x')", None), (" (OSError, BaseException) as e", "raise X() from e", None), (" (OSError, Exception)", "return 1", "broad_catch"), (" KeyError", "x = 1", None), (" Exception", "logging.warning(1)\n        x = 1", None)]
    rows = gate.collect_issues(files(spark, *[(f"m{k}.py", shape.format(what=what, body=body)) for k, (what, body, _) in enumerate(cases)])).where("category != 'duplicate_code'").collect()
    assert sorted((r.path, r.line, r.rule_id, r.confidence) for r in rows) == sorted((f"m{k}.py", 4, rule, d.SYNTAX) for k, (_, _, rule) in enumerate(cases) if rule)
    other = [("a.java", "class A { void f() { try { g(); } catch (Exception e) { }\n try { h(); } catch (Exception e) { k(); } } }"), ("b.cs", "class B { void F() { try { G(); } catch { } } }"), ("c.py", "def broken(:\ntry:\n  g()\nexcept Exception: pass\n")]
    found = sorted((r.path, r.rule_id) for r in gate.collect_issues(files(spark, *other)).collect())
    assert found == [("a.java", "broad_catch"), ("a.java", "empty_handler"), ("b.cs", "empty_handler"), ("c.py", "empty_handler")]


@pytest.mark.parametrize("trees", [True, False])
def test_handlers_in_braces_are_judged_by_what_they_hold(spark, trees):
    shape = "class A {{ void f() {{\n try {{ g(); }}\n {what} {{\n  {body}\n }}\n}} }}\n"
    broad, bare, all_ = "catch (Exception e)", "catch", "catch (...)"
    cases = [("java", broad, "x = 1;", "broad_catch"), ("java", broad, "throw new X(e);", None), ("java", broad, "if (a) { for (;;) { throw e; } }", None), ("java", broad, "LOGGER.warn(e);", None), ("java", broad, '// throw e;\n k("log.warn( throw");', "broad_catch"),
        ("java", broad, "try { h(); } catch (IOException i) { throw i; }", None), ("java", "catch (Throwable t)", "catalog.add(t);", "broad_catch"), ("cs", bare, "k();", "bare_except"), ("cs", bare, "_logger.LogError(1);", "bare_except"), ("cs", bare, "k(); throw;", None),
        ("cs", broad, "_logger.LogError(e);", None), ("cs", broad + " when (e.Ok)", "throw;", None), ("cpp", all_, "std::abort();", "broad_catch"), ("cpp", all_, "throw;", None), ("cpp", all_, "LOG(ERROR) << 1;", None), ("cpp", all_, "log->error(1);", None),
        ("java", "catch (Exception e) { throw e; } catch (Exception o)", "k();", "broad_catch")]
    rows = gate.collect_issues(files(spark, *[(f"m{k}.{end}", shape.format(what=what, body=body)) for k, (end, what, body, _) in enumerate(cases)]), trees=trees).where("category IN ('exception_handling', 'security')").collect()
    assert {(r.path, r.line, r.rule_id, r.confidence) for r in rows} == {(f"m{k}.{end}", 3, rule, d.STRIPPED) for k, (end, _, _, rule) in enumerate(cases) if rule}


def test_handlers_of_odd_texts():
    assert handlers("", "java") == handlers("} } catch {", "csharp") == handlers("catch (Exception e) { throw e;", "java") == []  # the last one never ends
    assert handlers("catch (A a) { throw a; }", "javascript") == []
    assert handlers("{\n" * 1000 + "catch (A a) { log.a(); }" + "catch (B b) { throw b; }", "java") == [("logged", 1001)]
    assert handlers("catch (A a) {" * 3000 + "throw a;" + "}" * 3000, "java") == [("raised", 1)]


def test_severities_are_read_in_any_case_and_unknown_ones_named(spark):
    text = json.dumps({"rules": [{"id": n, "severity": s, "target": "all", "pattern": "x"} for n, s in (("A", "BLOCK"), ("B", " Warn"), ("C", "fatal"), ("D", ""), ("E", None))]})
    rules, bad = catalogs.valid_rules(spark, text)
    assert [(r.id, r.severity) for r in rules] == [("A", "block"), ("B", "warn")] and bad == ["C", "D", "E"]
    assert gate.verdict(gate.collect_issues(files(spark, ("a.txt", "x")), rules[:1])).first().exit_code == 2


def test_constraints_of_a_path(spark, project):
    (project / ".quality").mkdir()
    (project / ".quality" / "rules.json").write_text(sample.RULES_JSON)
    call = lambda name, **arguments: json.loads(next(cli.answer(spark, str(project), [json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})])))
    texts = [x["text"] for x in call("constraints", path="app/domain/x.ts")["result"]["content"]]
    assert [t.split(":")[0] for t in texts] == ["[WARN] domain", "[INFO] *.ts", "[INFO] all"]
    found = [json.loads(x["text"]) for x in call("check", path="app/x.py", content="token = 'abcdefgh'\n")["result"]["content"]]
    assert found[0]["issues"] == 1 and found[1]["rule_id"] == "hardcoded_secret" and found[1]["line"] == 1
    assert call("check", path="app/x.py")["error"]["code"] == call("constraints")["error"]["code"] == -32602


def test_structure_rows(spark):
    rows = structure(files(spark, ("a.py", "class A:\n  def f(self): pass\n  async def g(self, *a, k=1, **b): return [x for x in a if x]\n"), ("b.py", "def ("), ("c.txt", "x"), ("d.js", None))).collect()
    kinds = sorted(((r.path, r.kind, r.name, r.n_params, r.n_methods, r.complexity) for r in rows), key=repr)
    assert ("a.py", "class", "A", None, 2, None) in kinds and ("a.py", "function", "g", 4, None, 2) in kinds
    assert ("b.py", "unparsable", None, None, None, None) in kinds and len(kinds) == 4


def parts(lang, text):
    return {(p.name, p.complexity, p.n_params) if p.kind == "function" else (p.name, p.n_methods) for p in outline(text, lang)}


def test_outlines_of_every_language():
    assert parts("javascript", "function a(x, y = f(1, 2)) { if (x && y) { for (;;) {} } const g = (p, q) => { return p ? q : 0; }; const h = z => z + 1; const s = 'if { ('; }\nclass C { async run(m: Map<string, number>, b) : void { while (m) { b?.c; } } get v() { return 1 } }\nfoo.bar(1); if (x) { y(); }") == {("a", 4, 2), ("g", 2, 2), ("h", 1, 1), ("run", 2, 2), ("v", 1, 0), ("C", 2)}
    assert parts("java", "public class A<T> { private Map<String, Integer> f(Map<String, Integer> m, int k) throws E { if (k > 0 || m == null) { return g(k); } else if (k < 3) { new B() { public void z() { } }; } return m; } public abstract int h(int a, int b); class Inner { void i() { } } }") == {("f", 4, 2), ("z", 1, 0), ("h", 1, 2), ("i", 1, 0), ("Inner", 1), ("A", 2)}
    assert parts("go", "func (s *Store) Load(ctx C, f func(int, int) error) (int, error) { if err := x(); err != nil && y { return 0, err } }\nfunc Plain() {}") == {("Load", 3, 2), ("Plain", 1, 0)}
    assert parts("csharp", "class I { public int T(int a, int b) => a + b; public async Task<int> R(Dictionary<string,int> d) { foreach (var l in d) { if (l) { } } } }") == {("T", 1, 2), ("R", 3, 1), ("I", 2)}
    assert parts("cpp", "std::vector<int> f(int (*g)(int, int), const Foo& x) const { return x ? 1 : 2; }\nvoid K::q(void) { call(a); }") == {("f", 2, 2), ("q", 1, 0)}
    assert parts("rust", "impl S { fn p<'a>(&self, v: Vec<(u8, u8)>) -> u32 { if x { 1 } else { match y { _ => 2 } } } }\nfn main() { let c = '{'; }") == {("p", 3, 2), ("S", 1), ("main", 1, 0)}
    assert parts("python", "def f(self, a=(1, 2), *, b: dict[str, int] = {}):\n  if a and b: pass\ndef g(): return 'if'") == {("f", 3, 3), ("g", 1, 0)}


def test_code_keeps_its_lines(spark):
    rows = {r.path: r.code for r in d.with_code(files(spark, ("a.js", 'x = "http://h/p"; // gone\n/* a\nb */y "/* kept */" /*z*/'), ("b.py", "s = '# kept' # gone\n"), ("c.txt", "// stays"))).collect()}
    assert rows == {"a.js": 'x = "http://h/p"; \n\ny "/* kept */" ', "b.py": "s = '# kept' \n", "c.txt": "// stays"}


def test_every_match_has_its_own_line(spark):
    text = "/* token = 'abcdefgh' */\ntoken = 'abcdefgh'\n// token = 'abcdefgh'\n\nx; token = 'abcdefgh'; token =\n 'abcdefgh'\n"
    rows = d.three_scans(files(spark, ("a.js", text), ("b.txt", text))).collect()
    assert sorted((r.path, r.line, r.confidence) for r in rows) == [("a.js", 2, 80), ("a.js", 5, 80), ("a.js", 5, 80), *[("b.txt", k, 70) for k in (1, 2, 3, 5, 5)]]
    rule = Rule("R", "", "warn", "all", "foo|x*", "m", "")
    found = [(r.line, r.found) for r in d.custom_issues(files(spark, ("a.py", "foo\nbar foo\nfoo")), [Rule("R", "", "warn", "all", "foo", "m", "")]).collect()]
    assert sorted(found) == [(1, "foo"), (2, "foo"), (3, "foo")]
    assert {(r.line, r.found) for r in d.custom_issues(files(spark, ("a.py", "foo")), [rule]).collect()} == {(None, "foo"), (None, "")}  # empty matches have no line


def test_dangerous_arguments(spark):
    calls = {"eval('x' + y)": 1, 'eval("x")': 0, "exec(code)": 1, "os.system('ls')": 0, "os.system('rm ' + p)": 1, "eval()": 0, "eval(f'{x}')": 1, "medieval(x)": 0, "eval(\n  x)": 1}
    rows = d.three_scans(files(spark, *[(f"{k}.py", call) for k, call in enumerate(calls)])).collect()
    assert {int(r.path[:-3]) for r in rows} == {k for k, hit in enumerate(calls.values()) if hit}


def edges_in(spark, *rows):
    return {(r.src, r.dst) for r in d.dependency_edges(files(spark, *rows)).collect()}


def origins(spark, *rows, **options):
    return {(r.path, r.line): r.origin for r in flow.reaching(d.cut(flow.flows(files(spark, *rows))), **options).collect()}


TOOLS = "import os\n\ndef go(command):\n    line = command\n    os.system(line)\n\ndef safe(command):\n    os.system(command)\n\ndef twice(x, *rest, **more):\n    return x + x\n"
MAIN = """import os, sys
import app.tools as t
from app.tools import go, twice
from .tools import safe

PREFIX = "ls "

def main():
    first = input()
    second = first.strip() + " -l"
    go(second)
    safe(PREFIX + "-a")
    eval(twice(sys.argv[1]))
    eval(twice("1"))
    exec(PREFIX)
    exec(int(input()))
    exec(other.thing())

def changed(n):
    a = b = c = "1"
    for _ in n:
        eval(c)
        c = b
        b = a
        a = input()
    x = input()
    x = "2"
    eval(x)

def alone(code):
    eval(code)

class Box:
    def run(self, code):
        eval(self.code)
        self.inner("3")

    def inner(self, code, more=None):
        exec(code)

main()
changed([])
"""


@pytest.mark.parametrize("bound", [graph.BOUND, 0])
def test_external_input_through_assignments_calls_and_files(spark, bound):
    found = origins(spark, ("app/tools.py", TOOLS), ("app/main.py", MAIN), ("app/bad.py", "def x(:\n eval(y)"), ("a.js", "eval(x)"), bound=bound)
    at = {line: origin for (path, line), origin in found.items() if path == "app/main.py"}
    assert found[("app/tools.py", 5)] == "input at app/main.py:9 input"  # two assignments and a call
    assert found[("app/tools.py", 8)] == "constant"
    assert at == {
        13: "input at app/main.py:13 sys.argv", 14: "input at app/main.py:13 sys.argv", 15: "constant", 16: "constant", 17: "unknown",
        22: "input at app/main.py:25 input", 28: "constant", 31: "parameter code of alone in app/main.py", 35: "unknown", 39: "parameter code of Box.inner in app/main.py",
    }
    assert {path for path, _ in found} == {"app/tools.py", "app/main.py"}


def test_dangerous_calls_are_judged_by_what_reaches_them(spark):
    rows = [("app/tools.py", TOOLS), ("app/main.py", MAIN), ("web/a.js", "eval(x)")]
    issues = {(r.path, r.line): (r.confidence, r.message) for r in gate.collect_issues(files(spark, *rows)).where("rule_id = 'dangerous_call'").collect()}
    assert issues[("app/tools.py", 5)] == (90, "input may be run as code: input at app/main.py:9 input")
    assert ("app/tools.py", 8) not in issues and ("app/main.py", 15) not in issues
    assert issues[("app/main.py", 17)] == (80, "input may be run as code")
    assert issues[("web/a.js", 1)] == (80, "input may be run as code")
    calm = gate.collect_issues(files(spark, ("app/a.py", "def f(x):\n    return x\n"), ("app/b.py", None)))
    assert calm.where("rule_id = 'dangerous_call'").isEmpty()


def test_flows_of_odd_trees():
    deep = "x = " + "+".join(["input()"] * 3000) + "\neval(x)"
    assert isinstance(flow.of_file("a.py", deep), list)
    odd = "async def f(*a, k=lambda: 0, **b):\n    async with a as (c, *d), b:\n        (yield c)\n    try:\n        d[0].x = a\n    except* E as e:\n        eval(e)\n    match a:\n        case [1, *r] if (z := r): exec(z)\n    while k: k += 1\n    return {i: j for i, j in b if i}, f'{c}'\n"
    assert {r[2] for r in flow.of_file("a.py", odd) if r[0] == "flow" and r[2].startswith("s|")} == {"s|a.py|7", "s|a.py|9"}
    assert flow.of_file("a.py", "") == [] and flow.of_file("a.py", "\0") == []


def test_imports_are_resolved_as_the_languages_do(spark):
    assert edges_in(spark, ("p/src/shop/a.py", "import os, shop.b as x, shop.c\nfrom . import d\nfrom ..shop.e import f\nfrom .pkg import (g,\n  h as i)\n"), *[(f"p/src/shop/{n}.py", "") for n in ("b", "c", "d", "e", "pkg/__init__", "pkg/g", "pkg/h")], ("q/src/shop/b.py", "")) == {("p/src/shop/a.py", f"p/src/shop/{n}.py") for n in ("b", "c", "d", "e", "pkg/__init__", "pkg/g", "pkg/h")}
    assert edges_in(spark, ("w/a/x.ts", "import y from '../b/y.js'; const z = require('./z'); import('..'); export * from '@/deep/q'; import 'react'"), ("w/b/y.js", ""), ("w/a/z.tsx", ""), ("w/index.js", ""), ("deep/q.ts", "")) == {("w/a/x.ts", n) for n in ("w/b/y.js", "w/a/z.tsx", "w/index.js", "deep/q.ts")}
    assert edges_in(spark, ("src/main/java/a/X.java", "package a;\nimport static b.Y.make;\nimport b.Y.Inner;\nimport c.*;\nimport a.*;\n"), ("src/main/java/b/Y.java", "package b;"), ("src/main/java/c/Z.java", "package c;")) == {("src/main/java/a/X.java", "src/main/java/b/Y.java"), ("src/main/java/a/X.java", "c/"), ("c/", "src/main/java/c/Z.java")}
    assert edges_in(spark, ("cmd/m.go", 'import (\n x "example.com/o/r/pkg/s"\n "fmt"\n)\n'), ("pkg/s/one.go", ""), ("pkg/s/two.go", ""), ("pkg/s/one_test.go", "")) == {("cmd/m.go", "pkg/s/"), ("pkg/s/", "pkg/s/one.go"), ("pkg/s/", "pkg/s/two.go")}
    assert edges_in(spark, ("A.cs", "using B.C;\nusing D = B.C.E;\nnamespace A;\n"), ("x.cs", "namespace B.C { }")) == {("A.cs", "B/C/"), ("B/C/", "x.cs")}
    assert edges_in(spark, ("n/a.cc", '#include "a.h"\n#include "../m/b.hpp"\n#include <lib/c.h>\n'), ("n/a.h", ""), ("m/b.hpp", ""), ("include/lib/c.h", "")) == {("n/a.cc", n) for n in ("n/a.h", "m/b.hpp", "include/lib/c.h")}
    assert edges_in(spark, ("k/src/main.rs", "mod a;\nuse crate::b::{c, d::e};\n"), ("k/src/a.rs", "use super::b;"), ("k/src/b/mod.rs", "use self::c::X;"), ("k/src/b/c.rs", ""), ("k/src/b/d.rs", "")) == {("k/src/main.rs", "k/src/a.rs"), ("k/src/main.rs", "k/src/b/c.rs"), ("k/src/main.rs", "k/src/b/d.rs"), ("k/src/main.rs", "k/src/b/mod.rs"), ("k/src/a.rs", "k/src/b/mod.rs"), ("k/src/b/mod.rs", "k/src/b/c.rs")}


def test_roots_of_modules_are_read_from_manifests(spark):
    rows = [
        ("svc/go.mod", "module example.com/acme/shop\n\ngo 1.22\nreplace example.com/acme/util => ../util\n"),
        ("svc/main/a.go", 'package main\nimport (\n "example.com/acme/shop/store"\n "example.com/acme/util/text"\n "example.com/other/main2/near"\n)\n'),
        ("svc/store/s.go", "package store\n"), ("util/text/t.go", "package text\n"), ("near/n.go", "package near\n"),
        ("web/tsconfig.json", '{ // aliases\n "compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/*"], "@app/deep/*": ["deep/*", "../gen/*",], "@/*": ["./*"]}}}'),
        ("web/src/app/x.ts", 'import a from "@app/y";\nimport b from "@app/deep/z";\nimport c from "@/main";\nimport d from "util/q";\nimport e from "@apple/y";\n'),
        ("web/src/app/y.ts", ""), ("web/src/deep/z.ts", ""), ("web/gen/z.ts", ""), ("web/src/app/deep/z.ts", ""), ("web/src/main.ts", ""), ("main.ts", ""), ("web/src/util/q.ts", ""),
        ("other/x.ts", 'import a from "@app/y";\nimport c from "@/main";\n'),
        ("crates/my-core/Cargo.toml", '[package]\nname = "my-core"\nversion = "1"\n'), ("crates/my-core/src/lib.rs", "pub mod rule;\n"), ("crates/my-core/src/rule.rs", ""),
        ("crates/tool/src/main.rs", "use my_core::rule::{Rule, Level};\nuse my_core::Thing;\nuse mycore::rule;\nuse std::io;\n"),
        ("empty/go.mod", ""), ("empty/tsconfig.json", "{"), ("empty/Cargo.toml", None), ("bare/tsconfig.json", "{}"),
    ]
    found = {(r.src, r.dst) for r in d.dependency_edges(files(spark, *rows)).collect()}
    assert found == {
        ("svc/main/a.go", "svc/store/"), ("svc/store/", "svc/store/s.go"), ("svc/main/a.go", "util/text/"), ("util/text/", "util/text/t.go"),
        ("web/src/app/x.ts", "web/src/app/y.ts"), ("web/src/app/x.ts", "web/src/deep/z.ts"), ("web/src/app/x.ts", "web/gen/z.ts"), ("web/src/app/x.ts", "web/src/main.ts"), ("web/src/app/x.ts", "web/src/util/q.ts"),
        ("other/x.ts", "main.ts"), ("other/x.ts", "web/src/main.ts"),  # below no manifest and no source root: guessed
        ("crates/my-core/src/lib.rs", "crates/my-core/src/rule.rs"), ("crates/tool/src/main.rs", "crates/my-core/src/rule.rs"), ("crates/tool/src/main.rs", "crates/my-core/src/lib.rs"),
    }


def test_secret_in_a_comment_is_dropped_and_lines_are_raw(spark):
    text = "/* token = 'abcdefgh' */\n\nconst t = 1; const token = 'ijklmnop';\n"
    (row,) = d.three_scans(files(spark, ("a.js", text))).collect()
    assert (row.found, row.line, row.confidence) == ("token = 'ijklmnop'", 3, d.STRIPPED)
    (row,) = d.three_scans(files(spark, ("a.yaml", "password: 'abcdefgh'"))).collect()
    assert row.confidence == d.RAW


def test_long_and_null_texts(spark):
    long = 'x = "' + "a" * 200_000 + '"\n' + "/* " + "b" * 200_000 + " */\n"
    rows = files(spark, ("a.js", long), ("b.py", None), (None, "x"), ("e.py", ""))
    assert d.three_scans(rows).count() == 0
    assert d.file_sizes(rows).count() == 4


@pytest.mark.parametrize("n", [1_000_000])
def test_any_number_of_escapes_in_every_language(n):
    """In a JVM of its own, where nothing is compiled yet and the stack is shallow."""
    program = f'''
import json, sys
sys.path.insert(0, {str(sources.__file__.rsplit("/sparkquill/", 1)[0])!r})
from pyspark.sql import SparkSession, functions as F
from sparkquill.operators import detectors as d
from sparkquill.sources.files import with_traits
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
n = {n}
rows = [("a." + e, 'x = "' + chr(92) * 2 * n + '"; y = \\'' + (chr(92) + "n") * n + "\\' // gone" + chr(10) + "# gone" + chr(10)) for e in ("py", "js", "java", "go", "cs", "cc", "rs")]
rows.append(("b.rs", "use " + "a::" * n + "b;" + chr(10) + "use super" + "::c" * n + ";"))
rows.append(("b.js", "import '" + "../" * n + "x'"))
files = with_traits(spark.createDataFrame(rows, "path string, content string"))
print(json.dumps([{{r.path: r.n for r in d.with_code(files).select("path", (F.length("content") - F.length("code")).alias("n")).collect()}}, d.dependency_edges(files).count(), d.three_scans(files).count()]))
'''
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=400)
    assert out.returncode == 0, out.stderr[-2_000:]
    gone, edges, found = json.loads(out.stdout.strip().splitlines()[-1])
    assert gone == {"a.py": 6, "b.rs": 0, "b.js": 0} | {f"a.{e}": 7 for e in ("js", "java", "go", "cs", "cc", "rs")}
    assert edges == found == 0


@pytest.mark.parametrize("pattern,words", [("foo|bar", ()), ("foobar", ("foobar",)), ("(?i)FooBar\\s+(baz|q)x", ("foobar",)), ("a[bc]def(?:ghi)+(?:jkl)?(mno)*", ("def", "ghi")), ("(?<x>abc)\\1", ("abc",)), ("(?x)abc def", ()), ("\\Qabc\\E", ()), ("[a[bc]]xyz", ()), ("(?iu)kelvin", ()), ("\\vabc", ("abc",)), ("(unclosed", ()), ("(?=abc)d", ()), ("(?:abcd|abce)fgh", ("abc", "fgh")), ("\\p{L}abc", ()), ("éabc", ("abc",))])
def test_words_that_a_match_holds(pattern, words):
    assert catalogs.required(pattern) == tuple((w,) for w in words)


def test_a_thousand_rules(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    shapes = [lambda: letters(4), lambda: f"{letters(3)}[a-c]+{letters(2)}", lambda: f"(?i){letters(3).upper()}", lambda: f"{letters(2)}|{letters(5)}", lambda: rf"\\b{letters(3)}\\w*{letters(1)}\\b"]
    targets = ["all", "python", "domain", "*.js", "app/**/x.py"]
    rules = [Rule(f"R{k}", "", "warn", rng.choice(targets), rng.choice(shapes)(), "m", "") for k in range(1_000)]
    texts = {path: "".join(rng.choice(["abcde", "ABCdE", " ", "\n", letters(3)]) for _ in range(400)) for path in ("app/domain/x.py", "web/y.js", "app/z.go", "notes.txt")}
    fits = {"all": lambda p: True, "python": lambda p: p.endswith(".py"), "domain": lambda p: "/domain/" in p, "*.js": lambda p: p.endswith(".js"), "app/**/x.py": lambda p: p.endswith("/x.py")}
    expected = {(path, rule.id, text.count("\n", 0, m.start()) + 1, m[0]) for path, text in texts.items() for rule in rules if fits[rule.target](path) for m in re.finditer(rule.pattern, text)}
    table = files(spark, *texts.items())
    began = time.time()
    df = d.custom_issues(table, rules)
    df._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5
    assert {(r.path, r.rule_id, r.line, r.found) for r in df.collect()} == expected


def test_texts_with_marks_of_their_own(spark):
    text = "\x01token = 'abcdefgh'\n\x02 token = 'abcd\x01efgh'\n"
    rows = d.three_scans(files(spark, ("b.txt", text))).collect()
    assert sorted((r.line, r.found) for r in rows) == [(1, "token = 'abcdefgh'"), (2, "token = 'abcd\x01efgh'")]


def test_bad_rules_are_named_and_left_out(spark):
    rules, bad = catalogs.valid_rules(spark, sample.RULES_JSON)
    assert bad == ["BROKEN"] and len(rules) == 4
    assert catalogs.parse_rules(spark, sample.RULES_JSON).count() == 5


def test_red_lines_hold_in_every_class(spark):
    for path in ("tests/test_a.py", "build/a.py", "docs/a.md", "config/a.yaml", "db/migrations/a.py"):
        rows = gate.collect_issues(files(spark, (path, 'token = "abcdefgh"'))).collect()
        assert [r.rule_id for r in rows] == ["hardcoded_secret"]


def test_duplicates_count_where_they_are_switched_on(spark):
    block = "".join(f"let v{k} = {k};\n" for k in range(6))
    found = lambda *paths: sorted((r.path, r.message) for r in gate.collect_issues(files(spark, *[(p, block) for p in paths])).where("rule_id = 'duplicate_block'").collect())
    assert found("build/generated/x.js", "src/a.js", "src/b.js") == [("src/a.js", "stands 2 times"), ("src/b.js", "stands 2 times")]
    assert found("build/generated/x.js", "src/a.js") == []


def test_a_copied_region_is_one_issue_at_each_place(spark):
    copy = "".join(f"let v{k} = {k};\n" + "\n" * (k % 3) for k in range(100))
    own = lambda name, n: "".join(f"let {name}{k} = {k};\n" for k in range(n))
    rows = [("a.js", own("a", 7) + copy + own("b", 9)), ("b.js", copy), ("c.js", own("c", 3) + copy[: copy.index("let v20")] + own("d", 2) + copy[copy.index("let v50") : copy.index("let v56")]), ("d.js", own("e", 40))]
    found = sorted((r.path, r.line, r.message) for r in gate.collect_issues(files(spark, *rows)).where("rule_id = 'duplicate_block'").collect())
    middle = rows[2][1][: rows[2][1].index("let v50")].count("\n") + 1
    assert found == [("a.js", 8, "stands 2 times, 100 lines long"), ("b.js", 1, "stands 2 times, 100 lines long"), ("c.js", 4, "stands 3 times, 20 lines long"), ("c.js", middle, "stands 3 times")]


def test_modes_and_verdicts(spark):
    with pytest.raises(ValueError):
        gate.collect_issues(files(spark, ("a.py", "")), mode="other")
    assert gate.verdict(gate.collect_issues(files(spark, ("a.py", "")))).first().exit_code == 0
    team = gate.collect_issues(sources.sample_files(spark), mode="team")
    assert team.where("category = 'naming'").count() and not gate.collect_issues(sources.sample_files(spark)).where("category = 'naming'").count()


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    (root / "app").mkdir(parents=True)
    (root / "app" / "good.py").write_text(GOOD)
    (root / "app" / "a b+c%.py").write_text("x = 1\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    (root / "app" / "bad.py").write_text(BAD)
    return root


def test_scans_of_a_project(spark, project):
    (project / "app" / "__init__.py").write_text("")
    (project / ".env").write_text("password = 'hunter2hunter2'\n")
    found = sources.read_project(spark, str(project), "*.py")
    assert {r.path for r in found.collect()} == {"app/good.py", "app/bad.py", "app/a b+c%.py", "app/__init__.py"}
    assert ".env" in {r.path for r in sources.read_project(spark, str(project)).collect()}
    assert sources.git_changes(str(project)) == [".env", "app/__init__.py", "app/bad.py"]
    assert {r.path for r in cli.scan(spark, str(project), "diff").collect()} == {"app/bad.py", ".env"}
    assert gate.verdict(cli.scan(spark, str(project))).first().exit_code == 2


def test_roots_however_they_are_written(spark, project, monkeypatch):
    (project / "project").mkdir()
    (project / "project" / "deep.py").write_text("x = 1\n")
    whole = {"app/good.py", "app/bad.py", "app/a b+c%.py", "project/deep.py"}
    monkeypatch.chdir(project)
    home = os.getcwd()
    for root in (str(project), f"{project}/", f"file://{project}", f"{project}/app/.."):
        assert {r.path for r in sources.read_project(spark, root).collect()} == whole, root
    if spark.sparkContext._jvm.java.lang.System.getProperty("user.dir") != home:  # Java's working directory is fixed
        root = os.path.relpath(project, spark.sparkContext._jvm.java.lang.System.getProperty("user.dir"))
        assert {r.path for r in sources.read_project(spark, root).collect()} == whole
    assert sources._qualified(spark, ".")[1] == spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    assert sources.git_changes(str(project / "app")) == ["bad.py"]
    assert {r.path for r in cli.scan(spark, str(project / "app"), "diff").collect()} == {"bad.py"}


def key_rows(df):
    return sorted(tuple(r) for r in df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in d.ISSUE]).collect())


def test_scans_with_kept_facts_open_what_has_changed(spark, tmp_path):
    root, store = tmp_path / "p", str(tmp_path / "facts")
    (root / "app" / "domain").mkdir(parents=True)
    block = "".join(f"line_{k} = {k}\n" for k in range(7))
    for k in range(60):
        (root / "app" / f"m{k}.py").write_text(f"import app.m{k + 1}\n" + (block if k < 2 else f"x{k} = {k}\n"))
    (root / "app" / "domain" / "__init__.py").write_text("from app import m3\n")
    (root / "app" / "web.ts").write_text("function do_it() { try { a(); } catch (e) { } }\nfunction doThis() { }\nfunction doThat() { }\n")
    rule = Rule("R", "", "info", "python", r"\bx7\b", "m", "")
    same = lambda facts, *rules, **how: key_rows(gate.issues_of(facts, "team", **how)) == key_rows(gate.collect_issues(sources.read_project(spark, str(root)), list(rules), "team", **how))
    first = stored.refresh(spark, str(root), store)
    assert (first.opened, first.version) == (62, 1) and same(first.facts)
    assert stored.refresh(spark, str(root), store).opened == 0
    (root / "app" / "m5.py").write_text("import app.m4\n" + block)  # a circle, and a third copy
    status = (root / "app" / "m9.py").stat()
    (root / "app" / "m9.py").write_text("y" + (root / "app" / "m9.py").read_text()[1:])  # behind the listing's back: nobody may open it
    os.utime(root / "app" / "m9.py", ns=(status.st_atime_ns, status.st_mtime_ns))
    second = stored.refresh(spark, str(root), store)
    assert (second.opened, second.version) == (1, 2)
    (root / "app" / "m9.py").write_text("i" + (root / "app" / "m9.py").read_text()[1:])
    os.utime(root / "app" / "m9.py", ns=(status.st_atime_ns, status.st_mtime_ns))
    assert same(second.facts)
    changed = spark.createDataFrame([("app/m5.py",)], "path string")
    found = key_rows(gate.issues_of(second.facts, "diff", changed))
    assert found == key_rows(gate.collect_issues(sources.read_project(spark, str(root)), (), "diff", changed=changed))
    assert {r[2] for r in found} == {"dependency_cycle", "duplicate_block"}
    (root / "app" / "m1.py").unlink()
    (root / "app" / ".env").write_text("token = 'abcdefgh'\n")
    third = stored.refresh(spark, str(root), store)
    assert (third.opened, third.version) == (1, 3) and same(third.facts)
    ruled = stored.refresh(spark, str(root), store, [rule])  # other rules: all facts anew
    assert ruled.opened == 62 and same(ruled.facts, rule) and "R" in {r.rule_id for r in gate.issues_of(ruled.facts).collect()}
    with pytest.raises(ValueError):
        stored.refresh(spark, str(root), str(root / "facts"))


def test_versions_of_facts_are_merged_and_cut_short_ones_written_again(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "p", str(tmp_path / "facts")
    root.mkdir()
    monkeypatch.setattr(stored, "VERSIONS", 3)
    for k in range(5):
        (root / f"f{k}.py").write_text(f"password = 'hunter{k}hunter{k}'\n")
        if k == 3:  # a run that died before its last table
            os.makedirs(f"{store}/version=9/files")
        facts = stored.refresh(spark, str(root), store).facts
        assert {r.path for r in facts.files.collect()} == {f"f{i}.py" for i in range(k + 1)}
        assert len(stored._metas(spark, store)) <= 3
    assert key_rows(gate.issues_of(facts)) == key_rows(gate.collect_issues(sources.read_project(spark, str(root))))


def test_command_line_with_kept_facts(spark, project, tmp_path):
    store = str(tmp_path / "kept")
    for _ in range(2):
        assert key_rows(cli.scan(spark, str(project), "diff", facts=store)) == key_rows(cli.scan(spark, str(project), "diff"))
    assert stored.versions(spark, store) == [1]


def test_the_project_source(spark, tmp_path):
    root = tmp_path / "a b%c"
    for name in ("x.py", "_y.py", ".hid/z.py", ".git/no.py", "deep/er/__init__.py", "deep/.git/no.py", "bin.dat", "deep/é.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"\xff\x00" if name == "bin.dat" else name.encode())
    (root / "deep" / "loop").symlink_to(root)
    (root / "broken.py").symlink_to(root / "nothing")
    whole = {n: n for n in ("x.py", "_y.py", ".hid/z.py", "deep/er/__init__.py", "deep/é.py")}
    for tasks in (1, 2, 64):
        for uri in (str(root), root.as_uri()):
            rows = spark.read.format("project").option("path", uri).option("tasks", tasks).option("pattern", "*.py").load().collect()
            assert {r.path: r.content for r in rows} == whole and all(r.size == len(r.content.encode()) for r in rows)
    rows = sources.list_project(spark, str(root)).collect()
    assert {r.path for r in rows} == {*whole, "bin.dat"} and all(r.modified > 0 for r in rows)
    assert {r.path: r.content for r in sources.read_project(spark, str(root)).collect()}["bin.dat"] == "\ufffd\x00"
    many = tmp_path / "many"
    many.mkdir()
    for k in range(30):
        (many / f"f{k}").write_text("")
    reader = source.ProjectReader({"path": str(many)})
    assert len(reader.partitions()) == 1
    source.FILES, before = 7, source.FILES
    try:
        parts = reader.partitions()
        assert len(parts) == 5 and sorted(p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist()) == sorted(f"f{k}" for k in range(30))
    finally:
        source.FILES = before
    with pytest.raises(ValueError):
        source.opened("viewfs://store/x")


def test_changes_are_judged_with_what_is_unchanged(spark):
    table = files(spark, ("app/domain/a.py", "import app.infra.b\n"), ("app/infra/b.py", "import app.domain.a\n" + "".join(f"v{k} = {k}\n" for k in range(6))), ("app/c.py", "".join(f"v{k} = {k}\n" for k in range(6)) + "password = 'hunter2hunter2'\n"))
    changed = lambda *paths: {(r.path, r.rule_id) for r in gate.collect_issues(table, mode="diff", changed=spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert changed("app/domain/a.py") == {("app/domain/a.py", "layer_violation"), ("app/domain/a.py", "dependency_cycle")}
    assert changed("app/infra/b.py") == {("app/infra/b.py", "dependency_cycle"), ("app/infra/b.py", "duplicate_block")}
    assert changed("gone.py") == set()


def test_json_rpc(spark, project):
    call = lambda k, **params: {"id": k, "method": "tools/call", "params": params}
    requests = [{"id": 1, "method": "initialize"}, {"method": "note"}, {"id": 2, "method": "tools/list"}, call(3, name="verdict"), call(4, name="scan", arguments={"limit": 2}), {"id": 5, "method": "other"}]
    requests += [7, {"id": 8}, call(9, name="scan", arguments={"mode": "zzz"}), call(10, name="none"), {"id": 11, "method": "tools/call", "params": [1]}, call(12, name="scan", arguments=3)]
    lines = io.StringIO("\n".join([*map(json.dumps, requests), "not json"]))
    answers = [json.loads(x) for x in cli.answer(spark, str(project), lines)]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, 5, None, 8, 9, 10, 11, 12, None]
    assert answers[2]["result"]["content"][0]["text"] == "2"
    first, *issues = [json.loads(x["text"]) for x in answers[3]["result"]["content"]]
    assert first["issues"] > 2 and [x["severity"] for x in issues] == ["block", "block"]
    assert [a["error"]["code"] for a in answers[4:]] == [-32601, -32600, -32600, -32602, -32602, -32602, -32602, -32700]
    broken = [json.loads(x) for x in cli.answer(spark, str(project / "nothing"), [json.dumps(call(1, name="verdict")), json.dumps({"id": 2, "method": "initialize"})])]
    assert broken[0]["error"]["code"] == -32603 and "result" in broken[1]


def test_watch(spark, project, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        watch(spark, str(project), str(tmp_path / "out"), str(tmp_path / "state"), "*.py").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"bad.py"} and len(rows) == len({(r.rule_id, r.found) for r in rows})
