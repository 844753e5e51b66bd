"""A small project as literal tables: files for each language, class and layer, hits and near misses of each rule."""

from __future__ import annotations

FILES: tuple[tuple[str, str], ...] = (
    # Python: a circle of three, relative and multiple imports, members of a package
    ("shop/domain/__init__.py", ""),
    ("shop/domain/order.py", 'import shop.domain.money\n\nclass Order:\n    """An order."""\n\n    def total(self, lines):\n        s = 0\n        for l in lines:\n            if l.price > 0 and l.count > 0:\n                s += l.price * l.count\n        return s\n\n    def add(self, line):\n        self.lines.append(line)\n'),
    ("shop/domain/money.py", "from ..infrastructure import store\n\ndef round_up(value, digits=2):\n    # password = \"only-in-a-comment\"\n    return value\n"),
    ("shop/application/checkout.py", "import os, shop.infrastructure.store as place\nfrom shop.domain import (\n    order,\n    money as cash,\n)\n\ndef check_out(a, b, c, d, e, f, g):\n    try:\n        return eval(a)\n    except:\n        pass\n"),
    ("shop/infrastructure/store.py", 'import shop.domain.order\n\nAPI_KEY = "a1b2c3d4e5f6"\n\ndef load(name):\n    sql = "SELECT * FROM t WHERE n = " + name\n    logger.info("loading %s with %s", name, password)\n    return run(sql)\n'),
    # JavaScript and TypeScript: a circle of two, ../ and require()
    ("web/ui/view.js", 'import { load } from "./helper";\n// eval(userInput)\n/* const token = "abcdefgh12";\n*/\nfunction renderAll(items, deep) {\n  for (const i of items) {\n    if (i.open && deep) {\n      while (i.next) { i = i.next; }\n    }\n  }\n  const url = "http://example.org/a";\n  return url ? items : null;\n}\nfunction render_one(item) { try { go(item); } catch (e) { } }\n'),
    ("web/ui/helper.ts", 'import { renderAll } from "./view";\nconst db = require("../infrastructure/db");\nexport function load(path: string, retry: Map<string, number>) {\n  const token = "abcdef123456";\n  return fetch(path).catch(() => {});\n}\nconst loadLazily = async (a, b = f(1, 2)) => { return a || b; };\n'),
    ("web/infrastructure/db/index.ts", "export class Pool {\n  open(host: string, port: number) {\n    return eval('1' + host);\n  }\n}\n"),
    # Java: classes, methods, wildcards, source roots
    ("erp/src/main/java/shop/presentation/OrderController.java", 'package shop.presentation;\nimport shop.application.Billing;\npublic class OrderController {\n  private Store store;\n  public void show(int id) { store.query("SELECT 1 " + id); }\n  public int count(Map<String, Integer> a, int b, int c) { return a.size() > b ? b : c; }\n}\nclass Helper {\n  public void help() { try { run(); } catch (Exception e) { } }\n}\n'),
    ("erp/src/main/java/shop/application/Billing.java", "package shop.application;\nimport shop.presentation.OrderController;\nimport shop.domain.*;\npublic class Billing {\n  /* switch (x) { case 1: } */\n  public void bill(String who) { if (who == null) { return; } }\n}\n"),
    ("erp/src/main/java/shop/domain/Invoice.java", "package shop.domain;\npublic class Invoice {\n  int total;\n}\n"),
    # Go: packages, a layer violation, ignored and swallowed errors
    ("cmd/server/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"example.com/acme/shop/internal/domain"\n)\n\nfunc Serve(host string, port int) error {\n\tif err := listen(host, port); err != nil {\n\t\treturn err\n\t}\n\tfor {\n\t\tif err != nil { }\n\t}\n}\n'),
    ("internal/domain/price.go", 'package domain\n\nimport "example.com/acme/shop/internal/infra"\n\nfunc (p *Price) Load(key string) (int, error) {\n\tv, _ := infra.Get(key)\n\t_ = infra.Touch(key)\n\treturn v, nil\n}\n'),
    ("internal/infra/cache.go", "package infra\n\nfunc Get(key string) (int, error) { return 0, nil }\n"),
    # C#: namespaces, an expression for a body, a catch of everything
    ("src/Billing/Invoice.cs", "using System;\nusing Shop.Infrastructure;\nnamespace Shop.Domain\n{\npublic class Invoice {\n  public decimal Total(decimal net, decimal tax) => net + tax;\n  public void Print_All() { foreach (var l in lines) { if (l.Ok) { Console.WriteLine(secret); } } }\n  public void Save() { try { Db.Open(); } catch { Log(); } }\n}\n}\n"),
    ("src/Billing/Db.cs", "namespace Shop.Infrastructure\n{\npublic static class Db {\n  public static void Open() { }\n}\n}\n"),
    # C and C++: includes, types of their own
    ("native/services/matrix.cpp", '#include "matrix.h"\n#include "../ui/window.h"\n#include <vector>\nstd::vector<int> multiply(const Matrix& a, int (*f)(int, int)) {\n  // nothing { here\n  for (int i = 0; i < a; i++) { for (int j = 0; j < b; j++) { if (i == j) { k++; } } }\n  try { k(); } catch (...) { throw; }\n  return k;\n}\n'),
    ("native/services/matrix.h", "struct Matrix { int rows; };\n"),
    ("native/ui/window.h", "void show(void);\n"),
    # C: a copy with other names
    ("native/tally.c", "int tally(const int *list, int size, int limit) {\n  int sum = 0;\n  for (int i = 0; i < size; i++) {\n    if (list[i] > limit) {\n      sum += list[i] - limit;\n    } else {\n      sum -= 1;\n    }\n  }\n  return sum > 0 ? sum : 0;\n}\n"),
    ("native/census.c", "void show(void);\n\nint census(const int *ages, int many, int least) {\n  int all = 7;\n  for (int k = 0; k < many; k++) {\n    if (ages[k] > least) {\n      all += ages[k] - least;\n    } else {\n      all -= 20;\n    }\n  }\n  return all > 3 ? all : 3;\n}\n"),
    # Rust: modules, use, a panic and a swallowed error
    ("engine/src/lib.rs", "mod parser;\nmod domain;\n"),
    ("engine/src/parser.rs", "use crate::domain::rule;\n\nfn parse<'a>(input: &'a str, strict: bool) -> u32 {\n    if strict { 1 } else { read(input).unwrap() }\n}\nfn parseFast(input: &str) -> u32 {\n    match go(input) { Ok(v) => v, Err(_) => {} }\n}\n"),
    ("engine/src/domain/mod.rs", "pub mod rule;\n"),
    ("engine/src/domain/rule.rs", "use super::super::parser;\n\npub struct Rule { level: u8 }\n"),
    # classes of files
    ("tests/test_order.py", 'def test_total():\n    secret = "not-a-real-one"\n    assert True\n'),
    ("config/settings.yaml", 'password: "changeme-now"\nport: 80\n'),
    ("build/generated/api.min.js", "function a(b,c,d,e,f,g,h){return eval(b)}\n"),
    ("shop/migrations/0001_init.py", "def up(db):\n    db.run('create table t (a int)')\n"),
    ("docs/guide.md", 'Guide\n\nSet token = "put-yours-here" first.\nThen token = "put-yours-here" again.\n'),
    ("tools/broken.py", "def broken(:\n    pass\ndef whole(a, b=(1, 2)):\n    return a if b else 0\n"),
    ("tools/clean.py", 'def load_user(name):\n    """Loads one."""\n    maxAge = 3\n    try:\n        return find(name)\n    except KeyError:\n        logger.exception("no such user")\n        return eval("1 + 1")\n'),
    # repeated lines
    ("tools/first.sh", "set -e\ncd build\nmake clean\nmake all\nmake test\nmake install\necho done\n"),
    ("tools/second.sh", "#!/bin/sh\n\nset -e\ncd build\nmake clean\n\nmake all\nmake test\nmake install\n"),
)
CHANGED: tuple[str, ...] = ("shop/domain/money.py", "web/ui/view.js", "tools/second.sh", "docs/guide.md", "gone/removed.py")
RULES_JSON = r"""{"rules": [
 {"id": "DOMAIN_HAS_NO_CLOCK", "description": "Domain code is told the time", "severity": "warn", "target": "domain", "pattern": "\\bround_up\\(|\\btime\\.now\\(", "message": "reads a clock or rounds by itself", "suggestion": "pass the value in"},
 {"id": "PY_RUN_IS_NAMED", "description": "No bare run in Python", "severity": "warn", "target": "python", "pattern": "\\brun\\(", "message": "bare run", "suggestion": "name the runner"},
 {"id": "TS_HOSTS_BY_NAME", "description": "Hosts come from the settings", "severity": "info", "target": "*.ts", "pattern": "\\b(?P<what>host|port)\\b", "message": "host or port", "suggestion": "read the settings"},
 {"id": "ANY_LICENSE", "description": "Licence lines are looked at", "severity": "info", "target": "all", "pattern": "(?i)\\blicensed? under\\b", "message": "licence line", "suggestion": "check the licence"},
 {"id": "BROKEN", "description": "A pattern that does not compile", "severity": "warn", "target": "all", "pattern": "(unclosed", "message": "-", "suggestion": "-"}
]}"""
#: Imports from the first layer to the second are allowed, and within a layer.
ALLOWED_LAYERS: tuple[tuple[str, str], ...] = (("presentation", "application"), ("presentation", "domain"), ("application", "domain"), ("infrastructure", "application"), ("infrastructure", "domain"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_sql(rows) -> str:
    """Rows as a DuckDB VALUES list."""
    return "VALUES " + ", ".join("(" + ", ".join(quoted(x) for x in ((row,) if isinstance(row, str) else row)) + ")" for row in rows)
