"""What the sample project holds, written down and read against its files; the SQL of oracle takes it as given."""

from __future__ import annotations

#: path, language, class, layer
TRAITS = (
    ('build/generated/api.min.js', 'javascript', 'generated', 'none'),
    ('cmd/server/main.go', 'go', 'source', 'none'),
    ('config/settings.yaml', 'other', 'config', 'none'),
    ('docs/guide.md', 'other', 'doc', 'none'),
    ('engine/src/domain/mod.rs', 'rust', 'source', 'domain'),
    ('engine/src/domain/rule.rs', 'rust', 'source', 'domain'),
    ('engine/src/lib.rs', 'rust', 'source', 'none'),
    ('engine/src/parser.rs', 'rust', 'source', 'none'),
    ('erp/src/main/java/shop/application/Billing.java', 'java', 'source', 'application'),
    ('erp/src/main/java/shop/domain/Invoice.java', 'java', 'source', 'domain'),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'java', 'source', 'presentation'),
    ('internal/domain/price.go', 'go', 'source', 'domain'),
    ('internal/infra/cache.go', 'go', 'source', 'infrastructure'),
    ('native/census.c', 'cpp', 'source', 'none'),
    ('native/services/matrix.cpp', 'cpp', 'source', 'application'),
    ('native/services/matrix.h', 'cpp', 'source', 'application'),
    ('native/tally.c', 'cpp', 'source', 'none'),
    ('native/ui/window.h', 'cpp', 'source', 'presentation'),
    ('shop/application/checkout.py', 'python', 'source', 'application'),
    ('shop/domain/__init__.py', 'python', 'source', 'domain'),
    ('shop/domain/money.py', 'python', 'source', 'domain'),
    ('shop/domain/order.py', 'python', 'source', 'domain'),
    ('shop/infrastructure/store.py', 'python', 'source', 'infrastructure'),
    ('shop/migrations/0001_init.py', 'python', 'migration', 'none'),
    ('src/Billing/Db.cs', 'csharp', 'source', 'none'),
    ('src/Billing/Invoice.cs', 'csharp', 'source', 'none'),
    ('tests/test_order.py', 'python', 'test', 'none'),
    ('tools/broken.py', 'python', 'source', 'none'),
    ('tools/clean.py', 'python', 'source', 'none'),
    ('tools/first.sh', 'other', 'source', 'none'),
    ('tools/second.sh', 'other', 'source', 'none'),
    ('web/infrastructure/db/index.ts', 'javascript', 'source', 'infrastructure'),
    ('web/ui/helper.ts', 'javascript', 'source', 'presentation'),
    ('web/ui/view.js', 'javascript', 'source', 'presentation'),
)

#: imports; a path that ends in a slash is a package
EDGES = (
    ('Shop/Infrastructure/', 'src/Billing/Db.cs'),
    ('cmd/server/main.go', 'internal/domain/'),
    ('engine/src/domain/mod.rs', 'engine/src/domain/rule.rs'),
    ('engine/src/domain/rule.rs', 'engine/src/parser.rs'),
    ('engine/src/lib.rs', 'engine/src/domain/mod.rs'),
    ('engine/src/lib.rs', 'engine/src/parser.rs'),
    ('engine/src/parser.rs', 'engine/src/domain/mod.rs'),
    ('engine/src/parser.rs', 'engine/src/domain/rule.rs'),
    ('erp/src/main/java/shop/application/Billing.java', 'erp/src/main/java/shop/presentation/OrderController.java'),
    ('erp/src/main/java/shop/application/Billing.java', 'shop/domain/'),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'erp/src/main/java/shop/application/Billing.java'),
    ('internal/domain/', 'internal/domain/price.go'),
    ('internal/domain/price.go', 'internal/infra/'),
    ('internal/infra/', 'internal/infra/cache.go'),
    ('native/services/matrix.cpp', 'native/services/matrix.h'),
    ('native/services/matrix.cpp', 'native/ui/window.h'),
    ('shop/application/checkout.py', 'shop/domain/__init__.py'),
    ('shop/application/checkout.py', 'shop/domain/money.py'),
    ('shop/application/checkout.py', 'shop/domain/order.py'),
    ('shop/application/checkout.py', 'shop/infrastructure/store.py'),
    ('shop/domain/', 'erp/src/main/java/shop/domain/Invoice.java'),
    ('shop/domain/money.py', 'shop/infrastructure/store.py'),
    ('shop/domain/order.py', 'shop/domain/money.py'),
    ('shop/infrastructure/store.py', 'shop/domain/order.py'),
    ('src/Billing/Invoice.cs', 'Shop/Infrastructure/'),
    ('web/ui/helper.ts', 'web/infrastructure/db/index.ts'),
    ('web/ui/helper.ts', 'web/ui/view.js'),
    ('web/ui/view.js', 'web/ui/helper.ts'),
)

#: imports against the layers
VIOLATIONS = (
    ('erp/src/main/java/shop/application/Billing.java', 'erp/src/main/java/shop/presentation/OrderController.java', 'application', 'presentation'),
    ('internal/domain/price.go', 'internal/infra/', 'domain', 'infrastructure'),
    ('native/services/matrix.cpp', 'native/ui/window.h', 'application', 'presentation'),
    ('shop/application/checkout.py', 'shop/infrastructure/store.py', 'application', 'infrastructure'),
    ('shop/domain/money.py', 'shop/infrastructure/store.py', 'domain', 'infrastructure'),
    ('web/ui/helper.ts', 'web/infrastructure/db/index.ts', 'presentation', 'infrastructure'),
)

#: functions, classes, empty handlers and files that don't parse: path, language, kind, name, line, complexity, nesting, parameters, methods
PARTS = (
    ('build/generated/api.min.js', 'javascript', 'function', 'a', 1, 1, 0, 7, None),
    ('cmd/server/main.go', 'go', 'function', 'Serve', 8, 4, 2, 2, None),
    ('engine/src/domain/rule.rs', 'rust', 'class', 'Rule', 3, None, None, None, 0),
    ('engine/src/parser.rs', 'rust', 'function', 'parse', 3, 2, 1, 2, None),
    ('engine/src/parser.rs', 'rust', 'function', 'parseFast', 6, 2, 2, 1, None),
    ('erp/src/main/java/shop/application/Billing.java', 'java', 'class', 'Billing', 4, None, None, None, 1),
    ('erp/src/main/java/shop/application/Billing.java', 'java', 'function', 'bill', 6, 2, 1, 1, None),
    ('erp/src/main/java/shop/domain/Invoice.java', 'java', 'class', 'Invoice', 2, None, None, None, 0),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'java', 'class', 'Helper', 8, None, None, None, 1),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'java', 'class', 'OrderController', 3, None, None, None, 2),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'java', 'function', 'count', 6, 2, 0, 3, None),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'java', 'function', 'help', 9, 2, 1, 0, None),
    ('erp/src/main/java/shop/presentation/OrderController.java', 'java', 'function', 'show', 5, 1, 0, 1, None),
    ('internal/domain/price.go', 'go', 'function', 'Load', 5, 1, 0, 1, None),
    ('internal/infra/cache.go', 'go', 'function', 'Get', 3, 1, 0, 1, None),
    ('native/census.c', 'cpp', 'function', 'census', 3, 4, 2, 3, None),
    ('native/services/matrix.cpp', 'cpp', 'function', 'multiply', 4, 5, 3, 2, None),
    ('native/services/matrix.h', 'cpp', 'class', 'Matrix', 1, None, None, None, 0),
    ('native/tally.c', 'cpp', 'function', 'tally', 1, 4, 2, 3, None),
    ('shop/application/checkout.py', 'python', 'empty_handler', None, 10, None, None, None, None),
    ('shop/application/checkout.py', 'python', 'function', 'check_out', 7, 2, 1, 7, None),
    ('shop/domain/money.py', 'python', 'function', 'round_up', 3, 1, 0, 2, None),
    ('shop/domain/order.py', 'python', 'class', 'Order', 3, None, None, None, 2),
    ('shop/domain/order.py', 'python', 'function', 'add', 13, 1, 0, 2, None),
    ('shop/domain/order.py', 'python', 'function', 'total', 6, 4, 2, 2, None),
    ('shop/infrastructure/store.py', 'python', 'function', 'load', 5, 1, 0, 1, None),
    ('shop/migrations/0001_init.py', 'python', 'function', 'up', 1, 1, 0, 1, None),
    ('src/Billing/Db.cs', 'csharp', 'class', 'Db', 3, None, None, None, 1),
    ('src/Billing/Db.cs', 'csharp', 'function', 'Open', 4, 1, 0, 0, None),
    ('src/Billing/Invoice.cs', 'csharp', 'class', 'Invoice', 5, None, None, None, 3),
    ('src/Billing/Invoice.cs', 'csharp', 'function', 'Print_All', 7, 3, 2, 0, None),
    ('src/Billing/Invoice.cs', 'csharp', 'function', 'Save', 8, 2, 1, 0, None),
    ('src/Billing/Invoice.cs', 'csharp', 'function', 'Total', 6, 1, 0, 2, None),
    ('tests/test_order.py', 'python', 'function', 'test_total', 1, 1, 0, 0, None),
    ('tools/broken.py', 'python', 'function', 'whole', 3, 2, 0, 2, None),
    ('tools/broken.py', 'python', 'unparsable', None, None, None, None, None, None),
    ('tools/clean.py', 'python', 'function', 'load_user', 1, 2, 1, 1, None),
    ('web/infrastructure/db/index.ts', 'javascript', 'class', 'Pool', 1, None, None, None, 1),
    ('web/infrastructure/db/index.ts', 'javascript', 'function', 'open', 2, 1, 0, 2, None),
    ('web/ui/helper.ts', 'javascript', 'function', 'load', 3, 2, 1, 2, None),
    ('web/ui/helper.ts', 'javascript', 'function', 'loadLazily', 7, 2, 0, 2, None),
    ('web/ui/view.js', 'javascript', 'function', 'renderAll', 5, 6, 3, 2, None),
    ('web/ui/view.js', 'javascript', 'function', 'render_one', 14, 2, 1, 1, None),
)

#: the same of Python without syntax trees
PYTHON_BY_PATTERNS = (
    ('shop/application/checkout.py', 'python', 'function', 'check_out', 7, 2, 0, 7, None),
    ('shop/domain/money.py', 'python', 'function', 'round_up', 3, 1, 0, 2, None),
    ('shop/domain/order.py', 'python', 'function', 'add', 13, 1, 0, 2, None),
    ('shop/domain/order.py', 'python', 'function', 'total', 6, 4, 0, 2, None),
    ('shop/infrastructure/store.py', 'python', 'function', 'load', 5, 1, 0, 1, None),
    ('shop/migrations/0001_init.py', 'python', 'function', 'up', 1, 1, 0, 1, None),
    ('tests/test_order.py', 'python', 'function', 'test_total', 1, 1, 0, 0, None),
    ('tools/broken.py', 'python', 'function', 'whole', 3, 2, 0, 2, None),
    ('tools/clean.py', 'python', 'function', 'load_user', 1, 2, 0, 1, None),
)

#: path, line, rule, category, severity, confidence, found, message: matches of patterns, and braces too deep
LINES = (
    ('build/generated/api.min.js', 1, 'dangerous_call', 'security', 'block', 80, 'eval(b)', 'input may be run as code'),
    ('cmd/server/main.go', 13, 'empty_handler', 'security', 'block', 80, 'if err != nil { }', 'an error is swallowed'),
    ('config/settings.yaml', 1, 'hardcoded_secret', 'security', 'block', 70, 'password: "changeme-now"', 'a secret is written into the code'),
    ('docs/guide.md', 3, 'hardcoded_secret', 'security', 'block', 70, 'token = "put-yours-here"', 'a secret is written into the code'),
    ('docs/guide.md', 4, 'hardcoded_secret', 'security', 'block', 70, 'token = "put-yours-here"', 'a secret is written into the code'),
    ('engine/src/parser.rs', 4, 'may_panic', 'exception_handling', 'warn', 80, '.unwrap()', 'an error ends the program'),
    ('engine/src/parser.rs', 7, 'empty_handler', 'security', 'block', 80, 'Err(_) => {}', 'an error is swallowed'),
    ('erp/src/main/java/shop/presentation/OrderController.java', 5, 'sql_concatenation', 'security', 'block', 80, '"SELECT 1 " +', 'a statement is put together from strings'),
    ('erp/src/main/java/shop/presentation/OrderController.java', 9, 'empty_handler', 'security', 'block', 80, 'catch (Exception e) { }', 'an error is swallowed'),
    ('internal/domain/price.go', 6, 'ignored_error', 'exception_handling', 'warn', 80, '_ := infra.Get(', 'an error is dropped'),
    ('internal/domain/price.go', 7, 'ignored_error', 'exception_handling', 'warn', 80, '_ = infra.Touch(', 'an error is dropped'),
    ('native/services/matrix.cpp', 7, 'broad_catch', 'exception_handling', 'warn', 80, 'catch (...', 'catches more than it can handle'),
    ('shop/application/checkout.py', 10, 'empty_handler', 'security', 'block', 80, 'except:\n        pass', 'an error is swallowed'),
    ('shop/application/checkout.py', 9, 'dangerous_call', 'security', 'block', 80, 'eval(a)', 'input may be run as code'),
    ('shop/domain/money.py', 3, 'DOMAIN_HAS_NO_CLOCK', 'custom', 'warn', 70, 'round_up(', 'reads a clock or rounds by itself'),
    ('shop/infrastructure/store.py', 3, 'hardcoded_secret', 'security', 'block', 80, 'API_KEY = "a1b2c3d4e5f6"', 'a secret is written into the code'),
    ('shop/infrastructure/store.py', 6, 'sql_concatenation', 'security', 'block', 80, '"SELECT * FROM t WHERE n = " +', 'a statement is put together from strings'),
    ('shop/infrastructure/store.py', 7, 'sensitive_log', 'security', 'block', 80, 'logger.info("loading %s with %s", name, password)', 'sensitive data may reach a log'),
    ('shop/infrastructure/store.py', 8, 'PY_RUN_IS_NAMED', 'custom', 'warn', 70, 'run(', 'bare run'),
    ('shop/migrations/0001_init.py', 2, 'PY_RUN_IS_NAMED', 'custom', 'warn', 70, 'run(', 'bare run'),
    ('src/Billing/Invoice.cs', 1, 'too_high_nesting', 'nesting', 'warn', 80, '', '5 is over the limit'),
    ('src/Billing/Invoice.cs', 7, 'sensitive_log', 'security', 'block', 80, 'Console.WriteLine(secret)', 'sensitive data may reach a log'),
    ('src/Billing/Invoice.cs', 8, 'bare_except', 'exception_handling', 'warn', 80, 'catch {', 'catches everything'),
    ('tests/test_order.py', 2, 'hardcoded_secret', 'security', 'block', 80, 'secret = "not-a-real-one"', 'a secret is written into the code'),
    ('web/infrastructure/db/index.ts', 2, 'TS_HOSTS_BY_NAME', 'custom', 'info', 70, 'host', 'host or port'),
    ('web/infrastructure/db/index.ts', 2, 'TS_HOSTS_BY_NAME', 'custom', 'info', 70, 'port', 'host or port'),
    ('web/infrastructure/db/index.ts', 3, 'TS_HOSTS_BY_NAME', 'custom', 'info', 70, 'host', 'host or port'),
    ('web/infrastructure/db/index.ts', 3, 'dangerous_call', 'security', 'block', 80, "eval('1' + host)", 'input may be run as code'),
    ('web/ui/helper.ts', 4, 'hardcoded_secret', 'security', 'block', 80, 'token = "abcdef123456"', 'a secret is written into the code'),
    ('web/ui/helper.ts', 5, 'empty_handler', 'security', 'block', 80, '.catch(() => {})', 'an error is swallowed'),
    ('web/ui/view.js', 14, 'empty_handler', 'security', 'block', 80, 'catch (e) { }', 'an error is swallowed'),
)

#: names of another style than most of their language and kind
NAMING = (
    ('src/Billing/Invoice.cs', 7, 'naming_style', 'naming', 'info', 80, 'Print_All', 'function is mixed among PascalCase'),
    ('web/ui/view.js', 14, 'naming_style', 'naming', 'info', 80, 'render_one', 'function is snake_case among camelCase'),
)

#: Comments of the sample: path, comment, what stays of it (its line ends).
COMMENTS = (
    ("shop/domain/money.py", '# password = "only-in-a-comment"', ""),
    ("web/ui/view.js", "// eval(userInput)", ""),
    ("web/ui/view.js", '/* const token = "abcdefgh12";\n*/', "\n"),
    ("erp/src/main/java/shop/application/Billing.java", "/* switch (x) { case 1: } */", ""),
    ("native/services/matrix.cpp", "// nothing { here", ""),
)
#: Dangerous calls of Python files that parse, and what reaches them: found by reading the files. The one of tools/clean.py has a literal, so no
#: pattern finds it; tests hold the other cases.
REACHED: tuple[tuple[str, int, str], ...] = (("shop/application/checkout.py", 9, "parameter a of check_out in shop/application/checkout.py"),)
