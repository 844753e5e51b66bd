"""Functions, classes and names of files: the one part that needs Python on the executors.

Python files are parsed into syntax trees; other languages, and Python files that don't parse, are outlined by patterns. Files
are worked on one at a time within Arrow batches, after those of no language have been filtered out and path, language and
content selected, so nothing else crosses to Python and nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.functions.text import strip_comments
from sparkquill.operators.outline import handlers, outline

#: kind: function, class, a handler's fault (empty_handler, bare_except, broad_catch), a handler that is raised or logged, or unparsable; by: tree or patterns.
SCHEMA = "path string, lang string, kind string, name string, line int, complexity int, nesting int, n_params int, n_methods int, by string"
NAMES = "path string, lang string, kind string, name string, line int"
#: In order: the first that fits names the style.
STYLES = {
    "UPPER_CASE": r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^[A-Z][A-Z0-9]+$",
    "snake_case": r"^_*[a-z][a-z0-9]*(?:_[a-z0-9]+)+$",
    "camelCase": r"^[a-z][a-z0-9]*(?:[A-Z][a-zA-Z0-9]*)+$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
    "lower": r"^_*[a-z][a-z0-9]*$",
}
_TYPED = r"\b(?:int|long|short|byte|double|float|boolean|bool|char|decimal|size_t|auto|var|String|string)\s+(\w+)\s*[=;]"
#: Declared variables, name in group 1.
VARIABLES = {
    "python": r"(?m)^[ \t]*(\w+)[ \t]*(?::[^=\n]+)?=(?!=)",
    "javascript": r"\b(?:let|const|var)\s+(\w+)",
    "java": _TYPED,
    "csharp": _TYPED,
    "cpp": _TYPED,
    "go": r"\b(\w+)\s*:=|\bvar\s+(\w+)",
    "rust": r"\blet\s+(?:mut\s+)?(\w+)",
}
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
_BLOCK = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOGGED, _LOGGER = ("debug", "info", "warning", "warn", "error", "exception", "critical", "log"), re.compile(r"(?i)log")


def _within(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes below a function, without those of functions in it."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, _FUNCTION):
            yield from _within(child)


def _depth(node: ast.AST) -> int:
    deepest = 0
    for field, value in ast.iter_fields(node):
        for child in value if isinstance(value, list) else [value]:
            if isinstance(child, ast.AST) and not isinstance(child, _FUNCTION):
                otherwise = isinstance(node, ast.If) and isinstance(child, ast.If) and field == "orelse" and len(value) == 1
                deepest = max(deepest, _depth(child) + (isinstance(child, _BLOCK) and not otherwise))
    return deepest


def _named(node: ast.AST | None) -> list[str]:
    """The last names of a handler's types."""
    nodes = node.elts if isinstance(node, ast.Tuple) else [node]
    return [x.attr if isinstance(x, ast.Attribute) else getattr(x, "id", "") for x in nodes]


def _fault(handler: ast.ExceptHandler) -> str | None:
    """What is wrong with a handler, if anything: it holds nothing, or takes all or too much and neither raises nor, if it names its type, logs."""
    if all(isinstance(x, ast.Pass) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant)) for x in handler.body):
        return "empty_handler"
    inner = [x for part in handler.body for x in ast.walk(part)]
    if any(isinstance(x, ast.Raise) for x in inner):
        return None
    if handler.type is None:
        return "bare_except"
    if not {"Exception", "BaseException"} & set(_named(handler.type)):
        return None
    logs = any(isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in _LOGGED and _LOGGER.search(ast.unparse(x.func.value)) for x in inner)
    return None if logs else "broad_catch"


def by_tree(content: str) -> list[tuple] | None:
    """(kind, name, line, complexity, nesting, n_params, n_methods) of Python text; None if it doesn't parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return None
    rows: list[tuple] = []
    for node in ast.walk(tree):
        if isinstance(node, _FUNCTION):
            inner = list(_within(node))
            decisions = sum(isinstance(x, _BRANCH) for x in inner) + sum(len(x.values) - 1 for x in inner if isinstance(x, ast.BoolOp)) + sum(len(x.ifs) for x in inner if isinstance(x, ast.comprehension))
            a = node.args
            params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            rows.append(("function", node.name, node.lineno, 1 + decisions, _depth(node), params, None))
        elif isinstance(node, ast.ClassDef):
            rows.append(("class", node.name, node.lineno, None, None, None, sum(isinstance(x, _FUNCTION) for x in node.body)))
        elif isinstance(node, ast.ExceptHandler) and (fault := _fault(node)):
            rows.append((fault, None, node.lineno, None, None, None, None))
    return rows


def measure(lang: str, content: str, trees: bool = True) -> list[tuple]:
    """(kind, name, line, complexity, nesting, n_params, n_methods, by) of a file's parts."""
    found = by_tree(content) if trees and lang == "python" else None
    if found is not None:
        return [(*row, "tree") for row in found]
    rows = [(p.kind, p.name, p.line, p.complexity, p.nesting, p.n_params, None, "patterns") if p.kind == "function" else (p.kind, p.name, p.line, None, None, None, p.n_methods, "patterns") for p in outline(content, lang)]
    rows += [(kind, None, line, None, None, None, None, "patterns") for kind, line in handlers(content, lang)]
    return [("unparsable", None, None, None, None, None, None, "tree"), *rows] if trees and lang == "python" else rows


def _each(schema: str, rows_of: Callable[[str, str], list[tuple]]):
    names = [field.split()[0] for field in schema.split(", ")]
    numbers = [field.split()[0] for field in schema.split(", ") if field.endswith(" int")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, lang, *row) for path, lang, content in zip(batch["path"], batch["lang"], batch["content"], strict=True) for row in rows_of(lang, content)]
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(numbers, "Int32"))

    return run


def _code(files: DataFrame) -> DataFrame:
    return files.where("lang != 'other' AND content IS NOT NULL").select("path", "lang", "content")


def structure(files: DataFrame, trees: bool = True) -> DataFrame:
    """SCHEMA: one row for each function, class and judged handler, and each Python file that doesn't parse. Without trees Python is outlined by patterns too."""
    return _code(files).mapInPandas(_each(SCHEMA, lambda lang, content: measure(lang, content, trees)), SCHEMA)


def names(lang: str, content: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of the functions, classes and variables that a file declares."""
    rows = [(kind, name, line) for kind, name, line, *_ in measure(lang, content) if kind in ("function", "class") and name]
    line, at = 1, 0
    for found in re.finditer(VARIABLES[lang], content):
        line += content.count("\n", at, found.start(found.lastindex))
        at = found.start(found.lastindex)
        rows.append(("variable", found[found.lastindex], line))
    return rows


def identifiers(files: DataFrame) -> DataFrame:
    """(path, lang, kind, name, line, style) of every function, class and variable."""
    style = F
    for name, pattern in STYLES.items():
        style = style.when(F.col("name").rlike(pattern), F.lit(name))
    plain = files.withColumn("content", strip_comments(F.col("content"), F.col("lang")))
    return _code(plain).mapInPandas(_each(NAMES, names), NAMES).where("name != '_'").select("*", style.otherwise("mixed").alias("style"))
