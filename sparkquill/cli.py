"""Command line: scans a project and ends with the gate's verdict; or serves scans as JSON-RPC lines over stdio."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.plans import gate
from sparkquill.plans.facts import refresh
from sparkquill.session import ship
from sparkquill.sources import files
from sparkquill.sources import rules as sources

RULES = ".quality/rules.json"
#: Issues in one answer, unless a request names a limit; the answer says how many there are.
PAGE = 1_000


def project_rules(spark: SparkSession, root: str, rules: str | None = None) -> list[sources.Rule]:
    """The rules of a catalog's path, by default the project's own, if there is one."""
    path = Path(rules) if rules else Path(root) / RULES
    return sources.valid_rules(spark, path.read_text())[0] if path.exists() else []


def scan(spark: SparkSession, root: str, mode: str = "personal", rules: str | None = None, facts: str | None = None) -> DataFrame:
    """All issues of the project at root; rules: see project_rules; facts: a folder that keeps what is known of the project, so that only
    files that have changed since the last scan are opened."""
    found = project_rules(spark, root, rules)
    changed = spark.createDataFrame([(p,) for p in files.git_changes(root)], "path string") if mode == "diff" else None
    if facts:
        return gate.issues_of(refresh(spark, root, facts, found).facts, mode, changed)
    return gate.collect_issues(files.read_project(spark, root), found, mode, changed=changed)


def constraints(spark: SparkSession, root: str, path: str, rules: str | None = None) -> list[str]:
    """The constraints that the project's rules put on a path, to be given before its code is written."""
    one = files.with_traits(spark.createDataFrame([(path, "")], "path string, content string"))
    return [r["line"] for r in gate.constraints(one, project_rules(spark, root, rules)).collect()]


def page(issues: DataFrame, limit: int = PAGE) -> list[str]:
    """The count of issues, then the worst ones, each as JSON."""
    issues = issues.cache()
    worst = issues.orderBy(gate.rank().desc(), F.desc("confidence"), "path", "line", "rule_id", "found").limit(limit)
    out = [json.dumps({"issues": issues.count(), "shown": limit}), *(r["issue"] for r in gate.as_json(worst).collect())]
    issues.unpersist()
    return out


#: What each tool needs to be told; the rest is optional.
TOOLS = {"scan": (), "verdict": (), "constraints": ("path",), "check": ("path", "content")}
_ARGUMENTS = {"mode": {"enum": list(gate.MODES)}, "limit": {"type": "integer"}, "path": {"type": "string"}, "content": {"type": "string"}}


def _call(spark: SparkSession, root: str, params: object, facts: str | None) -> list[str]:
    """The texts that a tool gives; a ValueError says what is wrong with params."""
    if not isinstance(params, dict) or params.get("name") not in TOOLS:
        raise ValueError("no such tool")
    name, arguments = params["name"], params.get("arguments") or {}
    if not isinstance(arguments, dict):
        raise ValueError("arguments must be an object")
    for needed in TOOLS[name]:
        if not isinstance(arguments.get(needed), str):
            raise ValueError(f"{needed} must be a string")
    mode, limit = arguments.get("mode", "personal"), arguments.get("limit", PAGE)
    if mode not in gate.MODES:
        raise ValueError(f"mode must be one of {', '.join(gate.MODES)}")
    if not isinstance(limit, int) or isinstance(limit, bool) or not 0 <= limit <= 100 * PAGE:
        raise ValueError(f"limit must be a number up to {100 * PAGE}")
    if name == "constraints":
        return constraints(spark, root, arguments["path"])
    if name == "check":
        text = files.with_traits(spark.createDataFrame([(arguments["path"], arguments["content"])], "path string, content string"))
        return page(gate.collect_issues(text, project_rules(spark, root)), limit)
    issues = scan(spark, root, mode, facts=facts)
    return [str(gate.verdict(issues).first()["exit_code"])] if name == "verdict" else page(issues, limit)


def answer(spark: SparkSession, root: str, lines: Iterable[str], facts: str | None = None) -> Iterator[str]:
    """JSON-RPC 2.0 answers to requests, one a line: ``initialize``, ``tools/list`` and ``tools/call`` of TOOLS. No request ends the server."""

    def failed(number: object, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}})

    for line in filter(str.strip, lines):
        try:
            request = json.loads(line)
        except ValueError:
            yield failed(None, -32700, "not JSON")
            continue
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            yield failed(request.get("id") if isinstance(request, dict) else None, -32600, "not a request")
            continue
        if "id" not in request:
            continue  # a notification
        head = {"jsonrpc": "2.0", "id": request["id"]}
        method = request["method"]
        if method == "initialize":
            yield json.dumps(head | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkquill", "version": "0.1"}}})
        elif method == "tools/list":
            yield json.dumps(head | {"result": {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": _ARGUMENTS, "required": list(needed)}} for n, needed in TOOLS.items()]}})
        elif method == "tools/call":
            try:
                text = _call(spark, root, request.get("params"), facts)
            except ValueError as wrong:
                yield failed(request["id"], -32602, str(wrong))
            except Exception as wrong:  # noqa: BLE001  a scan that fails is answered, and the next request served
                yield failed(request["id"], -32603, f"{type(wrong).__name__}: {wrong}"[:2_000])
            else:
                yield json.dumps(head | {"result": {"content": [{"type": "text", "text": x} for x in text]}})
        else:
            yield failed(request["id"], -32601, f"no such method: {method}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkquill", description=__doc__)
    parser.add_argument("--path", default=".")
    parser.add_argument("--mode", choices=gate.MODES, default="personal")
    parser.add_argument("--rules")
    parser.add_argument("--facts", help="folder outside of the project that keeps what is known of unchanged files")
    parser.add_argument("--constraints", metavar="FILE", help="print what the rules ask of a file, and end")
    parser.add_argument("--serve", action="store_true", help="answer JSON-RPC requests from stdin")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sparkquill").getOrCreate()
    ship(spark)
    if args.serve:
        for line in answer(spark, args.path, sys.stdin, args.facts):
            print(line, flush=True)
        return 0
    if args.constraints:
        print("\n".join(constraints(spark, args.path, args.constraints, args.rules)))
        return 0
    issues = scan(spark, args.path, args.mode, args.rules, args.facts).cache()
    for row in gate.as_json(issues).toLocalIterator():
        print(row["issue"])
    return gate.verdict(issues).first()["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
