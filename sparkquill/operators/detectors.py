"""Detectors: files (path, lang, file_class, layer, content) to issues or metrics, by column expressions over one scan.

Patterns, built in or of custom rules, are rows of one constant array (Lookup), which one expression goes through for each file; so the
plan is the same for a thousand rules as for one. Each pattern stands behind a gate of words that a match can't do without, found by
plain search; so most files pass most patterns by. A match is known by file, rule, line and text, and repeats within a file are
dropped within its row: nothing is shuffled. Every detector gives ISSUE columns.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import glob_to_regex, layer_of, let, places, strip_comments
from sparkquill.operators import graph, imports
from sparkquill.session import cut
from sparkquill.sources.rules import Rule, required

ISSUE = ("path", "line", "rule_id", "category", "severity", "confidence", "found", "message")
#: Confidence of a match in raw text, in stripped text, of a syntax tree, of a dependency cycle.
RAW, STRIPPED, SYNTAX, CYCLE = 70, 80, 90, 95
LIMITS = {"complexity": 10, "nesting": 4, "params": 5, "methods": 20, "lines": 500, "block_lines": 6}
_MATCH = "array<struct<category:string,rule_id:string,severity:string,message:string,confidence:int,found:string,line:int>>"


@dataclass(frozen=True)
class Search:
    """A pattern and what a match can't do without: of each tuple one must stand in the text, in lower case."""

    pattern: str
    words: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Pattern:
    """languages: none for all."""

    severity: str
    searches: tuple[Search, ...]
    message: str
    languages: tuple[str, ...] = ()


_SECRET = r"password|passwd|api_?key|secret|token"
_SECRETS = ("password", "passwd", "apikey", "api_key", "secret", "token")
_QUOTES = ('"', "'")
_STATEMENT = (("select", "insert", "update", "delete"), _QUOTES, ("+", "%"))
_CALL = (("eval(", "exec(", "os.system("),)
_LOG = (_SECRETS, ("log", "console"), ("(",))
_HANDLER = (
    Search(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}", (("catch",), ("{",))),
    Search(r"\bexcept\b[^:\n]*:\s*(?:pass\b|\.\.\.)", (("except",), ("pass", "..."))),
    Search(r"\.catch\(\s*(?:\w+|\([^)]*\))\s*=>\s*\{\s*\}\s*\)", ((".catch(",), ("=>",))),
    Search(r"\bif\s+err\s*!=\s*nil\s*\{\s*\}", (("!=",), ("nil",))),
    Search(r"\bErr\([^)]*\)\s*=>\s*(?:\{\s*\}|\(\s*\))", (("err(",), ("=>",))),
)
#: Red lines: a pattern within lines, and one across them where that finds more.
SECURITY = {
    "hardcoded_secret": Pattern("block", (Search(rf"(?i)\b(?:{_SECRET})\s*[:=]\s*[\"'][^\"'\n]{{6,}}[\"']", (_SECRETS, (":", "="), _QUOTES)),), "a secret is written into the code"),
    "sql_concatenation": Pattern("block", (Search(r"(?i)[\"']\s*(?:select|insert|update|delete)\b[^\"'\n]*[\"']\s*[+%]", _STATEMENT), Search(r"(?is)[\"']\s*(?:select|insert|update|delete)\b[^\"']*[\"']\s*[+%]", _STATEMENT)), "a statement is put together from strings"),
    "dangerous_call": Pattern(
        "block",
        (
            Search(r"\b(?:eval|exec|os\.system)\(\s*(?:[^)\"'\s]|\"[^\"\n]*\"\s*[^)\"\s]|'[^'\n]*'\s*[^)'\s])[^)\n]*\)", _CALL),
            Search(r"(?s)\b(?:eval|exec|os\.system)\(\s*(?:[^)\"'\s]|\"[^\"\n]*\"\s*[^)\"\s]|'[^'\n]*'\s*[^)'\s])[^)]*\)", _CALL),
        ),
        "input may be run as code",
    ),
    "sensitive_log": Pattern("block", (Search(rf"(?i)\b(?:log|logger|logging|console)[.\w]*\([^)\n]*\b(?:{_SECRET})\b[^)\n]*\)", _LOG), Search(rf"(?is)\b(?:log|logger|logging|console)[.\w]*\([^)]*\b(?:{_SECRET})\b[^)]*\)", _LOG)), "sensitive data may reach a log"),
    "empty_handler": Pattern("block", _HANDLER, "an error is swallowed"),
}
EXCEPTIONS = {
    "bare_except": Pattern("warn", (Search(r"\bexcept[ \t]*:", (("except",),)), Search(r"\bcatch[ \t]*\{", (("catch",),))), "catches everything", ("python", "csharp")),
    "broad_catch": Pattern("warn", (Search(r"\bexcept[ \t]*\(?[ \t]*(?:Base)?Exception\b", (("except",), ("exception",))), Search(r"\bcatch[ \t]*\([ \t]*(?:final[ \t]+)?(?:Exception|Throwable)\b", (("catch",), ("exception", "throwable"))), Search(r"\bcatch[ \t]*\([ \t]*\.\.\.", (("catch",), ("...",)))), "catches more than it can handle", ("python", "java", "csharp", "cpp")),
    "ignored_error": Pattern("warn", (Search(r"\b_[ \t]*:?=[ \t]*[\w.:]+\(", (("_",), ("=",))),), "an error is dropped", ("go", "rust")),
    "may_panic": Pattern("warn", (Search(r"\.unwrap\(\)", ((".unwrap(",),)), Search(r"\.expect\([^)\n]*\)", ((".expect(",),)), Search(r"\bpanic\(", (("panic(",),))), "an error ends the program", ("go", "rust")),
}


#: Rules of handlers, the one that counts where several hold first: category, rule, pattern.
HANDLERS = (("security", "empty_handler", SECURITY["empty_handler"]), *(("exception_handling", rule, EXCEPTIONS[rule]) for rule in ("bare_except", "broad_catch")))


def with_code(files: DataFrame) -> DataFrame:
    """files with code: the text without comments, or as it is for languages without a stripper."""
    return files.withColumn("code", strip_comments(F.col("content"), F.col("lang")))


@dataclass(frozen=True)
class Lookup:
    """A pattern and where it is looked for: in files of languages, of a layer or with a path like glob (None: all), in their code or in their
    whole content; words as of Search. raw and stripped: the confidence of a match in files without and with a comment stripper."""

    category: str
    rule_id: str
    severity: str
    message: str
    pattern: str
    words: tuple[tuple[str, ...], ...] = ()
    languages: tuple[str, ...] | None = None
    layer: str | None = None
    glob: str | None = None
    in_code: bool = True
    raw: int = STRIPPED
    stripped: int = STRIPPED


_LOOKUP = "array<struct<category:string,rule_id:string,severity:string,message:string,pattern:string,words:array<array<string>>,languages:array<string>,layer:string,glob:string,in_code:boolean,raw:int,stripped:int>>"


def _lookups(category: str, rules: dict[str, Pattern], raw: int) -> list[Lookup]:
    return [Lookup(category, rule, p.severity, p.message, x.pattern, x.words, p.languages or None, raw=raw) for rule, p in rules.items() for x in p.searches]


def security_lookups(rules: dict[str, Pattern] = SECURITY) -> list[Lookup]:
    """Red lines by three passes: raw text, text without comments, and that across lines.

    A match that stripped text has holds at STRIPPED. One that the raw text alone has stood in a comment and is dropped; so where
    comments can be stripped the raw pass only decides, by its words, whether the others are made. Files of languages without
    a stripper have their raw text matched, at RAW."""
    return _lookups("security", rules, RAW)


def exception_lookups() -> list[Lookup]:
    """All rules of handlers but the red line."""
    return _lookups("exception_handling", EXCEPTIONS, STRIPPED)


def custom_lookups(rules: Sequence[Rule]) -> list[Lookup]:
    """Every match of each rule's pattern in the raw text of files in its scope."""
    return [Lookup("custom", r.id, r.severity, r.message, r.pattern, required(r.pattern), (r.target,) if r.kind == "language" else None, r.target if r.kind == "layer" else None, glob_to_regex(r.target) if r.kind == "glob" else None, False, RAW, RAW) for r in rules]


def looked_up(lookups: Sequence[Lookup]) -> Column:
    """The matches of lookups in a file (path, lang, layer, content, code)."""
    if not lookups:
        return F.array().cast(_MATCH)
    table = F.from_json(F.lit(json.dumps([vars(x) for x in lookups])), _LOOKUP)

    words = F.from_json(F.lit(json.dumps(sorted({word for x in lookups for any_of in x.words for word in any_of}))), "array<string>")

    def applies(x: Column, held: Column) -> Column:
        where = (x["languages"].isNull() | F.array_contains(x["languages"], F.col("lang"))) & (x["layer"].isNull() | (x["layer"] == F.col("layer"))) & (x["glob"].isNull() | F.coalesce(F.rlike("path", x["glob"]), F.lit(False)))
        return where & F.forall(x["words"], lambda any_of: F.arrays_overlap(any_of, held))

    def of_one(x: Column, code: Column) -> Column:
        named = lambda hit: F.struct(x["category"], x["rule_id"], x["severity"], x["message"], F.when(F.col("lang") == "other", x["raw"]).otherwise(x["stripped"]).alias("confidence"), hit["found"], hit["line"])
        return F.transform(F.array_distinct(places(F.when(x["in_code"], code).otherwise(F.col("content")), x["pattern"])), named)

    # Within let both texts are computed once; as columns they would be drawn into the lambdas, and computed for each word.
    held = let(F.lower("content"), lambda lower: F.filter(words, lambda word: lower.contains(word)))
    found = let(held, lambda held: F.filter(table, lambda x: applies(x, held)))
    every = lambda fitting: F.when(F.size(fitting) == 0, F.array().cast(_MATCH)).otherwise(let(F.col("code"), lambda code: F.flatten(F.transform(fitting, lambda x: of_one(x, code)))).cast(_MATCH))
    return F.coalesce(let(found, every), F.array().cast(_MATCH))


def _no_matches() -> Column:
    return F.array().cast(_MATCH)


def _match(category: str, rule: str, severity: str, message: str | Column, confidence: Column, found: Column, line: Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), message.alias("message"), confidence.cast("int").alias("confidence"), found.alias("found"), line.cast("int").alias("line"))


def _over(category: str, value: Column, found: Column, line: Column, confidence: Column) -> Column:
    return _match(category, f"too_high_{category}", "warn", F.concat(value.cast("string"), F.lit(" is over the limit")), confidence, found, line)


def size_matches() -> list[Column]:
    """Files of too many lines, and of braces nested too deep; Python's nesting is measured for each function instead."""
    depth, lines, nothing = _depth(F.col("code")), n_lines(F.col("content")), F.lit("")
    code = F.col("lang").isin("javascript", "java", "csharp", "cpp")
    return [
        F.when(lines > LIMITS["lines"], F.array(_over("lines", lines, nothing, F.lit(1), F.lit(STRIPPED)))).otherwise(_no_matches()),
        F.when(code, F.filter(F.array(_over("nesting", depth, nothing, F.lit(1), F.lit(STRIPPED))), lambda x: depth > LIMITS["nesting"])).otherwise(_no_matches()),
    ]


def matches(lookups: Sequence[Lookup], further: Sequence[Column] = ()) -> Column:
    """The matches of a file (path, lang, layer, content, code), and the further ones, each once; of a handler that swallows its error nothing else
    is said: what a less rule finds begins as the red line's match does, in the same line."""

    def once(found: Column) -> Column:
        empty = F.filter(found, lambda x: x["rule_id"] == "empty_handler")
        less = lambda x, swallowing: x["rule_id"].isin("bare_except", "broad_catch") & F.exists(swallowing, lambda y: (x["line"] == y["line"]) & F.startswith(y["found"], x["found"]))
        return let(empty, lambda swallowing: F.when(F.size(swallowing) == 0, found).otherwise(F.filter(found, lambda x: ~F.coalesce(less(x, swallowing), F.lit(False)))))

    return let(F.array_distinct(F.flatten(F.array(looked_up(lookups), *further))), once)


def hits(files: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """ISSUE rows of lookups. The array goes into the generator as it is: of a column the optimizer would test the size first, and so
    compute it twice."""
    return with_code(files).select("path", F.inline(matches(lookups))).select(*ISSUE)


def three_scans(files: DataFrame) -> DataFrame:
    return hits(files, security_lookups())


def rule_hits(files: DataFrame, rule: str) -> DataFrame:
    """Matches of one red line: path, found, n."""
    rows = hits(files, security_lookups({rule: SECURITY[rule]}))
    return rows.groupBy("path", "found").agg(F.count("*").alias("n"))


def exception_issues(files: DataFrame) -> DataFrame:
    """Issues of handlers, red line included."""
    return hits(files, [*security_lookups({"empty_handler": SECURITY["empty_handler"]}), *exception_lookups()])


def custom_issues(files: DataFrame, rules: list[Rule]) -> DataFrame:
    return hits(files, custom_lookups(rules))


def rule_scope(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, path): the files that each rule's target takes in."""
    ids = F.array_compact(F.array(*[F.when(rule.fits(), F.lit(rule.id)) for rule in rules])) if rules else F.array().cast("array<string>")
    return files.select(F.explode(ids).alias("id"), "path")


# ---------------------------------------------------------------- metrics


def n_lines(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def file_sizes(files: DataFrame) -> DataFrame:
    return files.select("path", F.length("content").alias("n_chars"), n_lines(F.col("content")).alias("n_lines"))


def _depth(text: Column) -> Column:
    """The greatest depth of braces, folded within the row."""

    def step(state, brace):
        depth = state["depth"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.greatest(state["most"], depth).alias("most"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0)), start, step)["most"]


def brace_nesting(texts: DataFrame) -> DataFrame:
    """(path, max_depth) of braces in texts (path, content): no shuffle."""
    return texts.select("path", _depth(F.col("content")).alias("max_depth"))


def structure_issues(parts: DataFrame) -> DataFrame:
    """Functions and classes of structure() that exceed LIMITS, and empty handlers of syntax trees."""
    found, confidence = F.coalesce("name", F.lit("")), F.when(F.col("by") == "tree", SYNTAX).otherwise(STRIPPED)
    limits = (("complexity", "complexity", F.lit(True)), ("nesting", "nesting", F.col("lang") == "python"), ("params", "n_params", F.lit(True)), ("methods", "n_methods", F.col("lang").isin("python", "java", "csharp")))
    over = [F.when((F.col(column) > LIMITS[category]) & applies, _over(category, F.col(column), found, F.col("line"), confidence)) for category, column, applies in limits]
    faults = [F.when(F.col("kind") == rule, _match(category, rule, p.severity, p.message, confidence, found, F.col("line"))) for category, rule, p in HANDLERS]
    return parts.select("path", F.inline(F.array_compact(F.array(*over, *faults)))).select(*ISSUE).distinct()


def unparsed(found: DataFrame, parts: DataFrame) -> DataFrame:
    """found (path, lang, rule_id, ...) without what patterns say of handlers in Python files that parse, where trees have judged them."""
    rules = [rule for _, rule, _ in HANDLERS]
    judged = (F.col("lang") == "python") & F.col("rule_id").isin(*rules)
    return found.where(~judged).unionByName(found.where(judged).join(parts.where("kind = 'unparsable'").select("path"), "path", "left_semi"))


def unhandled(found: DataFrame, parts: DataFrame) -> DataFrame:
    """found (path, line, rule_id, ...) without handlers of everything that raise again, and broad ones that at least log, as outlines tell by their bodies."""
    caught = F.col("rule_id").isin("bare_except", "broad_catch")
    acts = parts.where("kind IN ('raised', 'logged')").select(F.col("path").alias("of"), "kind", F.col("line").alias("begin"))
    acted = (F.col("path") == F.col("of")) & (F.col("line") == F.col("begin")) & ((F.col("kind") == "raised") | (F.col("rule_id") == "broad_catch"))
    return found.where(~caught).unionByName(found.where(caught).join(acts, acted, "left_anti"))


# ---------------------------------------------------------------- duplicates


def blocks_of(size: int = LIMITS["block_lines"]) -> Column:
    """array<struct<at, line, hash>> of every run of size lines of content, trimmed, without blank ones; at counts the runs from 1, line is where one
    starts, hash its MD5."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.struct(F.trim(x).alias("text"), (i + 1).alias("line"))), lambda x: x["text"] != "")

    def runs(lines: Column) -> Column:
        one = lambda texts: F.transform(F.sequence(F.lit(1), F.size(texts) - (size - 1)), lambda i: F.struct(i.alias("at"), F.get(lines, i - 1)["line"].alias("line"), F.unhex(F.md5(F.array_join(F.slice(texts, i, F.lit(size)), "\n").cast("binary"))).alias("hash")))
        return F.when(F.size(lines) >= size, let(lines.getField("text"), one)).otherwise(F.array().cast("array<struct<at:int,line:int,hash:binary>>"))

    return F.coalesce(let(lines, runs), F.array().cast("array<struct<at:int,line:int,hash:binary>>"))


def line_blocks(files: DataFrame, size: int = LIMITS["block_lines"]) -> DataFrame:
    """(path, at, line, hash) of blocks_of each file."""
    return files.select("path", F.inline(blocks_of(size)))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def duplicate_blocks(files: DataFrame, size: int = LIMITS["block_lines"]) -> DataFrame:
    """(hash, occurrences, n_files, first_path) of blocks that stand more than once."""
    blocks = line_blocks(files, size).groupBy("hash", "path").agg(F.count("*").alias("n"))
    return blocks.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_files"), F.min("path").alias("first_path")).where("occurrences > 1").withColumn("hash", _hex(F.col("hash")))


def duplicate_files(files: DataFrame) -> DataFrame:
    """(hash, copies, first_path) of contents that more than one file has."""
    return files.groupBy(F.md5(F.col("content").cast("binary")).alias("hash")).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def duplicate_regions(blocks: DataFrame, only: DataFrame | None = None, size: int = LIMITS["block_lines"]) -> DataFrame:
    """(path, line, last_line, n, times, hash) of each region of n adjacent blocks (path, at, line, hash) that stand more than once, or of those in the
    paths of only; times: how often the rarest stands. Blank lines in the last block aren't counted for last_line.

    Counts by hash meet the blocks again, and adaptive execution splits a block that is everywhere. Blocks that follow each other in a
    file are one region, found by a window over what a single file repeats."""
    own = blocks if only is None else blocks.join(only, "path", "left_semi")
    counted = blocks if only is None else blocks.join(own.select("hash").distinct(), "hash", "left_semi")
    counts = counted.groupBy("hash").agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    runs = own.join(counts, "hash").withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy("path").orderBy("at")))
    rows = runs.groupBy("path", "island").agg(F.min(F.struct("at", "line", "hash")).alias("first"), (F.max("line") + size - 1).alias("last_line"), F.count("*").alias("n"), F.min("occurrences").alias("times"))
    return rows.select("path", F.col("first.line").cast("int").alias("line"), "last_line", "n", "times", _hex(F.col("first.hash")).alias("hash"))


def duplicate_issues(regions: DataFrame, size: int = LIMITS["block_lines"]) -> DataFrame:
    """An issue for each of duplicate_regions."""
    long = F.when(F.col("n") > 1, F.concat(F.lit(", "), (F.col("n") + size - 1).cast("string"), F.lit(" lines long"))).otherwise("")
    return regions.select("path", "line", F.lit("duplicate_block").alias("rule_id"), F.lit("duplicate_code").alias("category"), F.lit("warn").alias("severity"), F.lit(STRIPPED).alias("confidence"), F.col("hash").alias("found"), F.concat(F.lit("stands "), F.col("times").cast("string"), F.lit(" times"), long).alias("message"))


def renamed_issues(renamed: DataFrame, exact: DataFrame) -> DataFrame:
    """An issue for each of copies.regions but those that lie by half of their lines or more in one of duplicate_regions, which says it already."""
    a, b = renamed.alias("a"), exact.select("path", F.col("line").alias("begin"), F.col("last_line").alias("end")).alias("b")
    common = F.least("a.last_line", "b.end") - F.greatest("a.line", "b.begin") + 1
    rows = a.join(b, (F.col("a.path") == F.col("b.path")) & (2 * common >= F.col("a.last_line") - F.col("a.line") + 1), "left_anti")
    message = F.concat(F.lit("to line "), F.col("last_line").cast("string"), F.lit(" stands "), F.col("n_places").cast("string"), F.lit(" times but for names and literals"))
    return rows.select("path", "line", F.lit("renamed_copy").alias("rule_id"), F.lit("duplicate_code").alias("category"), F.lit("warn").alias("severity"), F.lit(STRIPPED).alias("confidence"), F.col("hash").alias("found"), message.alias("message"))


# ---------------------------------------------------------------- names


def naming_issues(names: DataFrame) -> DataFrame:
    """Names of identifiers() whose style isn't the most frequent one of their language and kind (function, class, variable); single
    lower-case words and names in capitals fit any; ties go to the first style by name."""
    styled = names.where("style NOT IN ('lower', 'UPPER_CASE')")
    counts = styled.groupBy("lang", "kind", "style").agg(F.count("*").alias("n"))
    usual = counts.groupBy("lang", "kind").agg(F.min(F.struct((-F.col("n")).alias("less"), "style"))["style"].alias("usual"))
    rows = styled.join(usual, ["lang", "kind"]).where("style != usual").groupBy("path", "kind", "name", "style", "usual").agg(F.min("line").alias("line"))
    return rows.select("path", "line", F.lit("naming_style").alias("rule_id"), F.lit("naming").alias("category"), F.lit("info").alias("severity"), F.lit(STRIPPED).alias("confidence"), F.col("name").alias("found"), F.concat("kind", F.lit(" is "), "style", F.lit(" among "), "usual").alias("message"))


# ---------------------------------------------------------------- dependencies


def facts(rows: DataFrame) -> DataFrame:
    """(path, lang, imports, package, roots) of files with code."""
    return rows.select("path", "lang", imports.candidates().alias("imports"), imports.package().alias("package"), imports.roots().alias("roots")).where("lang != 'other' OR roots IS NOT NULL")


def dependency_edges(files: DataFrame) -> DataFrame:
    """(src, dst): a file imports another one, or a package (a path that ends in a slash); an imported package has a file."""
    return imports.edges(cut(facts(with_code(files))))


def layer_violations(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """(src, dst, src_layer, dst_layer): imports between layers that allowed (src_layer, dst_layer) doesn't have."""
    edges = edges.where(~F.col("src").endswith("/")).select("src", "dst", layer_of(F.col("src")).alias("src_layer"), layer_of(F.col("dst")).alias("dst_layer"))
    return edges.where("src_layer != 'none' AND dst_layer != 'none' AND src_layer != dst_layer").join(F.broadcast(allowed), ["src_layer", "dst_layer"], "left_anti").select("src", "dst", "src_layer", "dst_layer")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(path, component, n_nodes, length, cycle): everything on a cycle, with a shortest cycle of its strongly connected component."""
    return graph.circles(edges).withColumnRenamed("node", "path")


def cycle_issues(edges: DataFrame) -> DataFrame:
    """An issue for each file on a cycle of any length."""
    rows = cycle_members(edges).where(~F.col("path").endswith("/"))
    return rows.select("path", F.lit(None).cast("int").alias("line"), F.lit("dependency_cycle").alias("rule_id"), F.lit("architecture").alias("category"), F.lit("block").alias("severity"), F.lit(CYCLE).alias("confidence"), F.col("cycle").alias("found"), F.concat(F.col("n_nodes").cast("string"), F.lit(" files or packages import each other in a circle")).alias("message"))


def layer_issues(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    rows = layer_violations(edges, allowed)
    return rows.select(F.col("src").alias("path"), F.lit(None).cast("int").alias("line"), F.lit("layer_violation").alias("rule_id"), F.lit("architecture").alias("category"), F.lit("block").alias("severity"), F.lit(STRIPPED).alias("confidence"), F.col("dst").alias("found"), F.concat("src_layer", F.lit(" imports "), "dst_layer").alias("message"))
