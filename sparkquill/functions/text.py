"""Column functions over paths and source text. No pattern repeats a group other than possessively: see _DOUBLE."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "python": r"\.pyi?$",
    "javascript": r"\.(js|jsx|mjs|ts|tsx)$",
    "java": r"\.java$",
    "go": r"\.go$",
    "csharp": r"\.cs$",
    "cpp": r"\.(c|h|cc|cpp|cxx|hpp)$",
    "rust": r"\.rs$",
}
#: In order: the first that fits names the class; else it is source.
CLASSES = {
    "test": r"(^|/)(tests?|__tests__|spec)/|(_test|_spec|\.test|\.spec)\.[a-z]+$|(^|/)test_[^/]*$",
    "generated": r"(^|/)(generated|gen|dist|build)/|\.(min|pb|generated)\.[a-z]+$|_pb2\.py$",
    "migration": r"(^|/)migrations?/",
    "config": r"\.(json|ya?ml|toml|ini|cfg|conf|env|properties)$",
    "doc": r"\.(md|rst|txt|adoc)$|(^|/)docs?/",
}
LAYERS = {
    "domain": r"(^|/)(domain|entities)/",
    "application": r"(^|/)(application|services?|usecases?)/",
    "infrastructure": r"(^|/)(infrastructure|infra|persistence|repositories)/",
    "presentation": r"(^|/)(presentation|controllers?|views?|api|ui)/",
}
# Java recurses once a turn of a repeated group, unless it is possessive: then it is a loop, and a literal may have any number of
# escapes. What can follow a turn can't begin another one, so giving nothing back loses no match.
_DOUBLE, _SINGLE, _BACK = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
#: What stands in group 1 stays: string literals, matched first so that no comment starts within one.
COMMENTS = {
    "python": rf'("""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|{_DOUBLE}|{_SINGLE})|#[^\n]*',
    "javascript": rf"({_DOUBLE}|{_SINGLE}|{_BACK})|//[^\n]*|/\*[\s\S]*?\*/",
    "java": rf"({_DOUBLE}|{_SINGLE})|//[^\n]*|/\*[\s\S]*?\*/",
    "go": rf"({_DOUBLE}|{_BACK})|//[^\n]*|/\*[\s\S]*?\*/",
    "csharp": rf"({_DOUBLE}|{_SINGLE})|//[^\n]*|/\*[\s\S]*?\*/",
    "cpp": rf"({_DOUBLE}|{_SINGLE})|//[^\n]*|/\*[\s\S]*?\*/",
    "rust": rf"({_DOUBLE})|//[^\n]*|/\*[\s\S]*?\*/",
}


def first_fit(column: Column, patterns: dict[str, str], otherwise: str | None) -> Column:
    out = F
    for name, pattern in patterns.items():
        out = out.when(column.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def language_of(path: Column) -> Column:
    return first_fit(F.lower(path), LANGUAGES, "other")


def class_of(path: Column) -> Column:
    return first_fit(F.lower(path), CLASSES, "source")


def layer_of(path: Column) -> Column:
    return first_fit(F.lower(path), LAYERS, "none")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once."""
    return F.transform(F.array(value), f)[0]


def _without_comments(content: Column, pattern: Column) -> Column:
    """content without comments but with the newlines within them, so that lines keep their numbers."""
    pieces, found = F.split(content, pattern, -1), F.regexp_extract_all(content, pattern, F.lit(0))
    kept = F.transform(found, lambda x: F.when(x.startswith("/"), F.regexp_replace(x, "[^\n]+", "")).otherwise(x))
    return F.array_join(F.zip_with(pieces, F.concat(kept, F.array(F.lit(""))), lambda piece, x: F.concat(piece, x)), "")


def strip_comments(content: Column, lang: Column) -> Column:
    """content without comments, lines kept apart; of a language without a stripper it is unchanged."""
    pattern = F.create_map(*[F.lit(x) for pair in COMMENTS.items() for x in pair])[lang]

    def stripped(pattern: Column) -> Column:
        plain = F.regexp_replace(content, pattern, F.lit("$1"))
        return F.when(pattern.isNull(), content).when((lang == "python") | ~content.contains("/*"), plain).otherwise(_without_comments(content, pattern))

    return let(pattern, stripped)


#: Characters that mark where a match begins and ends.
_OPEN, _SHUT = "\x01", "\x02"
PLACES = "array<struct<found:string,line:int>>"


def _lines_of(marked: Column) -> Column:
    """The 1-based line of each _OPEN, in order: one pass over the lines."""
    return F.flatten(F.transform(F.split(marked, "\n", -1), lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, F.lit(_OPEN), F.lit(""))))))


def places(text: Column, pattern: Column) -> Column:
    """array<struct<found, line>>: every match of a pattern in order, with the 1-based line at which it starts (null if a match is empty).

    The pattern is searched for once, which puts marks around its matches; the rest is done to texts that have marks. Texts that hold
    such characters themselves are searched twice instead."""

    def paired(found: Column, lines: Column) -> Column:
        none = F.exists(found, lambda x: x == "")
        return F.zip_with(found, lines, lambda x, line: F.struct(x.alias("found"), F.when(~none, line).cast("int").alias("line")))

    def marked(text: Column) -> Column:
        pieces = F.split(text, _OPEN, -1)
        found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: F.substring_index(x, _SHUT, 1))
        return F.when(~text.contains(_OPEN), F.array().cast(PLACES)).otherwise(paired(found, _lines_of(text)))

    def twice(found: Column) -> Column:
        plain = lambda x: F.replace(x, F.lit(_OPEN), F.lit(""))
        parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda piece, x: F.concat(plain(piece), F.lit(_OPEN), plain(x)))
        return F.when(F.size(found) == 0, F.array().cast(PLACES)).otherwise(paired(found, _lines_of(F.array_join(parts, ""))))

    holds = text.contains(_OPEN) | text.contains(_SHUT)
    return F.when(holds, let(F.regexp_extract_all(text, pattern, F.lit(0)), twice)).otherwise(let(F.regexp_replace(text, pattern, F.lit(f"{_OPEN}$0{_SHUT}")), marked))


def glob_to_regex(glob: str) -> str:
    """An anchored pattern for a file-name glob: * and ? stay within a directory unless the glob has none, [..] is a class."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            while glob[i : i + 2] == "**":
                i += 1
            out.append(".*" if glob[max(0, i - 1) : i + 1] == "**" else "[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() and c != "_" and c != "/" else c)
        i += 1
    return ("^" if "/" in glob else "(^|/)") + "".join(out) + "$"


def portable(pattern: str) -> str:
    """A user's pattern in Java's dialect: named groups of Python's form are rewritten."""
    return re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
