"""Functions and classes of a file by patterns: one pass over its tokens with a stack of what is open.

Tokens are comments, string literals, control words, heads of classes and functions, braces and semicolons; what lies between
is skipped by the pattern. Nested functions and classes count for themselves. It serves the languages without a parser here,
and Python files that don't parse (there a function ends where the next one begins).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: A list of arguments, with up to two levels of brackets in it.
_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_GENERIC = r"(?:<[^<>(){};]*>)?"
_MODIFIER = r"(?:public|private|protected|internal|static|final|abstract|synchronized|async|override|virtual|sealed|partial|extern|default)"
_TYPE = r"[\w.]+(?:<[^(){};=]*>)?(?:\[\])*\??"
#: Heads of functions. Where the head alone could be a call, the brace that opens the body belongs to it.
HEADS = {
    "python": rf"\bdef\s+\w+\s*(?:\[[^\]]*\])?\s*{_ARGS}",
    "javascript": rf"\bfunction\b\s*\*?\s*\w*\s*{_GENERIC}\s*{_ARGS}|\b\w+\s*[:=]\s*(?:async\s+)?(?:{_ARGS}\s*(?::[^=;{{}}()\n]+)?|\w+\s*)=>(?:\s*\{{)?|\b\w+\s*{_GENERIC}{_ARGS}\s*(?::[^=;{{}}()\n]+)?\{{",
    "java": rf"\b(?:{_MODIFIER}\s+)*(?:<[^<>(){{}};]*>\s*)?{_TYPE}\s+\w+\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?\{{|\b(?:{_MODIFIER}\s+)+{_TYPE}\s+\w+\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?;",
    "csharp": rf"\b(?:{_MODIFIER}\s+)*{_TYPE}\s+\w+\s*{_GENERIC}\s*{_ARGS}\s*(?:where\s[^{{}};]*)?(?:\{{|=>)|\b(?:{_MODIFIER}\s+)+{_TYPE}\s+\w+\s*{_ARGS}\s*;",
    "go": rf"\bfunc\s*(?:\([^()]*\)\s*)?\w+\s*(?:\[[^\]]*\])?\s*{_ARGS}",
    "cpp": rf"\b[\w:]+{_GENERIC}[\s*&]+[\w:~]+\s*{_ARGS}\s*(?:(?:const|noexcept|override|final)\b\s*)*(?::[^{{}};]*)?\{{",
    "rust": rf"\bfn\s+\w+\s*(?:<[^(){{}};]*>)?\s*{_ARGS}",
}
CLASSES = r"\b(?:class|interface|struct|enum|record|trait|impl)\s+\w+"
DECISIONS = {
    "python": r"\b(?:if|elif|for|while|except|and|or|case)\b",
    "javascript": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?",
    "java": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?",
    "csharp": r"\b(?:if|for|foreach|while|case|catch)\b|&&|\|\||\?",
    "go": r"\b(?:if|for|case)\b|&&|\|\|",
    "cpp": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?",
    "rust": r"\b(?:if|for|while|match)\b|&&|\|\|",
}
#: Words that brackets may follow without naming a function, and question marks that decide nothing.
_CONTROL = r"\b(?:else|return|new|throw|switch|try|do|finally|using|lock|delete|sizeof|await|yield|typeof)\b|\?\.|\?\?|\?:|\?[,)>;]"
_DOUBLE, _SINGLE, _BACK = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_SLASHES = r"//[^\n]*|/\*[\s\S]*?\*/"
#: Comments and string literals.
SKIPPED = {
    "python": rf"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|{_DOUBLE}|{_SINGLE}|#[^\n]*",
    "javascript": rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}|{_BACK}",
    "go": rf"{_SLASHES}|{_DOUBLE}|{_BACK}|{_SINGLE}",
    "rust": rf"{_SLASHES}|{_DOUBLE}|'(?:[^'\\\n]|\\.)'",
    **dict.fromkeys(("java", "csharp", "cpp"), rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}"),
}
_TOKENS = {
    lang: re.compile(rf"(?P<skip>{SKIPPED[lang]}|{_CONTROL})|(?P<decides>{DECISIONS[lang]})|(?P<type>{CLASSES})|(?P<head>{HEADS[lang]})|[{{}};]")
    for lang in HEADS
}
_ASSIGNED = re.compile(r"(\w+)\s*[:=]\s*(?:async\b|\(|\w+\s*=>)")
_NAME = re.compile(r"([\w~]+)\s*(?:<[^<>(){};]*>|\[[^\]]*\])?\s*\(")
_RECEIVER = re.compile(r"func\s*\([^()]*\)\s*(?=\w)")
_BRACKETS = re.compile(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}")


#: Languages whose handlers are told by their braces; what ends or logs an error in one.
_HANDLERS = {
    lang: re.compile(rf"(?P<skip>{SKIPPED[lang]})|(?P<catch>\bcatch\b)|(?P<raised>\bthrow\b)|(?P<logged>\b_?(?i:log)\w*\s*(?:\.|->|::)\s*\w+\s*\(|\bLOG\w*\()|[{{}}]")
    for lang in ("java", "csharp", "cpp")
}


def handlers(text: str, lang: str) -> list[tuple[str, int]]:
    """(raised or logged, line) of handlers that raise again, or else log: of each line on which all handlers do at least that."""
    open_: list[list] = []  # line, depth, what it does: 0 nothing, 1 logs, 2 raises
    judged: dict[int, int] = {}
    pending = None
    depth, line, at = 0, 1, 0
    for token in _HANDLERS[lang].finditer(text) if lang in _HANDLERS else ():
        line += text.count("\n", at, token.start())
        at, kind = token.start(), token.lastgroup
        if kind == "catch":
            pending = line
        elif kind in ("raised", "logged"):
            for handler in open_:
                handler[2] = max(handler[2], 2 if kind == "raised" else 1)
        elif token[0] == "{":
            depth += 1
            if pending is not None:
                open_.append([pending, depth, 0])
                pending = None
        elif token[0] == "}":
            if open_ and open_[-1][1] == depth:
                begun, _, does = open_.pop()
                judged[begun] = min(judged.get(begun, 2), does)
            depth -= 1
    judged |= {begun: 0 for begun, _, _ in open_}
    return [("raised" if does == 2 else "logged", begun) for begun, does in sorted(judged.items()) if does]


def n_params(params: str) -> int:
    """Commas within brackets of any kind part nothing; of a bare * or / and C's void none counts."""
    before = None
    while params != before:
        before, params = params, _BRACKETS.sub("", params)
    return sum(x.strip() not in ("", "*", "/", "void") for x in params.split(","))


@dataclass
class Part:
    """A function or class; nesting is the depth of braces within it."""

    kind: str
    name: str
    line: int
    depth: int = 0
    complexity: int = 1
    nesting: int = 0
    n_params: int = 0
    n_methods: int = 0


def _function(head: str, line: int) -> Part:
    head = _RECEIVER.sub("func ", head)
    named = _ASSIGNED.match(head) or _NAME.search(head)
    if "(" in head:
        inner = head[head.index("(") + 1 : head.rindex(")")]
    else:
        inner = re.search(r"(\w+)\s*=>", head)[1]
    return Part("function", named[1] if named and named[1] != "function" else "", line, n_params=n_params(inner))


def outline(text: str, lang: str) -> list[Part]:
    """Every function and class of a file, in the order in which they end."""
    open_: list[Part] = []
    done: list[Part] = []
    pending: Part | None = None
    depth = line = 0
    line, at = 1, 0
    for token in _TOKENS[lang].finditer(text):
        line += text.count("\n", at, token.start())
        at, kind, found = token.start(), token.lastgroup, token[0]
        if kind == "skip":
            continue
        if kind == "decides":
            if open_ and open_[-1].kind == "function":
                open_[-1].complexity += 1
            continue
        if kind == "type":
            pending = Part("class", found.split()[-1], line)
            continue
        if kind == "head":
            part = _function(found, line)
            if lang == "python":
                done += open_
                open_ = [part]
                continue
            if open_ and open_[-1].kind == "class":
                open_[-1].n_methods += 1
            if found.endswith(("=>", ";")):  # no body of its own
                done.append(part)
                continue
            pending = part
            if not found.endswith("{"):
                continue
            found = "{"
        if found == "{":
            depth += 1
            if pending:
                pending.depth = depth
                open_.append(pending)
                pending = None
            elif open_:
                open_[-1].nesting = max(open_[-1].nesting, depth - open_[-1].depth)
        elif found == "}":
            if open_ and open_[-1].depth == depth:
                done.append(open_.pop())
            depth -= 1
        elif found == ";":
            if pending and pending.kind == "function":
                done.append(pending)
            pending = None
    return done + open_[::-1]
