"""Rule catalogs: declarative rules of a JSON file, which is settings of bounded size."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions.text import glob_to_regex, portable

FIELDS = ("id", "description", "severity", "target", "pattern", "message", "suggestion")
RULE = f"struct<{','.join(f'{f}:string' for f in FIELDS)}>"
SEVERITIES = ("info", "warn", "block")
LAYER_TARGETS = ("domain", "application", "infrastructure", "presentation")
LANGUAGE_TARGETS = ("python", "javascript", "java", "go", "csharp", "cpp", "rust")


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    severity: str
    target: str
    pattern: str
    message: str
    suggestion: str

    @property
    def kind(self) -> str:
        """What the target is: ``layer``, ``language``, ``all`` or ``glob``."""
        return "layer" if self.target in LAYER_TARGETS else "language" if self.target in LANGUAGE_TARGETS else "all" if self.target == "all" else "glob"

    def fits(self) -> Column:
        """Whether a file (path, lang, layer) is in the rule's scope."""
        if self.kind == "glob":
            return F.coalesce(F.col("path").rlike(glob_to_regex(self.target)), F.lit(False))
        return F.lit(True) if self.kind == "all" else F.col("layer" if self.kind == "layer" else "lang") == self.target


def required(pattern: str, least: int = 3) -> tuple[tuple[str, ...], ...]:
    """Words, in lower case, that any match of a pattern holds: one tuple of a single word for each run of plain ASCII letters and signs that
    no match can do without; none where the pattern can't be read so. Patterns are Java's; where Python's parser takes one, literals
    outside of alternatives, options and classes mean the same in both."""
    # Comments in patterns, case beyond ASCII, and sets within sets, which Java reads otherwise.
    if re.search(r"\(\?[a-z]*[xuU]|\[[^\]]*\[|&&", pattern):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = re._parser.parse(re.sub(r"\(\?<(\w)", r"(?P<\1", pattern))
    except (re.error, RecursionError, OverflowError, ValueError):
        return ()
    found: list[str] = []

    def walk(items) -> None:
        run = ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL" and 32 <= value < 127:
                run += chr(value).lower()
                continue
            if len(run) >= least:
                found.append(run)
            run = ""
            if name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT") and value[0] >= 1:
                walk(value[2])

    walk(parsed)
    return tuple((word,) for word in dict.fromkeys(found))


def parse_rules(spark: SparkSession, text: str) -> DataFrame:
    """A catalog's JSON text as rows of FIELDS."""
    rows = spark.createDataFrame([(text,)], "json string")
    return rows.select(F.explode(F.from_json("json", f"struct<rules:array<{RULE}>>")["rules"]).alias("r")).select("r.*")


def valid_rules(spark: SparkSession, text: str) -> tuple[list[Rule], list[str]]:
    """The rules of a catalog whose patterns Java compiles and whose severities are known, in any case, and the ids of the rest: a bad pattern
    would end a whole job, and a severity of another name would never block."""
    good, bad = [], []
    for fields in json.loads(text)["rules"]:
        rule = Rule(**{f: str(fields.get(f) or "") for f in FIELDS} | {"pattern": portable(str(fields.get("pattern") or "")), "severity": str(fields.get("severity") or "").strip().lower()})
        if rule.severity not in SEVERITIES:
            bad.append(rule.id)
            continue
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(rule.pattern)
        except Exception:  # noqa: BLE001  whatever Java raises, the pattern is what it can't take
            bad.append(rule.id)
        else:
            good.append(rule)
    return good, bad


def scoped(files: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (of parse_rules) with n_files: how many of files (path, lang, layer) are in each one's scope."""
    target = F.col("target")
    known = rules.select("target").distinct().collect()  # settings, of bounded size
    fits = {r.target: Rule(*[""] * 3, r.target, *[""] * 3).fits() for r in known if r.target is not None}
    counts = files.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(f"n{k}") for k, x in enumerate(fits.values())]).first() if fits else ()
    n_files = F.create_map(*[F.lit(x) for pair in zip(fits, counts, strict=True) for x in pair])[target] if fits else F.lit(None)
    return rules.withColumn("n_files", F.coalesce(n_files, F.lit(0)).cast("long"))


def as_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(getattr(r, f) for f in FIELDS) for r in rules], ", ".join(f"{f} string" for f in FIELDS))
