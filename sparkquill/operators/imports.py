"""What a file imports, by its language's own forms, and which files or packages that names.

An import becomes candidates: paths that it may stand for. A file is known by its path (without extension, but for C and C++),
also as seen from its source root (ROOTS), and by its directory if it is that directory's index. Where a project says itself what
its modules are called (go.mod, Cargo.toml, tsconfig.json and jsconfig.json), names are led to folders by their longest prefix. Go, Java and C# import
packages too: a package is a node of its own, written as a path that ends in ``/``, which each of its files belongs to; so a
package of n files that m files import takes m + n edges rather than m * n. Candidates meet files by equal keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import COMMENTS

LANGUAGES = ("python", "javascript", "java", "go", "csharp", "cpp", "rust")
#: What stands before the part of a path that imports name.
#: Not so where a manifest says it.
ROOTS = r"^(?:.*?/)??(?:src/main/java|src/test/java|src|lib|include|python|app)/"
_STRING = "array<string>"
#: Begins a candidate that is only guessed, and doesn't count where a manifest of its language lies above the file.
GUESS = "?"
ROOT = "array<struct<lang:string,prefix:string,folder:string,within:string,nearest:boolean>>"


def _all(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("code", F.lit(pattern), F.lit(group))


def _strings(*values: Column) -> Column:
    return F.array(*values).cast(_STRING)


def _names(text: Column) -> Column:
    """The imported names of a list 'a as b, (c), d': a, c, d."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"[(){}\\]|#[^\n]*", " "), ","), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^([\w.:]+)", 1)), lambda x: x != "")


def _up(levels: Column) -> Column:
    """The directory of path, so many levels up (0: the one that the file is in)."""
    parts = F.split("path", "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1 - levels, F.lit(0))), "/")


def _join(directory: Column, rest: Column) -> Column:
    return F.when(directory == "", rest).when(rest == "", directory).otherwise(F.concat(directory, F.lit("/"), rest))


def _slashes(name: Column) -> Column:
    return F.replace(name, F.lit("."), F.lit("/"))


def _resolved(name: Column) -> Column:
    """A relative path './x' or '../../x' against the directory of path."""
    ups = F.regexp_count(F.regexp_extract(name, r"^((?:\.\.?/)++)", 1), F.lit(r"\.\./"))
    return _join(_up(ups), F.regexp_replace(name, r"^(?:\.\.?/)++", ""))


def _python() -> Column:
    plain = F.transform(F.flatten(F.transform(_all(r"(?:^|\n)[ \t]*import[ \t]+([^\n;#]+)"), _names)), _slashes)
    form = r"(?:^|\n)[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]*(\([^)]*\)|[^\n;]*)"

    def members(module: Column, names: Column) -> Column:
        dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
        rest = _slashes(F.regexp_replace(module, r"^\.+", ""))
        base = F.when(dots > 0, _join(_up(dots - 1), rest)).otherwise(rest)
        return F.concat(F.array(base), F.transform(_names(names), lambda x: _join(base, x)))

    return F.concat(plain, F.flatten(F.zip_with(_all(form, 1), _all(form, 2), members)))


def _javascript() -> Column:
    named = _all(r"(?:\bfrom|\bimport[ \t]*\(?|\brequire[ \t]*\()\s*[\"']([^\"'\n]+)[\"']")
    bare = lambda x: F.regexp_replace(x, r"\.(?:jsx?|tsx?|mjs)$", "")
    near = lambda x: _resolved(bare(F.when(x.isin(".", ".."), F.concat(x, F.lit("/"))).otherwise(x)))
    far = lambda x: F.when(x.rlike("^[@~]/"), _strings(x, F.concat(F.lit(GUESS), F.regexp_replace(x, "^[@~]/", "")))).otherwise(_strings(x))
    return F.flatten(F.transform(named, lambda x: F.when(x.rlike(r"^\.\.?(?:/|$)"), _strings(near(x))).otherwise(far(bare(x)))))


def _java() -> Column:
    """Of a class also the class around it, as the name may be that of a member."""
    named = F.transform(_all(r"(?:^|\n)[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"), _slashes)
    return F.flatten(F.transform(named, lambda x: F.when(x.endswith("/*"), _strings(F.regexp_replace(x, r"\*$", ""), F.regexp_replace(x, r"/\*$", ""))).otherwise(_strings(x, F.regexp_replace(x, "/[^/]*$", "")))))


def _go() -> Column:
    """A package's path, and guesses without its first parts, which may name the module: host, owner, project."""
    single, blocks = _all(r"(?:^|\n)import[ \t]+(?:[\w.]+[ \t]+)?\"([^\"\n]+)\""), _all(r"(?:^|\n)import[ \t]*\(([^)]*)\)")
    named = F.concat(single, F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"\"([^\"\n]+)\""), F.lit(1)))))

    def without(x: Column) -> Column:
        parts = F.split(x, "/")
        most = F.least(F.size(parts) - 1, F.when(parts[0].contains("."), 3).otherwise(1))
        return F.transform(F.sequence(F.lit(0), most), lambda k: F.concat(F.when(k > 0, GUESS).otherwise(""), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/"), F.lit("/")))

    return F.flatten(F.transform(named, without))


def _csharp() -> Column:
    """A namespace, or a class of one after static or in an alias."""
    named = F.transform(_all(r"(?:^|\n)[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+|\w+[ \t]*=[ \t]*)?([\w.]+)[ \t]*;"), _slashes)
    return F.flatten(F.transform(named, lambda x: _strings(F.concat(x, F.lit("/")), x)))


def _cpp() -> Column:
    named = _all(r"(?:^|\n)[ \t]*#[ \t]*include[ \t]*[\"<]([^\">\n]+)[\">]")
    return F.flatten(F.transform(named, lambda x: _strings(_resolved(x), x)))


def _rust() -> Column:
    """Modules by ``mod x;`` and ``use``; of a used name also what is around it, as the name may be that of an item."""
    outer = F.col("path").rlike(r"(?:^|/)(?:mod|lib|main)\.rs$")
    own = F.when(outer, _up(F.lit(0))).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    modules = F.transform(_all(r"\bmod[ \t]+(\w+)[ \t]*;"), lambda x: _join(own, x))
    form = r"\buse\s+((?:crate|super|self)(?:::\w+)*+)(?:::\{([^}]*)\})?"

    def used(name: Column, inner: Column) -> Column:
        rest = F.replace(F.regexp_replace(name, r"^(?:(?:crate|super|self)(?:::|$))++", ""), F.lit("::"), F.lit("/"))
        around = _up(F.regexp_count(name, F.lit(r"\bsuper\b")) - F.when(outer, 0).otherwise(1))
        base = F.when(name.startswith("super"), _join(around, rest)).when(name.startswith("self"), _join(own, rest)).otherwise(rest)
        members = F.transform(_names(inner), lambda x: _join(base, F.replace(x, F.lit("::"), F.lit("/"))))
        return F.filter(F.concat(F.array(base), members, F.transform(F.concat(F.array(base), members), lambda x: F.regexp_replace(x, "/?[^/]*$", ""))), lambda x: x != "")

    other = r"\buse\s+((?!(?:crate|super|self|std|core|alloc)\b)\w+(?:::\w+)*+)(?:::\{([^}]*)\})?"

    def of_crate(name: Column, inner: Column) -> Column:
        base = F.replace(name, F.lit("::"), F.lit("/"))
        named = F.concat(F.array(base), F.transform(_names(inner), lambda x: _join(base, F.replace(x, F.lit("::"), F.lit("/")))))
        return F.filter(F.concat(named, F.transform(named, lambda x: F.regexp_replace(x, "/?[^/]*$", ""))), lambda x: x != "")

    return F.concat(modules, F.flatten(F.zip_with(_all(form, 1), _all(form, 2), used)), F.flatten(F.zip_with(_all(other, 1), _all(other, 2), of_crate)))


_CANDIDATES = {"python": _python, "javascript": _javascript, "java": _java, "go": _go, "csharp": _csharp, "cpp": _cpp, "rust": _rust}


def candidates() -> Column:
    """array<string> of what a file of path, lang and code (text without comments) may import; none for other languages."""
    out = F.array().cast(_STRING)
    for lang, found in _CANDIDATES.items():
        out = F.when(F.col("lang") == lang, F.array_distinct(found())).otherwise(out)
    return out


def package() -> Column:
    """The package that a file of path, lang and code belongs to, as a path that ends in ``/``; null where there is none."""
    declared = F.when(F.col("lang") == "java", F.regexp_extract("code", r"(?:^|\n)[ \t]*package[ \t]+([\w.]+)", 1)).when(F.col("lang") == "csharp", F.regexp_extract("code", r"\bnamespace[ \t]+([\w.]+)", 1))
    named = F.when(declared != "", F.concat(_slashes(declared), F.lit("/")))
    directory = F.when((F.col("lang") == "go") & ~F.col("path").rlike(r"_test\.go$") & F.col("path").contains("/"), F.regexp_extract("path", r"^(.*/)", 1))
    return F.coalesce(named, directory)


def _root(lang: str, prefix: Column, folder: Column, within: Column, nearest: bool) -> Column:
    return F.struct(F.lit(lang).alias("lang"), prefix.alias("prefix"), F.rtrim(folder, F.lit("/")).alias("folder"), within.alias("within"), F.lit(nearest).alias("nearest"))


def roots() -> Column:
    """ROOT of a file of path and content: names that begin with prefix lie in folder. within: whom that concerns, files below it ('' for all);
    nearest: whether manifests nearer to a file go before longer prefixes. Null for other files than manifests."""
    content, here, everywhere = F.col("content"), _up(F.lit(0)), F.lit("")
    found = lambda pattern, group: F.regexp_extract_all(content, F.lit(pattern), F.lit(group))
    moved = r"(?m)^[ \t]*(?:replace[ \t]+)?(\S+)(?:[ \t]+v\S+)?[ \t]*=>[ \t]*(\.{1,2}/\S*)"
    modules = F.transform(found(r"(?m)^[ \t]*module[ \t]+\"?([^\s\"]+)", 1), lambda x: _root("go", x, here, here, False))
    replaced = F.zip_with(found(moved, 1), found(moved, 2), lambda x, to: _root("go", x, _resolved(to), here, False))
    names = [F.regexp_extract(content, rf"(?m)^[ \t]*\[{part}\][^\[]*?^[ \t]*name[ \t]*=[ \t]*\"([^\"]+)\"", 1) for part in ("lib", "package")]
    crate = F.replace(F.when(names[0] != "", names[0]).otherwise(names[1]), F.lit("-"), F.lit("_"))
    crates = F.filter(F.array(_root("rust", crate, _join(here, F.lit("src")), everywhere, False)), lambda x: x["prefix"] != "")
    plain = F.regexp_replace(F.regexp_replace(content, COMMENTS["javascript"], "$1"), r",(\s*[}\]])", "$1")
    options = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    base = F.concat(F.lit("./"), F.coalesce(options["baseUrl"], F.lit(".")), F.lit("/"))
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"/?\*$|/\.(?=/|$)", ""), r"(?<=/)(?!\.\.?/)[^/]+/\.\./", "")
    aliases = F.flatten(F.transform(F.map_entries(options["paths"]), lambda e: F.transform(e["value"], lambda to: _root("javascript", tidy(e["key"]), _resolved(tidy(F.concat(base, to))), here, True))))
    whole = F.when(options["baseUrl"].isNotNull(), F.array(_root("javascript", everywhere, _resolved(base), here, True)))
    none = F.array().cast(ROOT)
    settings = F.concat(F.coalesce(aliases, none), F.coalesce(whole, none))
    named = lambda pattern: F.col("path").rlike(rf"(?:^|/)(?:{pattern})$")
    return F.when(named(r"go\.mod"), F.concat(modules, replaced)).when(named(r"Cargo\.toml"), crates).when(named(r"(?:ts|js)config(?:\.\w+)?\.json"), settings).cast(ROOT)


def _led(wanted: DataFrame, roots: DataFrame) -> DataFrame:
    """wanted with keys led to folders by manifests' roots: of each the nearest manifest's and then the longest prefix that fits; names as they are
    written stay, guesses only where no manifest of their language lies above the file."""
    guessed = F.col("key").startswith(GUESS)
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("src", "/"))), lambda k: F.array_join(F.slice(F.split("src", "/"), F.lit(1), k - 1), "/"))
    free = wanted.where(guessed)
    covered = free.select("src", "lang").distinct().withColumn("within", F.explode(above)).join(roots.where("lang != 'rust'").select("lang", "within").distinct(), ["lang", "within"]).select("src", "lang").distinct()
    free = free.join(covered, ["src", "lang"], "left_anti").withColumn("key", F.substring("key", F.lit(2), F.length("key")))
    plain = wanted.where(~guessed)
    parts = F.split("key", "/")
    fits = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    below = (F.col("within") == "") | F.startswith("src", F.concat("within", F.lit("/")))
    met = plain.withColumn("prefix", F.explode(F.array_distinct(fits))).join(roots, ["lang", "prefix"]).where(below)
    order = F.struct(F.when(F.col("nearest"), F.length("within")).otherwise(0).alias("near"), F.length("prefix").alias("long"))
    met = met.withColumn("rank", F.rank().over(Window.partitionBy("src", "lang", "key").orderBy(order.desc()))).where("rank = 1")
    rest = F.when(F.col("prefix") == "", F.col("key")).otherwise(F.substring("key", F.length("prefix") + 2, F.length("key")))
    key = _join(F.col("folder"), F.when((rest == "") & (F.col("lang") == "rust"), "lib").otherwise(rest))
    key = F.when(F.col("key").endswith("/") & ~key.endswith("/"), F.concat(key, F.lit("/"))).otherwise(key)
    return plain.unionByName(free).unionByName(met.withColumn("key", key).select(*wanted.columns))


def keys(rows: DataFrame) -> DataFrame:
    """(key, root, dst) of files by their paths; root is null for the whole path."""
    stem = F.when(F.col("lang") == "cpp", F.col("path")).otherwise(F.regexp_replace("path", r"\.[A-Za-z]+$", ""))
    index = F.regexp_replace(stem, r"(?:^|/)(?:__init__|index|mod)$", "")
    stem = F.when(F.col("lang").isin("python", "javascript", "rust") & (index != ""), index).otherwise(stem)
    inner = F.when(F.col("path").rlike(ROOTS), F.struct(F.regexp_replace(stem, ROOTS, "").alias("key"), F.regexp_extract("path", f"({ROOTS[1:]})", 1).alias("root")))
    whole = F.struct(stem.alias("key"), F.lit(None).cast("string").alias("root"))
    return rows.select(F.col("path").alias("dst"), F.col("lang").alias("to"), F.inline(F.array_compact(F.array(whole, inner))))


def edges(facts: DataFrame) -> DataFrame:
    """(src, dst): a file imports a file or a package of its language, and an imported package has a file; for facts (path, lang, imports, package,
    roots), a stored table.

    From a source root a file sees its own root first; another root's file counts only if it is the same language's and the
    importing file stands under no root or under the same one.
    """
    wanted = facts.select(F.col("path").alias("src"), "lang", F.when(F.col("path").rlike(ROOTS), F.regexp_extract("path", f"({ROOTS[1:]})", 1)).alias("from"), F.coalesce("package", F.lit("")).alias("own"), F.explode("imports").alias("key"))
    led = facts.where("size(roots) > 0").select(F.inline("roots")).distinct()
    wanted = (wanted.withColumn("key", F.ltrim("key", F.lit(GUESS))) if led.isEmpty() else _led(wanted, led)).where("key != own")
    files = keys(facts.where(F.col("lang").isin(*LANGUAGES)))
    same = (F.col("lang") == F.col("to")) & (F.col("root").isNull() | F.col("from").isNull() | (F.col("root") == F.col("from")))
    direct = wanted.join(files, "key").where(same & (F.col("src") != F.col("dst"))).select("src", "dst")
    packages = facts.where("package IS NOT NULL").select(F.col("path").alias("dst"), F.col("lang").alias("to"), F.col("package").alias("key"))
    named = wanted.join(packages.select("key", F.col("to").alias("lang")).distinct(), ["key", "lang"]).select("src", F.col("key").alias("dst"))
    held = packages.select("key", "dst").join(named.select(F.col("dst").alias("key")).distinct(), "key").select(F.col("key").alias("src"), "dst")
    return direct.unionByName(named).unionByName(held).distinct()
