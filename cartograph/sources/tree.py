"""Source trees: scan, extraction of symbols, imports and calls, and their resolution.

Files are read with Spark's binary reader. Lines are parsed by one mapInArrow pass (the brace depth that decides
which function owns a line is a clamped running state that window functions can't express); everything that needs the
set of files - which path an import means, which symbol a call means - is left to joins.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartograph.runtime import drop_spool, spool
from cartograph.sources.dataset import Graph, Lazy

# Extensions by language, in the order in which import candidates are tried.
EXTENSIONS = {"rs": "rust", "ts": "typescript_javascript", "tsx": "typescript_javascript", "js": "typescript_javascript", "jsx": "typescript_javascript", "mjs": "typescript_javascript", "cjs": "typescript_javascript"}
SCRIPT = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
NOT_CALLS = {"if", "match", "while", "loop", "for", "fn", "struct", "enum", "trait", "impl", "return"}

RUST_ITEM = re.compile(r"(?P<vis>pub(?:\([^)]*\))?\s+)?(?P<word>fn|struct|enum|trait|const|static|type) +(?P<name>\w+)", re.ASCII)
RUST_MOD = re.compile(r"(?P<vis>pub )?mod (?P<name>[^;{]+?)\s*(?P<end>[;{])$")
RUST_USE = re.compile(r"(?:pub )?use (?P<path>.+);$")
SCRIPT_ITEM = re.compile(r"(?P<export>export (?:default )?)?\s*(?:(?P<anon>function\s*\()|(?P<word>async function|function|const|let|class|interface|type) +(?P<name>\w+))", re.ASCII)
REEXPORT = re.compile(r"export \{\s*(?P<first>[^,}]+)")
QUOTED = re.compile(r"(?P<q>['\"])(?P<spec>.*?)(?P=q)")
DYNAMIC = re.compile(r"(?<![\w.])(?:import|require)\(\s*(?!['\"])")
CALL = re.compile(r"([A-Za-z0-9_:.]+)\s*\(", re.ASCII)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.ASCII)
DECLARED = re.compile(r"(?:pub(?:\([^)]*\))? +)?(?:async )?fn +(\w+)|(?:export )?(?:async function|function|const|let) +(\w+)", re.ASCII)
RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "constant", "static": "static", "type": "type_alias"}
SCRIPT_KINDS = {"async function": "function", "function": "function", "const": "function", "let": "function", "class": "class", "interface": "interface", "type": "type_alias"}

ROW = (
    "record string, path string, name string, qualname string, kind string, visibility string, exported boolean, raw_text string, spec_kind string, "
    "candidates array<string>, external_pkg string, start_byte int, end_byte int, line int, caller string, callee string, is_method boolean"
)
COLUMNS = [x.split()[0] for x in ROW.split(", ")]
ARROW = [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in ROW.split(", ")]
RECORDS = ("symbol", "import", "module", "call", "file")
FILES_A_BATCH = 500  # files whose records are in memory at a time


def qualname(path: str, name: str) -> str:
    """src/a/b.rs and n give a::b::n; /mod and /index are dropped."""
    stem = re.sub(r"(\.[A-Za-z]+)+$", "", path.removeprefix("src/"))
    return stem.replace("/mod", "").replace("/index", "").replace("/", "::") + "::" + name


def rust_visibility(prefix: str | None) -> tuple[str, bool]:
    p = (prefix or "").strip()
    known = {"": ("local", False), "pub": ("public", True), "pub(crate)": ("package", True), "pub(super)": ("module", False), "pub(self)": ("local", False)}
    return known.get(p, ("unknown", False))


def module_files(base: str, segments: list[str]) -> list[str]:
    """Files that a module path may mean, the longest prefix first."""
    at = lambda *p: os.path.normpath("/".join(x for x in p if x))
    return [x for n in range(len(segments), 0, -1) for x in (at(base, *segments[:n]) + ".rs", at(base, *segments[:n], "mod.rs"))]


def rust_candidates(path: str, use: str) -> tuple[str, list[str], str | None]:
    """(kind, candidate files, external package) of a use path."""
    folder, name = os.path.split(path)
    here = folder if name in ("mod.rs", "lib.rs", "main.rs") else f"{folder}/{name.removesuffix('.rs')}"
    head = use.split(" as ")[0].strip().split("::{")[0].strip()
    head = re.sub(r"(::\*)+$", "", head)
    parts = [x for x in head.split("::") if x]
    bases = {"crate": "src", "self": here, "super": os.path.dirname(here)}
    if not parts:
        return "unresolved", [], None
    if parts[0] in bases and "::" in use:
        return "relative", module_files(bases[parts[0]], parts[1:]), None
    return "external", [], parts[0]


def script_candidates(base: str) -> list[str]:
    stem = re.sub(r"\.[^./]*$", "", base)
    return [base, *[f"{stem}.{x}" for x in SCRIPT], *[f"{base}/index.{x}" for x in SCRIPT]]


def alias_targets(spec: str, config: dict) -> list[str]:
    """Candidate files of a specifier under the path aliases and base folder of a tsconfig."""
    root = config.get("baseUrl") or "."
    out: list[str] = []
    for pattern, targets in (config.get("paths") or {}).items():
        left, star, right = pattern.partition("*")
        if (star and spec.startswith(left) and spec.endswith(right) and len(spec) >= len(left) + len(right)) or spec == pattern:
            middle = spec[len(left) : len(spec) - len(right)] if star else ""
            for t in targets:
                out += script_candidates(os.path.normpath(f"{root}/{t.replace('*', middle)}"))
    if config.get("baseUrl"):
        out += script_candidates(os.path.normpath(f"{root}/{spec}"))
    return out


def load_tsconfig(root: str) -> dict:
    """compilerOptions of a tsconfig.json, or its top level; empty where there is none or it can't be read."""
    try:
        with open(os.path.join(root, "tsconfig.json"), encoding="utf-8") as f:
            d = json.load(f)
    except (OSError, ValueError):
        return {}
    return d.get("compilerOptions") or d


def parse_file(path: str, language: str, text: str, aliases: dict, kinds: Collection[str] = RECORDS) -> list[dict]:
    """The records of one file, of some kinds or of all: symbols, imports, modules, calls and one file record."""
    out: list[dict] = []
    script = language == "typescript_javascript"
    symbols, imports, modules, calls, states = (x in kinds for x in RECORDS)
    prefix, size = qualname(path, ""), len if text.isascii() else lambda x: len(x.encode())
    qual = lambda name: prefix + name
    offset = depth = 0
    owner: str | None = None
    dynamic, only_exports = False, True
    for number, raw in enumerate(text.split("\n")[: None if not text.endswith("\n") else -1], 1):
        line = raw.removesuffix("\r")
        length = size(line)
        t, code = line.strip(), line.split("//")[0] if "//" in line else line
        add = lambda record, **x: out.append({"record": record, "path": path, "start_byte": offset, "end_byte": offset + length, "line": number, **x})  # noqa: B023, E731
        declared = None
        if script:
            only_exports = only_exports and (not t or t.startswith(("//", "export ")))
            if imports and ("'" in t or '"' in t) and (m := QUOTED.search(t)):
                spec = m["spec"]
                if spec.startswith("."):
                    kind, files, package = "relative", script_candidates(os.path.normpath(os.path.join(os.path.dirname(path), spec))), None
                else:
                    files = alias_targets(spec, aliases)
                    kind, package = ("alias", spec) if files else ("external", spec)
                add("import", raw_text=t, spec_kind=kind, candidates=files, external_pkg=package)
            dynamic = dynamic or (states and "(" in t and bool(DYNAMIC.search(t)))
            if symbols and (m := REEXPORT.match(t)):
                name = m["first"].split(" as ")[-1].strip()
                add("symbol", name=name, qualname=qual(name), kind="function", visibility="public", exported=True)
            for name in commonjs_names(t) if symbols and "exports" in t else ():
                known = [r for r in out if r["record"] == "symbol" and r["qualname"] == qual(name)]
                for r in known:  # a symbol from above keeps its kind and place
                    r.update(visibility="public", exported=True)
                if not known:
                    add("symbol", name=name, qualname=qual(name), kind="function", visibility="public", exported=True)
        else:
            if (symbols or modules) and (m := RUST_MOD.match(t)):
                name = m["name"].strip()
                if modules:
                    folder, file = os.path.split(path)
                    here = folder if file in ("mod.rs", "lib.rs", "main.rs") else f"{folder}/{file.removesuffix('.rs')}"
                    add("module", name=name, candidates=module_files(here, [name]) if m["end"] == ";" else [], external_pkg=None)
                if symbols:
                    add("symbol", name=name, qualname=qual(name), kind="module", visibility="public" if m["vis"] else "local", exported=bool(m["vis"]))
            if imports and (m := RUST_USE.match(t)):
                kind, files, package = rust_candidates(path, m["path"].strip())
                add("import", raw_text=t, spec_kind=kind, candidates=files, external_pkg=package)
        if calls and "(" in code:
            own = DECLARED.match(t)
            own_name = next((x for x in own.groups() if x), None) if own else None
            for m in CALL.finditer(code):
                word, start = m.group(1), m.start(1)
                method = "." in word
                callee = word.rsplit(".", 1)[-1] if method else word
                segments = callee.split("::")
                bad = not all(NAME.fullmatch(s) for s in segments) or callee in NOT_CALLS or callee == own_name
                if bad or code[: start + len(word) - len(callee)].rstrip().endswith("!"):
                    continue
                add("call", name=segments[-1], callee=callee if len(segments) > 1 else None, is_method=method, caller=owner)
        if not (symbols or calls):
            pass
        elif script and (m := SCRIPT_ITEM.match(t)):
            name = "default" if m["anon"] else m["name"]
            kind = "function" if m["anon"] else SCRIPT_KINDS[m["word"]]
            if m["word"] not in ("const", "let") or "=>" in t:
                shown = bool(m["export"])
                if symbols:
                    add("symbol", name=name, qualname=qual(name), kind=kind, visibility="public" if shown else "local", exported=shown)
                declared = qual(name) if kind == "function" else None
        elif not script and (m := RUST_ITEM.match(t)):
            visibility, shown = rust_visibility(m["vis"])
            if symbols:
                add("symbol", name=m["name"], qualname=qual(m["name"]), kind=RUST_KINDS[m["word"]], visibility=visibility, exported=shown)
            declared = qual(m["name"]) if m["word"] == "fn" else None
        if calls and ("{" in code or "}" in code):
            opened, closed = code.count("{"), code.count("}")
            if depth == 0 and owner is None and opened > closed:
                owner = declared
            depth = max(0, depth + opened - closed)
            owner = owner if depth else None
        offset += length + 1
    if states:
        out.append({"record": "file", "path": path, "kind": "partial" if dynamic else "ok", "exported": script and only_exports})
    return out


def commonjs_names(t: str) -> list[str]:
    """Names that a line exports by assignment: the keys of an object on one line, or one name."""
    if m := re.fullmatch(r"module\.exports = \s*\{(.*)\}\s*;*\s*", t):
        keys = [x.split(":")[0].strip() for x in m.group(1).split(",")]
        return [x for x in keys if re.fullmatch(r"\w+", x, re.ASCII)]
    if m := re.match(r"exports\.\s*(\w+)\s*=", t, re.ASCII):
        return [m.group(1)]
    return []


#: Names of ignore files, in the order in which they count.
IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rules(root: str, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, str]]:
    """(folder, pattern) of all ignore files of a tree and of git's own lists, from weak to strong."""
    out: list[tuple[str, str]] = []

    def read(path: str, folder: str) -> None:
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out.extend((folder, x.rstrip("\n")) for x in f if x.strip() and not x.startswith("#"))

    done = subprocess.run(["git", "-C", root, "config", "--get", "core.excludesFile"], capture_output=True, text=True, check=False)
    read(os.path.expanduser(done.stdout.strip() or "~/.config/git/ignore"), "")
    read(os.path.join(root, ".git", "info", "exclude"), "")
    for folder, below, _ in os.walk(root):
        below[:] = sorted(x for x in below if x != ".git")
        for name in names:
            read(os.path.join(folder, name), os.path.relpath(folder, root).replace(os.sep, "/").removeprefix("."))
    return out


def rule_regex(folder: str, pattern: str) -> tuple[str, bool, bool]:
    """(regex for a whole path, negated, folders only) of an ignore pattern that stands in a folder; ``*`` and ``?`` stop at slashes."""
    p = pattern.strip()
    negated, p = p.startswith("!"), p.removeprefix("!")
    folders, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])), i + 1
    base = re.escape(folder + "/") if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{out}$", negated, folders


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether the rules leave a file out: the last rule that fits decides, and what lies below a folder left out stays out."""

    def last(at: Column, folder: bool) -> Column:
        choice = F.lit(False)
        for base, pattern in rules:
            regex, negated, folders = rule_regex(base, pattern)
            if folder or not folders:
                choice = F.when(at.rlike(regex), not negated).otherwise(choice)
        return choice

    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return ((F.size(parts) > 1) & F.exists(above, lambda x: last(x, True))) | last(path, False)


def language_of(path: Column) -> Column:
    ext = F.substring_index(path, ".", -1)
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, include_hidden: bool = False, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """path, language, text, mtime, size_bytes, content_hash of the indexable files below a folder."""
    root = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}")
    path = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 1 << 30)
    rows = files.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), "content")
    rows = rows.withColumn("language", language_of(F.col("path"))).where("language is not null")
    if not include_hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    rows = rows.where(~ignored(F.col("path"), ignore_rules(root) if rules is None else rules))
    return rows.select("path", "language", F.decode("content", "UTF-8").alias("text"), "mtime", "size_bytes", F.sha2("content", 256).alias("content_hash"))


def extract(files: DataFrame, aliases: dict | None = None, kinds: Collection[str] = RECORDS) -> DataFrame:
    """The records of the files (ROW), of some kinds or of all; other kinds are not looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, FILES_A_BATCH):
                texts = zip(*(b.column(c).slice(i, FILES_A_BATCH).to_pylist() for c in ("path", "language", "text")), strict=True)
                rows = [r for p, lang, t in texts for r in parse_file(p, lang, t or "", aliases or {}, kinds)]
                filled = set().union(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) if c in filled else pa.nulls(len(rows), t) for c, t in zip(COLUMNS, ARROW, strict=True)], COLUMNS)

    return files.select("path", "language", "text").mapInArrow(run, ROW)


def pick(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved_path: the first of a row's candidates that is a file."""
    key = ["path", "start_byte", "line"]
    hits = rows.select(*key, F.posexplode("candidates").alias("pos", "candidate")).join(files.select(F.col("path").alias("candidate")), "candidate")
    first = hits.groupBy(*key).agg(F.min_by("candidate", "pos").alias("resolved_path"))
    return rows.join(first, key, "left")


def last_of(rows: DataFrame, *key: str) -> DataFrame:
    """The last row in file order for each key."""
    w = Window.partitionBy(*key).orderBy(F.desc("line"), F.desc("start_byte"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def call_sites(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, caller, name, callee, line, own: calls whose caller is a symbol of their file; own is the one function of the file that a bare name means, and stands for the name then.

    Calls and symbols meet by their file, in one shuffle; both lookups are windows where it puts them.
    """
    declared = symbols.select("path", "name", "qualname", (F.col("kind") == "function").alias("is_function"), F.lit(True).alias("is_symbol"))
    asked = calls.where(~F.col("is_method") & F.col("caller").isNotNull()).select("path", "name", F.col("caller").alias("qualname"), F.lit(False).alias("is_symbol"), "callee", "line")
    both = declared.unionByName(asked, allowMissingColumns=True).repartition("path")
    known = both.withColumn("known", F.max("is_symbol").over(Window.partitionBy("path", "qualname"))).where("known")
    there, of_name = F.when(F.col("is_function"), F.col("qualname")), Window.partitionBy("path", "name")
    met = known.withColumns({"least": F.min(there).over(of_name), "last": F.max(there).over(of_name)}).where("not is_symbol")
    own = F.when(F.col("callee").isNull() & (F.col("least") == F.col("last")), F.col("least"))
    return met.select("path", F.col("qualname").alias("caller"), F.when(own.isNull(), F.col("name")).alias("name"), "callee", "line", own.alias("own")).distinct()


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, modules: DataFrame, files: DataFrame, callers: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = spool) -> DataFrame:
    """src_path, src, dst_path, dst, certainty, call_line: each rule names a set of files; one function there is the callee.

    ``callers``: the symbols of the files that the calls are in, where ``symbols`` has those of many more. What a call's own file answers is settled first, as no rule
    goes before it; only other calls look further. ``keep`` writes the result.
    """
    fn = symbols.where("kind = 'function'").select(F.col("path").alias("f"), F.col("name").alias("fname"), F.col("qualname").alias("fq"))
    sites = spool(call_sites(calls, symbols if callers is None else callers))
    local = sites.where("own is not null").select(F.col("path").alias("src_path"), F.col("caller").alias("src"), F.col("path").alias("dst_path"), F.col("own").alias("dst"), F.lit("exact").alias("certainty"), F.col("line").alias("call_line"))
    c = spool(sites.where("own is null").drop("own").withColumn("id", F.monotonically_increasing_id()))  # a call is a number once it is written
    imported = imports.where("resolved_path is not null").select(F.col("path").alias("ip"), "resolved_path", "raw_text")
    word = F.regexp_extract(F.regexp_replace("raw_text", r";$", ""), r"(\w+)$", 1)
    to = lambda rule, f: ["id", "name", F.lit(rule).alias("rule"), F.col(f).alias("f")]

    bare = c.where("callee is null")
    by_path = spool(bare.select("id", "path", "name").join(imported, F.col("path") == F.col("ip")).select("id", "name", "resolved_path", F.expr("contains(raw_text, name)").alias("named")))
    named = by_path.where("named").select(*to(2, "resolved_path"))
    through = named.join(imported.where("raw_text like 'export %'").select(F.col("ip").alias("f"), F.col("resolved_path").alias("far")), "f").select("id", "name", "rule", F.col("far").alias("f"))
    named = spool(named.unionByName(through))
    rest = by_path.select(*to(3, "resolved_path")).join(named.select("id").distinct(), "id", "left_anti")
    sets, made = named.unionByName(rest), [sites, c, by_path, named]

    q = c.where("callee is not null").withColumn("m", F.element_at(F.split("callee", "::"), -2))
    qualified = not q.isEmpty()
    if qualified:
        by_import = q.join(imported.withColumn("w", word), (F.col("path") == F.col("ip")) & (F.col("w") == F.col("m"))).select(*to(5, "resolved_path"))
        by_import = spool(by_import)
        stem = F.regexp_extract("dst", r"(\w+)(?:/mod)?\.rs$", 1)
        by_module = q.join(modules.select(F.col("src").alias("ip"), "dst", stem.alias("w")), (F.col("path") == F.col("ip")) & (F.col("w") == F.col("m"))).select(*to(6, "dst"))
        by_module = spool(by_module.join(by_import.select("id").distinct(), "id", "left_anti"))
        anywhere = q.join(files.select(F.col("path").alias("f"), F.regexp_extract("path", r"/(\w+)(?:/mod)?\.rs$", 1).alias("w")), F.col("w") == F.col("m")).select("id", "name", F.lit(7).alias("rule"), "f")
        anywhere = anywhere.join(by_import.unionByName(by_module).select("id").distinct(), "id", "left_anti")
        sets, made = sets.unionByName(by_import).unionByName(by_module).unionByName(anywhere), [*made, by_import, by_module]

    hits = sets.join(fn, (sets["f"] == fn["f"]) & (sets["name"] == fn["fname"])).select("id", "rule", fn["f"], "fq")
    one = hits.groupBy("id", "rule").agg(F.min(F.struct("f", "fq")).alias("to"), F.max(F.struct("f", "fq")).alias("last")).where("to <=> last").select("id", "rule", "to")
    if qualified:
        one = one.unionByName(q.join(fn, F.col("callee") == F.col("fq")).groupBy("id").agg(F.min(F.struct("f", "fq")).alias("to")).select("id", F.lit(4).alias("rule"), "to"))
    best = one.groupBy("id").agg(F.min(F.struct("rule", "to")).alias("b"))
    far = c.join(best, "id").select(F.col("path").alias("src_path"), F.col("caller").alias("src"), F.col("b.to.f").alias("dst_path"), F.col("b.to.fq").alias("dst"), F.lit("resolved").alias("certainty"), F.col("line").alias("call_line"))
    found = keep(local.unionByName(far.distinct()))
    for done in made:
        drop_spool(done)
    return found


def build(files: DataFrame, aliases: dict | None = None, now: int = 0, churn: DataFrame | None = None) -> Graph:
    """The canonical tables of a scanned tree."""
    files = spool(files)
    return resolve(files.drop("text"), lambda *kinds: extract(files, aliases, kinds), now, churn)


def symbols_of(rows: DataFrame) -> DataFrame:
    sym = last_of(rows.where("record = 'symbol'"), "path", "qualname")
    return sym.select("path", "name", "qualname", "kind", "visibility", "exported", F.col("start_byte").alias("span_start"), F.col("end_byte").alias("span_end"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))


def imports_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    imp = pick(rows.where("record = 'import'"), files)
    found = F.col("resolved_path").isNotNull()
    kind = F.when(found, "relative").when(F.col("spec_kind").isin("external", "alias"), "external").otherwise("unresolved")
    return imp.select(
        "path", "raw_text", kind.alias("import_path_kind"), "resolved_path", F.when(~found, F.col("external_pkg")).alias("external_pkg"), F.col("start_byte").alias("span_start"), F.col("end_byte").alias("span_end"),
        F.col("line").alias("start_line"), F.when(found, "exact").otherwise("heuristic").alias("certainty"),
    )


def file_states(rows: DataFrame, files: DataFrame, now: int = 0) -> DataFrame:
    state = rows.where("record = 'file'").select("path", F.col("kind").alias("parse_status"), F.col("exported").alias("is_barrel"))
    return files.join(state, "path").withColumn("indexed_at", F.lit(now).cast("long"))


def edges_of(imports: DataFrame, modules: DataFrame) -> DataFrame:
    own = imports.where("resolved_path is not null").select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"), F.lit("import").alias("kind"), "certainty").distinct()
    return own.unionByName(modules)


def modules_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    found = pick(rows.where("record = 'module'"), files).where("resolved_path is not null")
    return found.select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"), F.lit("module").alias("kind"), F.lit("exact").alias("certainty")).distinct()


def wants(rows: DataFrame) -> DataFrame:
    """key, path: what each file's resolution asks for besides its own records.

    A key is a path that an import or module may mean, or the module and the function that a qualified call names. Two imports of a file may give a row twice.
    """
    paths = rows.where("record in ('import', 'module')").select(F.explode(F.array_distinct(F.transform("candidates", lambda c: F.concat(F.lit("file:"), c)))).alias("key"), "path")
    asked = rows.where("record = 'call' and callee is not null")
    names = F.array(F.concat(F.lit("stem:"), F.element_at(F.split("callee", "::"), -2)), F.concat(F.lit("fn:"), "callee"))
    return paths.unionByName(asked.select(F.explode(names).alias("key"), "path").distinct()).where("key is not null")


def resolve(files: DataFrame, rows: Callable[..., DataFrame], now: int = 0, churn: DataFrame | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: spool(df)) -> Graph:
    """The canonical tables from all files and rows(kinds), their records of some kinds; each table is made when first asked for, and written by keep(name, table)."""
    no_churn = lambda: files.sparkSession.createDataFrame([], "path string, commit_sha string, author_email string, committed_at long")
    own = Lazy({
        "links": lambda: rows("import", "module"),
        "files": lambda: file_states(rows("file"), files, now),
        "symbols": lambda: symbols_of(rows("symbol")),
        "imports": lambda: imports_of(own.links, files),
        "modules": lambda: modules_of(own.links, files),
        "file_edges": lambda: edges_of(own.imports, own.modules),
    }, {
        "symbol_edges": lambda: resolve_calls(rows("call"), own.symbols, own.imports, own.modules, files, keep=lambda df: keep("symbol_edges", df)),
        "churn": lambda: churn if churn is not None else no_churn(),
    }, keep)
    return own
