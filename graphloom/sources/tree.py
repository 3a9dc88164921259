"""A source tree as tables: files, and what parsing them finds.

Files are scanned as binary files by Spark, so a tree may lie in any store that
Spark reads. Python is parsed with ``ast``, JavaScript and TypeScript by patterns
and are therefore approximate; a file that does not parse gives no rows.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import paths

# What a scan leaves out and what counts as configuration.
EXCLUDED_DIRECTORIES = (".git", "__pycache__", ".pytest_cache", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", ".tox", ".mypy_cache", ".ruff_cache")
EXCLUDED_SUFFIXES = (".min.js", ".min.css")
CONFIG_EXTENSIONS = (".toml", ".yaml", ".yml", ".json", ".ini", ".cfg", ".env", ".lock")


def _relative(root: str) -> Column:
    """The path of a scanned file below the root."""
    top = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z]+:(//)?", "")
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.concat(F.lit("^"), F.regexp_replace(top, r"([.\\+*?\[^\]$(){}=!<>|:\-])", r"\\$1")), F.lit(""))


def ignore_lines(spark: SparkSession, root: str) -> DataFrame:
    """(folder, line_no, line) of the ignore file at the root, none if there is none.

    Spark's file sources pass over names with a leading dot, so this one small file is opened by itself.
    """
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    lines = []
    if store.exists(path):
        stream = store.open(path)
        try:
            lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        finally:
            stream.close()
    return spark.createDataFrame([("", i, line) for i, line in enumerate(lines)], "folder string, line_no int, line string")


def scan_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), ignore: DataFrame | None = None) -> DataFrame:
    """(path, name, extension, language, size_bytes, line_count, source_hash, is_test, is_config, text) of the known languages, any order.

    What the ignore file at the root leaves out is left out; ``ignore`` (folder, line_no, line) takes its place, with
    lines of any folders. Files of no bytes are not seen: Spark's file sources pass over them.
    """
    from graphloom.operators.ignore import ignored, rules

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = raw.select(_relative(root).alias("path"), F.col("length").alias("size_bytes"), text.alias("text"), F.sha2("content", 256).alias("source_hash"))
    kept = files.withColumn("language", paths.language_of(F.col("path"))).where(F.col("language").isNotNull() & ~paths.has_segment(F.col("path"), EXCLUDED_DIRECTORIES + exclude))
    for suffix in EXCLUDED_SUFFIXES:
        kept = kept.where(~F.col("path").endswith(suffix))
    told = rules(ignore if ignore is not None else ignore_lines(spark, root))
    if not told.isEmpty():
        names = raw.select(_relative(root).alias("path"))  # a listing: contents are not read for it
        kept = kept.join(ignored(names, told), "path", "left_anti")
    return kept.select(
        "path", F.substring_index("path", "/", -1).alias("name"), paths.extension(F.col("path")).alias("extension"), "language", "size_bytes",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line_count"), "source_hash",
        paths.is_test_path(F.col("path")).alias("is_test"), paths.extension(F.col("path")).isin(*CONFIG_EXTENSIONS).alias("is_config"), "text",
    )


def folders(files: DataFrame) -> DataFrame:
    """(path, depth) of every directory above a file; the root is ``.`` at depth 0."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.when(n == 0, ".").otherwise(F.array_join(F.slice(parts, 1, n), "/")).alias("path"), n.alias("depth")))
    return files.select(F.inline(each)).distinct()


def vendored(files: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Directories that look like copies of known packages: the name, an ``__init__.py`` and a packaging file."""
    by = files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"))
    told = by.agg(F.bool_or(F.col("name") == "__init__.py").alias("package"), F.bool_or(F.col("name").isin("setup.py", "pyproject.toml", "setup.cfg", "PKG-INFO", "METADATA")).alias("packed"))
    return told.where(F.col("package") & F.col("packed") & F.substring_index("directory", "/", -1).isin(*known)).select("directory")


#: What parsing finds, a row per file.
PARSED = (
    "path string, functions array<struct<qualified_name:string,name:string,line_start:long,line_end:long,is_async:boolean,is_method:boolean,is_exported:boolean,decorators:array<string>,param_names:array<string>,return_type:string,docstring:string,signature:string,source_hash:string,route_path:string,http_method:string>>, "
    "classes array<struct<name:string,line_start:long,line_end:long,base_names:array<string>,docstring:string>>, "
    "imports array<struct<module_path:string,name:string,original:string,is_wildcard:boolean,line_number:long>>, "
    "calls array<struct<caller:string,callee:string,line:long,argument_exprs:array<string>,keyword_args:map<string,string>,target:string>>, "
    "variables array<struct<function:string,name:string,line_number:long,inferred_type:string,is_parameter:boolean,position:int,is_return:boolean>>, "
    "flows array<struct<function:string,source:string,target:string,line_number:long>>"
)
#: The caller of what runs when a module is loaded; the variable that a function gives back.
_ROUTERS = ("route", "get", "post", "put", "patch", "delete", "websocket")
MODULE, RETURNED = "__module__", "<return>"


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def _kind(value: ast.AST | None) -> str | None:
    if isinstance(value, ast.Constant):
        return type(value.value).__name__.replace("NoneType", "None")
    if isinstance(value, ast.Call):
        return _dotted(value.func)
    return {ast.List: "list", ast.Dict: "dict", ast.Tuple: "tuple", ast.Set: "set"}.get(type(value))


def _route(decorators: list[ast.AST]) -> dict[str, str]:
    """The address and the method that the first decorator of a route tells; a plain ``route`` without a list tells none."""
    for d in decorators:
        name = _dotted(d.func).rsplit(".", 1)[-1] if isinstance(d, ast.Call) and _dotted(d.func) else None
        if name in _ROUTERS:
            given = {k.arg: k.value for k in d.keywords}
            path = d.args[0] if d.args else given.get("path", given.get("rule"))
            methods = [m.value for m in getattr(given.get("methods"), "elts", []) if isinstance(m, ast.Constant)]
            return {"route_path": str(path.value) if isinstance(path, ast.Constant) else None, "http_method": str(methods[0]).upper() if methods else None if name == "route" else name.upper()}
    return {"route_path": None, "http_method": None}


def _nothing() -> dict[str, list]:
    return {"functions": [], "classes": [], "imports": [], "calls": [], "variables": [], "flows": []}


class _Python(ast.NodeVisitor):
    def __init__(self, source: str):
        self.lines = source.split("\n")
        self.out: dict[str, list] = _nothing()
        self.targets: dict[int, str] = {}  # calls whose value a variable takes
        self.scope: list[tuple[str, bool]] = []  # name, is it a class

    def _function(self) -> str:
        names = [n for n, _ in self.scope]
        while self.scope and names and self.scope[len(names) - 1][1]:
            names.pop()
        return ".".join(names) or MODULE

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b for b in map(_dotted, node.bases) if b]
        self.out["classes"].append({"name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "base_names": bases, "docstring": ast.get_docstring(node)})
        self._inside(node, node.name, True)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a = node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")]
        q = ".".join([*(n for n, _ in self.scope), node.name])
        body = "\n".join(self.lines[node.lineno - 1 : node.end_lineno])
        self.out["functions"].append({
            "qualified_name": q, "name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "is_async": isinstance(node, ast.AsyncFunctionDef),
            "is_method": bool(self.scope) and self.scope[-1][1], "is_exported": not node.name.startswith("_") or node.name.startswith("__"),
            "decorators": [d for d in (_dotted(x.func if isinstance(x, ast.Call) else x) for x in node.decorator_list) if d], "param_names": names,
            "return_type": ast.unparse(node.returns) if node.returns else None, "docstring": ast.get_docstring(node),
            "signature": f"def {node.name}({ast.unparse(a)})", "source_hash": hashlib.sha256(body.encode()).hexdigest(), **_route(node.decorator_list),
        })
        self.out["variables"] += [{"function": q, "name": n, "line_number": node.lineno, "inferred_type": None, "is_parameter": True, "position": i, "is_return": False} for i, n in enumerate(names)]
        self._inside(node, node.name, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _inside(self, node, name: str, is_class: bool) -> None:
        self.scope.append((name, is_class))
        self.generic_visit(node)
        self.scope.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self._import(x.name, x.asname or x.name.split(".")[0], None, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for x in node.names:
            self._import("." * node.level + (node.module or ""), x.asname or x.name, x.name, node.lineno)

    def _import(self, module: str, name: str, original: str | None, line: int) -> None:
        self.out["imports"].append({"module_path": module, "name": name, "original": original, "is_wildcard": original == "*", "line_number": line})

    def visit_Call(self, node: ast.Call) -> None:
        callee = _dotted(node.func)
        if callee:
            self.out["calls"].append({"caller": self._function(), "callee": callee, "line": node.lineno, "argument_exprs": [ast.unparse(a) for a in node.args], "keyword_args": {k.arg: ast.unparse(k.value) for k in node.keywords if k.arg}, "target": self.targets.get(id(node))})
        self.generic_visit(node)

    def _takes(self, name: str, value: ast.AST) -> None:
        """A variable takes a value: that of a call, or of the variables in an expression without calls."""
        if isinstance(value, ast.Call):
            self.targets[id(value)] = name
        elif not any(isinstance(x, ast.Call) for x in ast.walk(value)):
            self.out["flows"] += [{"function": self._function(), "source": x.id, "target": name, "line_number": value.lineno} for x in ast.walk(value) if isinstance(x, ast.Name)]

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.out["variables"].append({"function": self._function(), "name": t.id, "line_number": node.lineno, "inferred_type": _kind(node.value), "is_parameter": False, "position": None, "is_return": False})
                self._takes(t.id, node.value)
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None:
            self.out["variables"].append({"function": self._function(), "name": RETURNED, "line_number": node.lineno, "inferred_type": None, "is_parameter": False, "position": None, "is_return": True})
            self._takes(RETURNED, node.value)
        self.generic_visit(node)


_JS_FUNCTION = re.compile(r"(?:^|[^\w.$])(async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(async\s+)?(?:function\s*\(([^)]*)\)|\(([^)]*)\)\s*=>|([A-Za-z_$][\w$]*)\s*=>)")
_JS_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([A-Za-z_$][\w$.]*))?\s*\{")
_JS_IMPORT = re.compile(r"""import\s+(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*["']([^"']+)["']|require\(\s*["']([^"']+)["']\s*\)""")
_JS_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_JS_WORDS = frozenset("if for while switch catch function return typeof new await async super import require constructor".split())


def _javascript(source: str) -> dict[str, list]:
    """Declarations, imports and calls by pattern; a function reaches to its closing brace at equal depth."""
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    line = lambda at: bare.count("\n", 0, at) + 1
    out: dict[str, list] = _nothing()
    for m in _JS_FUNCTION.finditer(bare):
        name, end, depth = m[2] or m[4], m.end(), 0
        opened = bare.find("{", m.end())
        for i in range(opened, len(bare) if opened >= 0 else 0):
            depth += (bare[i] == "{") - (bare[i] == "}")
            if not depth:
                end = i
                break
        params = [p.strip().split("=")[0].split(":")[0].strip() for p in (m[3] or m[6] or m[7] or m[8] or "").split(",") if p.strip()]
        body = source[m.start() : end + 1]
        out["functions"].append({"qualified_name": name, "name": name, "line_start": line(m.start(2) if m[2] else m.start(4)), "line_end": line(end), "is_async": bool(m[1] or m[5]), "is_method": False, "is_exported": not name.startswith("_"), "decorators": [], "param_names": params, "return_type": None, "docstring": None, "signature": f"function {name}({', '.join(params)})", "source_hash": hashlib.sha256(body.encode()).hexdigest()})
    for m in _JS_CLASS.finditer(bare):
        out["classes"].append({"name": m[1], "line_start": line(m.start()), "line_end": line(m.end()), "base_names": [m[2]] if m[2] else [], "docstring": None})
    for m in _JS_IMPORT.finditer(bare):
        names = [n.strip() for n in (m[2] or "").split(",") if n.strip()]
        for n in ([m[1]] if m[1] else []) + names or [None]:
            original, _, used = (n or "").partition(" as ")
            out["imports"].append({"module_path": m[3] or m[4], "name": (used or original).strip() or None, "original": original.strip() or None, "is_wildcard": False, "line_number": line(m.start())})
    for m in _JS_CALL.finditer(bare):
        if m[1].split(".")[-1] in _JS_WORDS or re.search(r"function\s*\*?\s*$", bare[: m.start()][-12:]):
            continue
        at = line(m.start())
        owner = [f for f in out["functions"] if f["line_start"] <= at <= f["line_end"]]
        out["calls"].append({"caller": min(owner, key=lambda f: f["line_end"] - f["line_start"])["qualified_name"] if owner else MODULE, "callee": m[1], "line": at, "argument_exprs": []})
    return out


def parse_source(language: str, source: str) -> dict[str, list]:
    """What one file holds; nothing if it does not parse."""
    if language == "python":
        try:
            visitor = _Python(source)
            visitor.visit(ast.parse(source))
            return visitor.out
        except (SyntaxError, ValueError, RecursionError):
            pass
    elif language in ("javascript", "typescript"):
        return _javascript(source)
    return _nothing()


def parse(files: DataFrame) -> DataFrame:
    """One row per file with arrays of what it holds; files are independent, so no row is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p, **parse_source(lang, t or "")} for p, lang, t in zip(batch["path"], batch["language"], batch["text"])], columns=["path", *_nothing()])

    return files.select("path", "language", "text").mapInPandas(run, PARSED)


def exploded(parsed: DataFrame, what: str) -> DataFrame:
    """The rows of one of the arrays beside their file."""
    return parsed.select(F.col("path").alias("file_path"), F.inline(what))
