"""Parsing, imports, control and data flow, calls and packages over small repositories.

The tables of a scale factor hold no source code, so the inputs are literals, and the rows of the SQL are
worked out by hand from what each operator is to give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Repository
from ..operators import calls, chat, graph, imports, packing, parsing, report, search
from ..sources import packages, repository
from ..streaming import changes

REPO = {
    "pkg/__init__.py": "from .core import Engine\n",
    "pkg/core.py": 'import os\nimport numpy as np\n\n\nclass Base:\n    pass\n\n\nclass Engine(Base):\n    """Runs.\n\n    Twice."""\n\n    def start(self, n: int = 1) -> int:\n        self.warm()\n        x = helper(n)\n        return x\n\n    def warm(self):\n        return None\n\n\ndef helper(n):\n    return n\n',
    "app.py": "from pkg import Engine\nimport pkg.core as core\nfrom pkg.core import helper as h, Engine as E\nfrom nowhere import z\n\n\ndef main(a, *rest, flag=False):\n    e = Engine()\n    y = core.helper(a, n=2)\n    h(y)\n    E.warm(e)\n    len(rest)\n    if flag:\n        e.start(h(y))\n    return twin(y)\n",
    "one.py": "def twin(v):\n    return v\n\n\ndef solo(v):\n    return twin(v)\n",
    "two.py": "import app\n\n\ndef twin(v):\n    return solo(v)\n",
    "three.py": "class Engine:\n    def warm(self):\n        return 3\n",
    "broken.py": "import one\n\n\ndef ok():\n    return 1\n\n\ndef bad(:\n    pass\n",
}
SCRIPTS = {
    "web/main.ts": 'import { a as b } from "@/ui/x";\nimport util from "./util";\nexport * from "../lib/z";\nconst p = require("react/jsx");\nimport "@scope/thing/deep";\nimport "/web/util";\n',
    "web/util.js": "export function f(x) { return x; }\n",
    "src/ui/x/index.tsx": "export const g = 1;\n",
    "lib/z.mjs": "",
    "lib/z.cjs": "",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}\n',
    "package.json": '{"dependencies": {"react": "18", "@scope/other": "1"}, "devDependencies": {"vite": "5"}}',
}
PROJECT = {
    "requirements.txt": "PyYAML>=5  # yaml\n-r more.txt\n\nscikit-learn==1\n",
    "requirements/dev.txt": "opencv-python[x]\n",
    "deep/down/requirements.txt": "unseen\n",
    "pyproject.toml": '[project]\ndependencies = ["requests[socks]>=2", "python-dateutil"]\n[tool.poetry.dependencies]\npython = "^3"\nattrs = "1"\n',
    "sub/pyproject.toml": "[[[ no toml",
}
#: One function a case, named after it.
FLOWS = {
    "if_else": "def if_else(a):\n    if a:\n        x = 1\n    else:\n        x = 2\n    return x\n",
    "if_only": "def if_only(a):\n    if a:\n        x = 1\n    return a\n",
    "elif_": "def elif_(a):\n    if a > 1:\n        x = 1\n    elif a:\n        x = 2\n    else:\n        x = 3\n    y = x\n",
    "for_else": "def for_else(a):\n    for i in a:\n        x = i\n    else:\n        x = 0\n    return x\n",
    "while_": "def while_(a):\n    while a:\n        if a == 1:\n            break\n        continue\n    return a\n",
    "try_": "def try_():\n    try:\n        x = 1\n    except E:\n        x = 2\n    else:\n        x = 3\n    finally:\n        y = x\n",
    "with_": "def with_(p):\n    with open(p) as f:\n        x = f\n    return x\n",
    "match_": "def match_(v):\n    match v:\n        case 1:\n            x = 1\n        case _:\n            x = 2\n    return x\n",
    "dead": "def dead():\n    return 1\n    x = 2\n",
    "raise_": "def raise_(e):\n    raise e\n",
    "twice": "def twice():\n    x = 1\n    x = 2\n    y = x\n",
    "loop": "def loop(n):\n    s = 0\n    while n:\n        s += n\n        n = n - 1\n    return s\n",
}


def files_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def values(columns: str, *rows: tuple) -> str:
    """SQL of literal rows; columns is "name TYPE, ..."."""
    names, kinds = zip(*(c.strip().split(" ", 1) for c in columns.split(",")))

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(literal, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {k})" for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def holds(columns: str, *rows: tuple):
    """Registers a query with the rows that it must give."""

    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, values(columns, *rows)
        return f

    return register


# ---- sources


@holds("path VARCHAR", ("a.py",), (".hidden",), ("src/b.py",), ("logs/keep.log",), ("logs/d.log",), ("deep/out/e.py",))
def q40_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ("a.py", ".hidden", ".git/config", "node_modules/x.js", "src/b.py", "src/build/c.py", "logs/d.log", "logs/e.log", "logs/keep.log", "deep/out/e.py", "out/f.py", "mine/g.py")
    rules = [r for x in ("# logs", "*.log", "!keep.log", "/out/") if (r := repository.ignore_pattern(x))]
    tracked = spark.createDataFrame([("logs/d.log",), ("src/b.py",), ("gone.py",)], "path string")
    return repository.scan(spark.createDataFrame([(p,) for p in paths], "path string"), repository.ignore_list("# own\nmine/\n"), rules, tracked)


@holds("package VARCHAR", ("yaml",), ("pyyaml",), ("sklearn",), ("scikit_learn",), ("scikit",), ("cv2",), ("opencv_python",), ("opencv",))
def q41_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.requirements(files_of(spark, PROJECT))


@holds("package VARCHAR", ("requests",), ("dateutil",), ("python_dateutil",), ("python",), ("attrs",))
def q42_pyproject_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.pyproject_dependencies(files_of(spark, PROJECT))


@holds("package VARCHAR", *((p,) for p in sorted({*packages.COMMON, "yaml", "pyyaml", "scikit_learn", "scikit", "opencv_python", "opencv", "dateutil", "python_dateutil", "python", "attrs"})))
def q43_third_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.third_party(files_of(spark, PROJECT))


@holds("package VARCHAR", *((p,) for p in ("react", "@scope/other", "@scope", "vite", *packages.NODE_BUILTINS)))
def q44_node_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.node_packages(files_of(spark, SCRIPTS | {"node_modules/x/package.json": '{"dependencies": {"inner": "1"}}', "bad/package.json": "{"}))


_HATCH = '[tool.hatch.build.targets.wheel]\npackages = ["lib2/x"]\n[tool.setuptools.packages.find]\nwhere = ["other"]\n'
ROOTS = {
    "src": {"src/a/__init__.py": "", "src/a/b.py": "", "tests/t.py": ""},
    "src is a package": {"src/__init__.py": "", "code/a/__init__.py": ""},
    "legacy": {"code/a/__init__.py": "", "tests/t.py": ""},
    "namespace": {"code/m.py": "", "tests/t.py": "", "top.py": ""},
    "hatch": {"pyproject.toml": _HATCH, "lib2/x/m.py": "", "other/y/m.py": ""},
    "setuptools": {"pyproject.toml": '[tool.setuptools.package-dir]\n"" = "here"\n', "here/y/m.py": ""},
    "setuptools packages": {"pyproject.toml": '[tool.setuptools.package-dir]\n"a.b" = "below/a/b"\n', "below/a/b/m.py": ""},
    "poetry": {"pyproject.toml": '[tool.poetry]\npackages = [{include = "x", from = "py"}]\n', "py/x/m.py": ""},
    "workspace": {"pyproject.toml": '[tool.uv.workspace]\nmembers = ["libs/*"]\n', "libs/one/pyproject.toml": "", "libs/one/src/one/m.py": ""},
    "declared but absent": {"pyproject.toml": _HATCH, "lib/z/m.py": ""},
}


@holds("repo VARCHAR, place INTEGER, root VARCHAR", ("src", 0, "src"), ("src is a package", 0, "code"), ("legacy", 0, "code"), ("namespace", 0, "code"), ("hatch", 0, "lib2"), ("setuptools", 0, "here"), ("setuptools packages", 0, "below"), ("poetry", 0, "py"), ("workspace", 0, "libs/one/src"), ("declared but absent", 0, "lib"))
def q45_source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, i, root) for name, texts in ROOTS.items() for i, root in enumerate(packages.source_roots(files_of(spark, texts)))]
    return spark.createDataFrame(rows, "repo string, place int, root string")


@holds("base VARCHAR, pattern VARCHAR, target VARCHAR", ("app", "@/*", "src/*"), ("app", "~x", "lib/x"))
def q46_path_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, pairs = packages.path_aliases([("jsconfig.json", '{"compilerOptions": {"paths": {"no": ["no"]}}}'), ("tsconfig.json", '{// c\n"compilerOptions": {"baseUrl": "./app", /* d */ "paths": {"@/*": ["src/*"], "~x": ["lib/x"],}}}')])
    return spark.createDataFrame([(base, p, t) for p, t in pairs], "base string, pattern string, target string")


# ---- parsing

_PY = "import a as b\n\n\nclass A(B):\n    def f(self, x: T) -> R:\n        y = g(x)\n        return y\n\n\nz = [k for k in A.m]\nw: V = h.i(q=z)[0]\n"


@holds(
    "name VARCHAR, kind VARCHAR, start_byte INTEGER, end_byte INTEGER, is_definition BOOLEAN",
    ("b", "variable", 12, 13, True), ("A", "class", 22, 23, True), ("B", "argument", 24, 25, False), ("f", "function", 36, 37, True), ("T", "type", 47, 48, False), ("R", "type", 53, 54, False),
    ("y", "variable", 64, 65, True), ("g", "call", 68, 69, False), ("x", "argument", 70, 71, False), ("y", "variable", 88, 89, False),
    ("z", "variable", 92, 93, True), ("k", "variable", 103, 104, True), ("A", "variable", 108, 109, False),
    ("w", "variable", 113, 114, True), ("V", "type", 116, 117, False), ("h", "variable", 120, 121, False), ("i", "method", 122, 123, False), ("z", "argument", 126, 127, False),
)
def q50_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.symbols(files_of(spark, {"a.py": _PY, "bad.py": "def (", "c.rs": "fn x() {}"})).drop("path")


_TS = "export function f(a) { return g(a); }\nconst h = (x) => x;\nclass K { m() { new K(); } }\ninterface I { n: number }\ntype T = string;\nenum E { A }\n"


@holds(
    "name VARCHAR, kind VARCHAR, start_byte INTEGER, end_byte INTEGER, is_definition BOOLEAN",
    ("f", "function", 16, 17, True), ("g", "call", 30, 31, False), ("h", "function", 44, 45, True), ("h", "variable", 44, 45, True), ("K", "class", 64, 65, True), ("m", "method", 68, 69, True),
    ("K", "class", 78, 79, False), ("I", "interface", 97, 98, True), ("T", "type", 118, 119, True), ("E", "enum", 135, 136, True),
)
def q51_script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.symbols(files_of(spark, {"a.ts": _TS})).drop("path")


@holds(
    "path VARCHAR, skeleton VARCHAR",
    ("core.py", 'import os\nimport numpy as np\n\nclass Base:\n\nclass Engine(Base):\n    """Runs.\n\n    Twice."""\n\n    def start(self, n: int = 1) -> int:\n        ...\n\n    def warm(self):\n        ...\n\ndef helper(n):\n    ...\n'),
    ("broken.py", "def ok():\ndef bad(:"), ("x.txt", "def a\nb\n"), ("none.py", None),
)
def q52_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skeleton keeps imports, signatures and docstrings; a broken file its signature lines; another file its text."""
    return parsing.skeletons(files_of(spark, {"core.py": REPO["pkg/core.py"], "broken.py": REPO["broken.py"], "x.txt": "def a\nb\n", "none.py": None}))


@holds("path VARCHAR, is_valid BOOLEAN, line INTEGER", ("a.py", True, None), ("b.py", False, 2), ("c.js", True, None), ("d.ts", False, 1), ("e.js", False, 2), ("f.xyz", True, None))
def q53_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"a.py": "x = 1\n", "b.py": "x = 1\ny = (\n", "c.js": "f('(') // (\n", "d.ts": "function f( {\n", "e.js": "a;\n'b\n", "f.xyz": "((("}
    return parsing.checked(files_of(spark, texts)).select("path", "is_valid", "line")


@holds(
    "node_no INTEGER, parent_no INTEGER, depth INTEGER, kind VARCHAR, text VARCHAR, start_byte INTEGER, end_byte INTEGER",
    (0, -1, 0, "Module", None, 0, 18), (1, 0, 1, "Assign", None, 0, 9), (2, 1, 2, "Name", "x", 0, 1), (3, 1, 2, "BinOp", None, 4, 9), (4, 3, 3, "Name", "a", 4, 5), (5, 3, 3, "Constant", "1", 8, 9), (6, 0, 1, "Call", None, 10, 17), (7, 6, 2, "Name", "print", 10, 15),
)
def q54_normalized_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.normalized_trees(files_of(spark, {"a.py": "x = a + 1\nprint()\n"})).drop("path")


@holds("name VARCHAR, kind VARCHAR, is_definition BOOLEAN", ("ok", "function", True), ("late", "variable", True))
def q55_partial_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sound parts of a file with errors define."""
    return parsing.symbols(files_of(spark, {"broken.py": REPO["broken.py"] + "late = 1\n"}), partial=True).select("name", "kind", "is_definition")


@holds("name VARCHAR, n_parameters INTEGER, return_type VARCHAR, docstring VARCHAR", ("start", 2, "int", None), ("warm", 1, None, None), ("helper", 1, None, None))
def q56_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsing.signatures(parsing.cpg_nodes(files_of(spark, {"core.py": REPO["pkg/core.py"]})))
    return found.select("name", F.size("parameters").alias("n_parameters"), "return_type", "docstring")


@holds("path VARCHAR, content VARCHAR, end_line INTEGER, end_column INTEGER", ("a.py", "xé = 2\ny = 3\nz\n", 1, 5), ("b.py", "new", 7, 6))
def q57_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits in turn, with characters of several bytes, and one beyond the end, whose own end counts from the place that it names."""
    files = files_of(spark, {"a.py": "é = 1\nz\n", "b.py": "", "c.py": "same"})
    edits = [("a.py", 1, 0, 0, 0, 1, "xé"), ("a.py", 2, 0, 5, 0, 6, "2\ny = 3"), ("b.py", 1, 7, 3, 9, 9, "new"), ("gone.py", 1, 0, 0, 0, 0, "x")]
    return parsing.edited(files, spark.createDataFrame(edits, "path string, seq int, start_line int, start_column int, end_line int, end_column int, text string"))


@holds("path VARCHAR", ("src/a.py",), ("b.py",), ("latest.py",))
def q58_excluded_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.excluding(files_of(spark, dict.fromkeys(("src/a.py", "b.py", "latest.py", "tests/c.py", "x/mytests/d.py"), "")), ("tests",)).select("path")


# ---- imports


@holds("module VARCHAR, path VARCHAR, source_root VARCHAR", ("src.z", "src/z/__init__.py", ""), ("src.z.v", "src/z/v.py", ""), ("z", "src/z/__init__.py", "src"), ("z.v", "src/z/v.py", "src"), ("v", "v.py", ""), ("m", "m.py", ""), ("src.m", "src/m.py", ""))
def q60_module_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name counted from the project's root goes before one counted from a source root (m)."""
    return imports.module_index(files_of(spark, dict.fromkeys(("src/z/__init__.py", "src/z/v.py", "v.py", "m.py", "src/m.py", "x.js"), "")), ("src",))


_RELATIVE = {
    "p/__init__.py": "", "p/a.py": "from . import b, c as d\nfrom .b import x as y\nfrom .. import q\nfrom .nothing import z\nfrom . import *\nimport os, numpy.linalg\n", "p/b.py": "x = 1\n", "p/c.py": "", "p/s/__init__.py": "",
    "p/s/t.py": "from ..b import x\n", "n/m.py": "from .o import k\nfrom ..p import b\n", "n/o.py": "k = 1\n",
}


def _resolved(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    files = files_of(spark, texts)
    return imports.resolved(parsing.imports(files), files, imports.module_index(files), (), packages.third_party(files))


@holds(
    "path VARCHAR, statement INTEGER, name VARCHAR, status VARCHAR, resolved_path VARCHAR, as_module BOOLEAN",
    ("p/a.py", 0, "b", "project", "p/b.py", True), ("p/a.py", 0, "c", "project", "p/c.py", True), ("p/a.py", 1, "x", "project", "p/b.py", False), ("p/a.py", 2, "q", "project", None, False), ("p/a.py", 3, "z", "project", None, False),
    ("p/a.py", 4, "*", "project", "p/__init__.py", False), ("p/a.py", 5, None, "stdlib", None, True), ("p/a.py", 5, None, "external", None, True), ("p/s/t.py", 0, "x", "project", "p/b.py", False), ("n/m.py", 0, "k", "project", "n/o.py", False),
    ("n/m.py", 1, "b", "project", None, False),
)
def q61_resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, wildcard, standard and foreign imports; a file outside of packages climbs one folder more (n/m.py)."""
    return _resolved(spark, _RELATIVE).select("path", "statement", "name", "status", "resolved_path", "as_module")


@holds(
    "src VARCHAR, dst VARCHAR", ("pkg/__init__.py", "pkg/core.py"), ("app.py", "pkg/__init__.py"), ("app.py", "pkg/core.py"), ("two.py", "app.py"),
)
def q62_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With what package files import from elsewhere: app reaches core through the package too."""
    return imports.import_targets(_resolved(spark, REPO))


@holds("path VARCHAR, attempted BIGINT, failed BIGINT", ("p/a.py", 5, 3), ("p/s/t.py", 1, 0), ("n/m.py", 2, 1))
def q63_import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In p/a.py the second to fourth statement add no new path, the fifth adds the package; standard and foreign modules of the sixth don't count."""
    return imports.counters(_resolved(spark, _RELATIVE))


@holds(
    "path VARCHAR, local_name VARCHAR, resolved_path VARCHAR, imported_symbol VARCHAR",
    ("pkg/__init__.py", "Engine", "pkg/core.py", "Engine"), ("app.py", "Engine", "pkg/__init__.py", "Engine"), ("app.py", "core", "pkg/core.py", None), ("app.py", "h", "pkg/core.py", "helper"), ("app.py", "E", "pkg/core.py", "Engine"), ("two.py", "app", "app.py", None),
)
def q64_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.bindings(_resolved(spark, REPO))


@holds(
    "statement INTEGER, form VARCHAR, module VARCHAR, name VARCHAR, alias VARCHAR, line INTEGER",
    (0, "import", "@/ui/x", "a", "b", 1), (1, "import", "./util", "default", "util", 2), (2, "export", "../lib/z", "*", None, 3), (3, "require", "react/jsx", None, None, 4), (4, "import", "@scope/thing/deep", None, None, 5), (5, "import", "/web/util", None, None, 6),
)
def q65_script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.imports(files_of(spark, {"web/main.ts": SCRIPTS["web/main.ts"]})).select("statement", "form", "module", "name", "alias", "line")


@holds("module VARCHAR, resolved_path VARCHAR", ("@/ui/x", "src/ui/x/index.tsx"), ("./util", "web/util.js"), ("../lib/z", "lib/z.mjs"), ("/web/util", "web/util.js"))
def q66_script_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, SCRIPTS)
    base, pairs = packages.path_aliases([("tsconfig.json", SCRIPTS["tsconfig.json"])])
    return imports.js_resolved(parsing.imports(files), files, spark.createDataFrame(pairs, "pattern string, target string"), base).select("module", "resolved_path")


@holds("module VARCHAR, path VARCHAR", ("web/main", "web/main.ts"), ("web/util", "web/util.js"), ("src/ui/x/index", "src/ui/x/index.tsx"), ("src/ui/x", "src/ui/x/index.tsx"), ("lib/z", "lib/z.cjs"))
def q67_script_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.js_module_index(files_of(spark, SCRIPTS))


@holds("module VARCHAR, package VARCHAR", ("react/jsx", "react"), ("@scope/thing/deep", "@scope/thing"))
def q68_script_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By package, or by a scope that is known; aliases and paths are neither."""
    files = files_of(spark, SCRIPTS)
    return imports.js_external(parsing.imports(files), packages.node_packages(files)).select("module", "package")


@holds(
    "step INTEGER, label VARCHAR, value VARCHAR",
    *((1, "statement", f"from pkg.core {n}") for n in ("helper", "Engine")), *[(2, "root", "pkg"), (3, "status", "project"), (4, "key", "pkg.core"), (5, "fallback", None), (6, "resolved", "pkg/core.py"), (7, "binds", "symbol")] * 2,
)
def q69_explained_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a statement that imports two names."""
    return imports.explained(_resolved(spark, REPO).filter("form = 'from'"), "app.py", "pkg.core")


# ---- the file graph


@holds("src VARCHAR, dst VARCHAR, kind VARCHAR, strength DOUBLE", ("pkg/__init__.py", "pkg/core.py", "Import", 2.0), ("app.py", "pkg/__init__.py", "Import", 2.0), ("app.py", "pkg/core.py", "Import", 2.0), ("two.py", "app.py", "Import", 2.0))
def q70_repository_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repository(files_of(spark, REPO), ()).edges


@holds(
    "src VARCHAR, dst VARCHAR, kind VARCHAR, change VARCHAR", ("two.py", "app.py", "Import", "removed"), ("two.py", "one.py", "Import", "added"), ("app.py", "pkg/__init__.py", "Import", "removed"), ("app.py", "pkg/core.py", "Import", "removed"), ("app.py", "one.py", "Import", "added"),
    ("new.py", "one.py", "Import", "added"), ("pkg/__init__.py", "pkg/core.py", "Import", "removed"),
)
def q71_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file changed, one gone, one that breaks (and keeps its text), a new one with an error whose sound part counts."""
    repo = Repository(files_of(spark, REPO), ())
    changed = files_of(spark, {"two.py": "import one\n", "app.py": "import one\n", "one.py": "def (", "new.py": "import one\n\n\ndef (\n"})
    return repo.update(changed, spark.createDataFrame([("pkg/core.py",)], "path string"))


@holds("edges_added BIGINT, edges_removed BIGINT, dirty BOOLEAN", (2, 1, True))
def q71b_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge that changes its kind goes and comes."""
    old, new = (spark.createDataFrame(rows, "src string, dst string, kind string") for rows in ([("a", "b", "Import"), ("a", "c", "SymbolUsage")], [("a", "b", "Import"), ("a", "c", "Import"), ("b", "c", "Import")]))
    return graph.change_counts(graph.edge_differences(old, new))


@holds("dst VARCHAR, n_waiting BIGINT", ("lib.pyi", 1), ("broken.py", 2))
def q72_waiting_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of a file that isn't a node, here one with a syntax error."""
    resolved = spark.createDataFrame([("a.py", "broken.py"), ("b.py", "broken.py"), ("b.py", "broken.py"), ("a.py", "lib.pyi"), ("a.py", "b.py")], "src string, dst string")
    return graph.unresolved(resolved, files_of(spark, {"a.py": "", "b.py": ""}))


@holds("depth INTEGER, parent VARCHAR, name VARCHAR, is_dir BOOLEAN", (0, "", "a", True), (0, "", "z.py", False), (1, "a", "b", True), (1, "a", "c.py", False), (2, "a/b", "d.py", False))
def q73_directory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.directory_entries(files_of(spark, dict.fromkeys(("a/b/d.py", "a/c.py", "z.py"), "")))


@holds("line_no INTEGER, line VARCHAR", (0, "a/"), (1, "  b/"), (2, "    d.py"), (3, "  c.py"), (4, "z.py"))
def q74_directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = report.tree(report.directory_entries(files_of(spark, dict.fromkeys(("a/b/d.py", "a/c.py", "z.py"), ""))))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


@holds("path VARCHAR, known BOOLEAN", ("app.py", True), ("broken.py", False), ("gone.py", False))
def q75_has_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = Repository(files_of(spark, REPO), ()).nodes
    return spark.createDataFrame([(p, graph.has_file(nodes, p)) for p in ("app.py", "broken.py", "gone.py")], "path string, known boolean")


# ---- the property graph


@holds(
    "name VARCHAR, kind VARCHAR, start_line INTEGER, end_line INTEGER, parent_class VARCHAR, bases VARCHAR[], docstring VARCHAR",
    ("Base", "class", 5, 6, None, [], None), ("Engine", "class", 9, 20, None, ["Base"], "Runs.\n\n    Twice."), ("start", "method", 14, 17, "Engine", [], None), ("warm", "method", 19, 20, "Engine", [], None), ("helper", "function", 23, 24, None, [], None),
)
def q80_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsing.cpg_nodes(files_of(spark, {"core.py": REPO["pkg/core.py"]}))
    return nodes.filter(F.col("kind").isin("class", "function", "method", "variable")).select("name", "kind", "start_line", "end_line", "parent_class", "bases", "docstring")


@holds(
    "place INTEGER, name VARCHAR, type_annotation VARCHAR, default_value VARCHAR",
    (0, "self", None, None), (1, "a", None, None), (2, "b", "int", None), (3, "c", None, "1"), (4, "d", "List[str]", "None"), (5, "*args", None, None), (6, "e", None, "2"), (7, "**kw", "Any", None),
)
def q81_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsing.cpg_nodes(files_of(spark, {"a.py": "class A:\n    @staticmethod\n    async def f(self, a, b: int, c=1, d: List[str] = None, *args, e=2, **kw: Any):\n        pass\n"}))
    found = nodes.filter("kind = 'method'").select(F.posexplode("parameters").alias("place", "p"))
    return found.select("place", "p.name", "p.type_annotation", "p.default_value")


@holds(
    "name VARCHAR, kind VARCHAR, parent_class VARCHAR, bases VARCHAR[], return_type VARCHAR, parameters VARCHAR[]",
    ("f", "function", None, [], "string", ["a:number", "b", "...c"]), ("g", "function", None, [], None, ["x"]), ("K", "class", None, ["Base", "Face"], None, []), ("m", "method", "K", [], None, ["y"]), ("v", "variable", None, [], None, []),
)
def q82_script_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "export function f(a: number, b = 2, ...c): string { return a; }\nconst g = (x) => x;\nclass K extends Base implements Face { async m(y) { return y; } }\nlet v = 1;\n"
    parts = F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type_annotation"]))
    return parsing.cpg_nodes(files_of(spark, {"a.ts": text})).filter("function_id is null").select("name", "kind", "parent_class", "bases", "return_type", parts.alias("parameters"))


@holds("parent VARCHAR, child VARCHAR", ("Engine", "start"), ("Engine", "warm"), ("start", "expression: self.warm()"), ("start", "assignment: x = helper(n)"), ("start", "return: return x"), ("warm", "return: return None"), ("helper", "return: return n"))
def q83_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, {"core.py": REPO["pkg/core.py"]})
    names, edges = parsing.cpg_nodes(files).select("node_id", "name"), parsing.cpg_edges(files).filter("kind = 'AstChild'")
    parents, children = (names.select(F.col("node_id").alias(c), F.col("name").alias(n)) for c, n in (("src", "parent"), ("dst", "child")))
    return edges.join(parents, "src").join(children, "dst").select("parent", "child")


@holds(
    "fn VARCHAR, src VARCHAR, dst VARCHAR, kind VARCHAR",
    ("if_else", "entry", "if: if a:", "Next"), ("if_else", "if: if a:", "assignment: x = 1", "True"), ("if_else", "if: if a:", "assignment: x = 2", "False"), ("if_else", "assignment: x = 1", "return: return x", "Next"), ("if_else", "assignment: x = 2", "return: return x", "Next"), ("if_else", "return: return x", "exit", "Next"),
    ("if_only", "entry", "if: if a:", "Next"), ("if_only", "if: if a:", "assignment: x = 1", "True"), ("if_only", "if: if a:", "return: return a", "Next"), ("if_only", "assignment: x = 1", "return: return a", "Next"), ("if_only", "return: return a", "exit", "Next"),
    ("elif_", "entry", "if: if a > 1:", "Next"), ("elif_", "if: if a > 1:", "assignment: x = 1", "True"), ("elif_", "if: if a > 1:", "if: elif a:", "False"), ("elif_", "if: elif a:", "assignment: x = 2", "True"), ("elif_", "if: elif a:", "assignment: x = 3", "False"),
    ("elif_", "assignment: x = 1", "assignment: y = x", "Next"), ("elif_", "assignment: x = 2", "assignment: y = x", "Next"), ("elif_", "assignment: x = 3", "assignment: y = x", "Next"), ("elif_", "assignment: y = x", "exit", "Next"),
    ("for_else", "entry", "for: for i in a:", "Next"), ("for_else", "for: for i in a:", "assignment: x = i", "True"), ("for_else", "assignment: x = i", "for: for i in a:", "Back"), ("for_else", "for: for i in a:", "assignment: x = 0", "False"), ("for_else", "assignment: x = 0", "return: return x", "Next"), ("for_else", "return: return x", "exit", "Next"),
    ("while_", "entry", "while: while a:", "Next"), ("while_", "while: while a:", "if: if a == 1:", "True"), ("while_", "if: if a == 1:", "break: break", "True"), ("while_", "if: if a == 1:", "continue: continue", "Next"), ("while_", "continue: continue", "while: while a:", "Back"), ("while_", "break: break", "return: return a", "Next"),
    ("while_", "while: while a:", "return: return a", "False"), ("while_", "return: return a", "exit", "Next"),
    ("try_", "entry", "try: try:", "Next"), ("try_", "try: try:", "assignment: x = 1", "Next"), ("try_", "assignment: x = 1", "assignment: x = 3", "Next"), ("try_", "try: try:", "assignment: x = 2", "Exception"), ("try_", "assignment: x = 3", "assignment: y = x", "Next"), ("try_", "assignment: x = 2", "assignment: y = x", "Next"), ("try_", "assignment: y = x", "exit", "Next"),
    ("with_", "entry", "with: with open(p) as f:", "Next"), ("with_", "with: with open(p) as f:", "assignment: x = f", "Next"), ("with_", "assignment: x = f", "return: return x", "Next"), ("with_", "return: return x", "exit", "Next"),
    ("match_", "entry", "match: match v:", "Next"), ("match_", "match: match v:", "assignment: x = 1", "Next"), ("match_", "match: match v:", "assignment: x = 2", "Next"), ("match_", "assignment: x = 1", "return: return x", "Next"), ("match_", "assignment: x = 2", "return: return x", "Next"), ("match_", "return: return x", "exit", "Next"),
    ("dead", "entry", "return: return 1", "Next"), ("dead", "return: return 1", "exit", "Next"), ("dead", "assignment: x = 2", "exit", "Next"),
    ("raise_", "entry", "raise: raise e", "Next"), ("raise_", "raise: raise e", "exit", "Next"),
    ("twice", "entry", "assignment: x = 1", "Next"), ("twice", "assignment: x = 1", "assignment: x = 2", "Next"), ("twice", "assignment: x = 2", "assignment: y = x", "Next"), ("twice", "assignment: y = x", "exit", "Next"),
    ("loop", "entry", "assignment: s = 0", "Next"), ("loop", "assignment: s = 0", "while: while n:", "Next"), ("loop", "while: while n:", "augmented_assignment: s += n", "True"), ("loop", "augmented_assignment: s += n", "assignment: n = n - 1", "Next"), ("loop", "assignment: n = n - 1", "while: while n:", "Back"), ("loop", "while: while n:", "return: return s", "False"), ("loop", "return: return s", "exit", "Next"),
)
def q84_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of statement; what follows a return has no edge into it, but its own way to the exit."""
    return _flow(spark, "ControlFlow").withColumn("kind", F.regexp_replace("kind", "^ControlFlow", "")).drop("variable")


def _flow(spark: SparkSession, kind: str) -> DataFrame:
    files = files_of(spark, {f"{n}.py": t for n, t in FLOWS.items()})
    names = parsing.cpg_nodes(files).select("node_id", "name")
    edges = parsing.cpg_edges(files).filter(F.col("kind").startswith(kind))
    ends = {c: names.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst")}
    found = edges.join(ends["src"], "src").join(ends["dst"], "dst")
    return found.select(F.regexp_replace("path", r"\.py$", "").alias("fn"), F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind", "variable")


_REACHES = (
    ("if_else", "entry", "if: if a:", "a"), ("if_else", "assignment: x = 1", "return: return x", "x"), ("if_else", "assignment: x = 2", "return: return x", "x"),
    ("if_only", "entry", "if: if a:", "a"), ("if_only", "entry", "return: return a", "a"),
    ("elif_", "entry", "if: if a > 1:", "a"), ("elif_", "entry", "if: elif a:", "a"), ("elif_", "assignment: x = 1", "assignment: y = x", "x"), ("elif_", "assignment: x = 2", "assignment: y = x", "x"), ("elif_", "assignment: x = 3", "assignment: y = x", "x"),
    ("for_else", "entry", "for: for i in a:", "a"), ("for_else", "for: for i in a:", "assignment: x = i", "i"), ("for_else", "assignment: x = 0", "return: return x", "x"),
    ("while_", "entry", "while: while a:", "a"), ("while_", "entry", "if: if a == 1:", "a"), ("while_", "entry", "return: return a", "a"),
    ("try_", "assignment: x = 2", "assignment: y = x", "x"), ("try_", "assignment: x = 3", "assignment: y = x", "x"),
    ("with_", "entry", "with: with open(p) as f:", "p"), ("with_", "with: with open(p) as f:", "assignment: x = f", "f"), ("with_", "assignment: x = f", "return: return x", "x"),
    ("match_", "entry", "match: match v:", "v"), ("match_", "assignment: x = 1", "return: return x", "x"), ("match_", "assignment: x = 2", "return: return x", "x"),
    ("raise_", "entry", "raise: raise e", "e"), ("twice", "assignment: x = 2", "assignment: y = x", "x"),
    ("loop", "entry", "while: while n:", "n"), ("loop", "assignment: n = n - 1", "while: while n:", "n"), ("loop", "entry", "augmented_assignment: s += n", "n"), ("loop", "assignment: n = n - 1", "augmented_assignment: s += n", "n"), ("loop", "entry", "assignment: n = n - 1", "n"), ("loop", "assignment: n = n - 1", "assignment: n = n - 1", "n"),
    ("loop", "assignment: s = 0", "augmented_assignment: s += n", "s"), ("loop", "augmented_assignment: s += n", "augmented_assignment: s += n", "s"), ("loop", "assignment: s = 0", "return: return s", "s"), ("loop", "augmented_assignment: s += n", "return: return s", "s"),
)


@holds("fn VARCHAR, src VARCHAR, dst VARCHAR, variable VARCHAR", *_REACHES)
def q28_gen_kill_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that reach a use, by the parser's own fixpoint."""
    return _flow(spark, "DataFlowReach").drop("kind")


@holds("fn VARCHAR, src VARCHAR, dst VARCHAR, variable VARCHAR", *_REACHES)
def q28b_reach_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins over control flow."""
    files = files_of(spark, {f"{n}.py": t for n, t in FLOWS.items()})
    nodes = parsing.cpg_nodes(files)
    own = nodes.filter("function_id is not null")
    defs, uses = (own.select("node_id", F.explode(c).alias("variable")) for c in ("defs", "uses"))
    found = calls.reaching_by_joins(defs, uses, parsing.cpg_edges(files).filter(F.col("kind").startswith("ControlFlow")))
    ends = [nodes.select(F.col("node_id").alias(f"{c}_id"), F.col("name").alias(n), F.regexp_replace("path", r"\.py$", "").alias("fn")) for c, n in (("def", "src"), ("use", "dst"))]
    return found.join(ends[0], "def_id").join(ends[1].drop("fn"), "use_id").select("fn", "src", "dst", "variable")


@holds(
    "node VARCHAR, killed VARCHAR, variable VARCHAR", ("assignment: x = 1", "assignment: x = 2", "x"), ("assignment: x = 2", "assignment: x = 1", "x"), ("entry", "assignment: n = n - 1", "n"), ("assignment: n = n - 1", "entry", "n"),
    ("assignment: s = 0", "augmented_assignment: s += n", "s"), ("augmented_assignment: s += n", "assignment: s = 0", "s"),
)
def q85_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsing.cpg_nodes(files_of(spark, {f"{n}.py": FLOWS[n] for n in ("twice", "loop")}))
    names = nodes.select("node_id", "name")
    found = calls.kill_pairs(nodes)
    for column, name in (("node_id", "node"), ("killed_id", "killed")):
        found = found.join(names.select(F.col("node_id").alias(column), F.col("name").alias(name)), column)
    return found.select("node", "killed", "variable")


@holds(
    "name VARCHAR, defs VARCHAR[], uses VARCHAR[]",
    ("entry", ["a", "args", "k"], []), ("exit", [], []), ("assignment: x, y = f(a), b.c", ["x", "y"], ["f", "a", "b"]), ("assignment: a.z = x", [], ["x", "a"]), ("augmented_assignment: x += y", ["x"], ["x", "y"]), ("for: for i, j in x:", ["i", "j"], ["x"]),
    ("with: with open(a) as g, h:", ["g"], ["open", "a", "h"]), ("pass: pass", [], []), ("import: import m.n as o, p.q", ["o", "p"], []), ("import: from r import s as t, u", ["t", "u"], []), ("while: while x and not y:", [], ["x", "y"]),
    ("expression: print(lambda q: q, k)", [], ["print", "k"]), ("other:function_definition: def inner(v):", ["inner"], []), ("assignment: w: int = a[x]", ["w"], ["a", "x"]),
)
def q86_defs_and_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "class A:\n    def f(self, a, *args, k=1):\n        x, y = f(a), b.c\n        a.z = x\n        x += y\n        for i, j in x:\n            with open(a) as g, h:\n                pass\n        import m.n as o, p.q\n        from r import s as t, u\n        while x and not y:\n            print(lambda q: q, k)\n        def inner(v):\n            return v\n        w: int = a[x]\n"
    return parsing.cpg_nodes(files_of(spark, {"a.py": text})).filter("function_id is not null").select("name", "defs", "uses")


_SCRIPT = """export function pick(list, n = 0) {
  let best = null
  for (const x of list) {
    if (x.size > n) { best = x; continue; }
    else if (!x) break
    n += 1;
  }
  try { save(best) } catch (e) { log(e); } finally { close(); }
  return best;
}
const twice = (v) => v * 2;
"""


@holds(
    "src VARCHAR, dst VARCHAR, kind VARCHAR",
    ("entry", "assignment: let best = null", "Next"), ("assignment: let best = null", "for: for (const x of list) {", "Next"), ("for: for (const x of list) {", "if: if (x.size > n) { best = x; continue; }", "True"), ("if: if (x.size > n) { best = x; continue; }", "assignment: best = x;", "True"), ("assignment: best = x;", "continue: continue;", "Next"),
    ("continue: continue;", "for: for (const x of list) {", "Back"), ("if: if (x.size > n) { best = x; continue; }", "if: if (!x) break", "False"), ("if: if (!x) break", "break: break", "True"), ("if: if (!x) break", "augmented_assignment: n += 1;", "Next"), ("augmented_assignment: n += 1;", "for: for (const x of list) {", "Back"),
    ("break: break", "try: try { save(best) } catch (e) { log(e); } finally { close(); ", "Next"), ("for: for (const x of list) {", "try: try { save(best) } catch (e) { log(e); } finally { close(); ", "False"), ("try: try { save(best) } catch (e) { log(e); } finally { close(); ", "expression: save(best)", "Next"), ("try: try { save(best) } catch (e) { log(e); } finally { close(); ", "expression: log(e);", "Exception"),
    ("expression: save(best)", "expression: close();", "Next"), ("expression: log(e);", "expression: close();", "Next"), ("expression: close();", "return: return best;", "Next"), ("return: return best;", "exit", "Next"), ("entry", "return: v * 2", "Next"), ("return: v * 2", "exit", "Next"),
)
def q84b_script_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop with both ways out, a branch behind another, a handler with an end of its own, an arrow function; names end after 60 characters."""
    return _script_edges(spark, "ControlFlow").select("src", "dst", F.regexp_replace("kind", "^ControlFlow", "").alias("kind"))


def _script_edges(spark: SparkSession, kind: str) -> DataFrame:
    files = files_of(spark, {"a.ts": _SCRIPT})
    names, edges = parsing.cpg_nodes(files).select("node_id", "name"), parsing.cpg_edges(files).filter(F.col("kind").startswith(kind))
    for c in ("src", "dst"):
        edges = edges.join(names.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")), c)
    return edges.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind", "variable")



@holds(
    "src VARCHAR, dst VARCHAR, variable VARCHAR",
    ("entry", "for: for (const x of list) {", "list"), ("for: for (const x of list) {", "if: if (x.size > n) { best = x; continue; }", "x"), ("entry", "if: if (x.size > n) { best = x; continue; }", "n"), ("augmented_assignment: n += 1;", "if: if (x.size > n) { best = x; continue; }", "n"),
    ("for: for (const x of list) {", "assignment: best = x;", "x"), ("for: for (const x of list) {", "if: if (!x) break", "x"), ("entry", "augmented_assignment: n += 1;", "n"), ("augmented_assignment: n += 1;", "augmented_assignment: n += 1;", "n"),
    ("assignment: let best = null", "expression: save(best)", "best"), ("assignment: best = x;", "expression: save(best)", "best"), ("assignment: let best = null", "return: return best;", "best"), ("assignment: best = x;", "return: return best;", "best"), ("entry", "return: v * 2", "v"),
)
def q84c_script_data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_edges(spark, "DataFlowReach").select("src", "dst", "variable")


@holds("callee VARCHAR, statement VARCHAR", ("save", "expression: save(best)"), ("log", "expression: log(e);"), ("close", "expression: close();"))
def q84d_script_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, {"a.ts": _SCRIPT})
    names = parsing.cpg_nodes(files).select(F.col("node_id").alias("statement_id"), F.col("name").alias("statement"))
    return parsing.call_sites(files).join(names, "statement_id").select(F.col("callee_name").alias("callee"), "statement")


# ---- calls


@holds(
    "callee_name VARCHAR, receiver VARCHAR, positional_args VARCHAR[], keywords VARCHAR[], line INTEGER",
    ("g", None, ["1", "x"], ["k=2"], 2), ("h", "a.b", [], [], 3), ("i", "h()", ["y"], [], 4), ("h", None, [], [], 4), ("j", None, ["k(1)"], [], 5), ("k", None, ["1"], [], 5), ("m", None, [], [], 6), ("n", None, [], [], 7),
)
def q87_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starred arguments are left out; a call within a compound statement is there once."""
    text = "def f(x, y, z):\n    g(1, x, *z, k=2, **z)\n    a.b.h()\n    h().i(y)\n    j(k(1))\n    if m():\n        n()\n"
    keywords = F.transform("keyword_args", lambda k: F.concat_ws("=", k["name"], k["value"]))
    return parsing.call_sites(files_of(spark, {"a.py": text})).select("callee_name", "receiver", "positional_args", keywords.alias("keywords"), "line")


def _named(found: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """caller and callee as path:name, with more columns."""
    name = F.concat_ws(":", "path", "name")
    for c in ("caller", "callee"):
        found = found.join(nodes.select(F.col("node_id").alias(f"{c}_id"), name.alias(c)), f"{c}_id")
    return found.select("caller", "callee", *more)


@holds(
    "caller VARCHAR, callee VARCHAR, rule INTEGER",
    ("pkg/core.py:start", "pkg/core.py:warm", 1), ("pkg/core.py:start", "pkg/core.py:helper", 2), ("app.py:main", "pkg/core.py:helper", 4), ("app.py:main", "pkg/core.py:warm", 5), ("one.py:solo", "one.py:twin", 2), ("two.py:twin", "one.py:solo", 3),
)
def q29_call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule on its own ground: built-ins and two functions of a name elsewhere stay open (len, twin in app.py), as
    does an alias of a function (h) and a method of an instance (e.start)."""
    nodes, _, found = Repository(files_of(spark, REPO), ()).call_graph()
    return _named(found, nodes, "rule")


@holds("caller VARCHAR, callee VARCHAR, rule INTEGER", ("m.py:one", "m.py:go", 1), ("m.py:two", "m.py:go", 2), ("m.py:three", "x.py:only", 6), ("m.py:three", "x.py:single", 7))
def q29b_call_resolution_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """self before the file's own function; a function outside of classes before methods; a class anywhere by its name; the only method of a name."""
    texts = {
        "m.py": "class A:\n    def one(self):\n        self.go()\n        self.single()\n\n    def go(self):\n        return 1\n\n\ndef go():\n    return 2\n\n\ndef two():\n    go()\n\n\ndef three(v):\n    B.only(v)\n    v.single()\n    v.both()\n",
        "x.py": "class B:\n    def only(self):\n        return 1\n\n    def single(self):\n        return 2\n\n    def both(self):\n        return 3\n\n\nclass C:\n    def only(self):\n        return 4\n\n    def both(self):\n        return 5\n",
    }
    nodes, _, found = Repository(files_of(spark, texts), ()).call_graph(instance_fallback=True)
    return _named(found, nodes, "rule")


@holds(
    "src VARCHAR, dst VARCHAR, kind VARCHAR, variable VARCHAR, position INTEGER",
    ("f", "g", "Calls", None, None), ("g", "f", "CalledBy", None, None), ("assignment: x = g(1, c=2)", "entry", "DataFlowArgument", "a", 0), ("assignment: x = g(1, c=2)", "entry", "DataFlowArgument", "c", 2), ("return: return a", "assignment: x = g(1, c=2)", "DataFlowReturn", None, None), ("return: return b", "assignment: x = g(1, c=2)", "DataFlowReturn", None, None),
)
def q88_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "def g(a, b, c, *d):\n    if a:\n        return a\n    return b\n\n\ndef f():\n    x = g(1, c=2)\n"
    nodes, sites, found = Repository(files_of(spark, {"a.py": text}), ()).call_graph()
    edges, names = calls.call_edges(found, sites, nodes), nodes.select("node_id", "name")
    for c in ("src", "dst"):
        edges = edges.join(names.select(F.col("node_id").alias(c), F.col("name").alias(f"{c}_name")), c)
    return edges.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "kind", "variable", "position")


@holds("side VARCHAR, name VARCHAR, path VARCHAR, start_line INTEGER", ("callee", "helper", "pkg/core.py", 23), ("callee", "warm", "pkg/core.py", 19), ("caller", "start", "pkg/core.py", 14), ("caller", "main", "app.py", 7))
def q89_callers_and_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What main calls, and who calls helper; only files near these are parsed."""
    repo = Repository(files_of(spark, REPO), ())
    out, into = repo.callees("app.py", "main"), repo.callers("pkg/core.py", "helper")
    return out.withColumn("side", F.lit("callee")).unionByName(into.withColumn("side", F.lit("caller")))


@holds("caller VARCHAR, callee VARCHAR, rule INTEGER", ("a.py:f", "b.py:h", 3), ("b.py:g", "b.py:h", 2), ("c.py:k", "a.py:f", 3))
def q90_calls_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph after a file changed, one went and one came: the rows are those of a fresh one."""
    repo = Repository(files_of(spark, {"a.py": "def f():\n    return g()\n", "b.py": "def g():\n    return 1\n", "d.py": "def h():\n    return f()\n"}), ())
    repo.calls.count()
    changed = {"a.py": "def f():\n    return h()\n", "b.py": "def g():\n    return h()\n\n\ndef h():\n    return 1\n", "c.py": "def k():\n    return f()\n"}
    repo.update(files_of(spark, changed), spark.createDataFrame([("d.py",)], "path string"))
    return _named(repo.calls, parsing.part_of(repo.graph_rows, "nodes"), "rule")


@holds(
    "start_line INTEGER, line VARCHAR", (5, "  L5-6: class Base"), (9, "  L9-20: class Engine(Base)\n    Runs."), (14, "  L14-17: method start(self, n: int = 1) -> int  [in class Engine]"), (19, "  L19-20: method warm(self)  [in class Engine]"), (23, "  L23-24: function helper(n)"),
)
def q91_file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repository(files_of(spark, REPO), ()).file_symbols("pkg/core.py").select("start_line", "line")


@holds(
    "what VARCHAR, a VARCHAR, b VARCHAR", ("class", "Base", None), ("class", "Engine", None), ("child", "start", None), ("child", "warm", None), ("statement", "return: return n", None), ("flow", "entry", "return: return n"), ("flow", "return: return n", "exit"), ("reach", "entry", "return: return n"),
)
def q92_graph_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a file, children of a class, statements and flow of a function."""
    repo, path = Repository(files_of(spark, REPO), ()), "pkg/core.py"
    engine = repo.classes(path).filter("name = 'Engine'").first().node_id
    parts = {"class": repo.classes(path), "child": repo.children(path, engine), "statement": repo.statements(path, "helper")}
    found = [d.select(F.lit(w).alias("what"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b")) for w, d in parts.items()]
    found += [d.select(F.lit(w).alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")) for w, d in (("flow", repo.control_flow(path, "helper")), ("reach", repo.data_flow(path, "helper")))]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


# ---- texts, contexts, changes, chat


@holds("path VARCHAR, text VARCHAR", ("/r/src/a/b.py", "a.b\nS"), ("/r/src/a/__init__.py", "a\nbody"), ("/elsewhere/c.py", "S"))
def q93_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("/r/src/a/b.py", "S", "body"), ("/r/src/a/__init__.py", "  ", "body"), ("/elsewhere/c.py", "S", "body")], "path string, skeleton string, content string")
    return rows.select("path", search.embedding_text(F.col("path"), F.col("skeleton"), F.col("content"), "/r").alias("text"))


@holds("text VARCHAR, tokens INTEGER, cut VARCHAR", ("abcdefgh", 2, "abcdefgh"), ("abcdefghijkl", 3, "abcdefgh" + packing.CUT_MARK), ("", 0, ""))
def q94_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("abcdefgh",), ("abcdefghijkl",), ("",)], "text string")
    return rows.select("text", packing.estimated_tokens(F.col("text")).alias("tokens"), packing.truncated(F.col("text"), 8).alias("cut"))


@holds("limit_tokens INTEGER, fits BOOLEAN, is_prefix BOOLEAN, whole BOOLEAN", (5, True, True, False), (20, True, True, False), (100, True, True, False), (1000, True, True, True))
def q95_map_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map cut to its share of the budget: within it, a beginning of the map, whole where there is room."""
    text, count = "word " * 200, lambda t: len(t) // 4
    rows = []
    for limit in (5, 20, 100, 1000):
        got = packing.within_tokens(text, limit, count)
        rows.append((limit, count(got) <= limit, text.startswith(got.removesuffix(packing.CUT_MARK)), got == text))
    return spark.createDataFrame(rows, "limit_tokens int, fits boolean, is_prefix boolean, whole boolean")


@holds("n INTEGER, label VARCHAR", (0, "REPOSITORY_MAP"), (1, "EXPLICIT_FILES (skeletons)"), (2, "ANCHOR_FILES (skeletons)"), (3, "EXTENDED_CONTEXT (skeletons)"))
def q96_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a packed context, in their order; each file is in one of them, and the whole within the budget."""
    text = Repository(files_of(spark, REPO), ()).context("engine helper", budget=600, explicit=("two.py",))
    bar = "=" * 80
    parts = [p.split("\n")[0] for p in ("\n" + text).split(f"\n{bar}\n")[1::2]]
    blocks = [x for x in text.split("\n") if x.endswith("(SKELETON)")]
    rows = list(enumerate(parts)) if len(text) // 4 <= 600 and len(blocks) == len(set(blocks)) and "# two.py (SKELETON)" in blocks else []
    return spark.createDataFrame(rows, "n int, label string")


@holds("path VARCHAR, event_type VARCHAR", ("a/b.py", "created"), ("a/c.PY", "modified"), ("d.pyi", "deleted"))
def q97_change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [("a/b.py", "created"), ("a/c.PY", "modified"), ("d.pyi", "deleted"), ("x/node_modules/e.py", "created"), (".h.py", "created"), ("i.py~", "created"), ("j.txt", "created"), ("setup.py", "modified")]
    return changes.relevant(spark.createDataFrame(names, "path string, event_type string"), names=("setup.py",))


@holds("path VARCHAR, event_type VARCHAR, content VARCHAR", ("new.py", "created", "n"), ("same name.py", "modified", "2"), ("gone.py", "deleted", None))
def q98_snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = files_of(spark, {"keep.py": "k", "same name.py": "1", "gone.py": "g"}), files_of(spark, {"keep.py": "k", "same name.py": "2", "new.py": "n"})
    return changes.snapshot_events(before, now, "2024-01-01 00:00:00").select("path", "event_type", "content")


@holds(
    "turn BIGINT, thoughts VARCHAR, calls VARCHAR[], plain_text VARCHAR",
    (1, "look", ["read_file(a.py)"], "before  after"), (2, None, ["write_file(a, b, c)"], ""), (3, "never closed", [], ""), (4, None, ["read_file(x)"], "use read_file('x') now"), (5, None, [], "nothing"), (6, None, [], "a"), (7, None, [], ""),
)
def q99_parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed, open, malformed and missing tags; calls of known tools without a tag; other names aren't calls."""
    texts = ("before <think>look</think> after<action>read_file('a.py')</action>", "<action>write_file('a', \"b, c\")", "<think>never closed", "use read_file('x') now", "nothing", "a<action>broken</action>", None)
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "conv_id long, turn long, text string")
    found = chat.parsed_responses(rows)
    return found.select("turn", "thoughts", F.transform("calls", lambda c: F.concat(c["tool"], F.lit("("), F.array_join(c["args"], ", "), F.lit(")"))).alias("calls"), "plain_text")


@holds("conv_id BIGINT, message VARCHAR", (1, "## Tool Results\n\n### read_file('a') — SUCCESS\n```\nabc\n```\n\n### list_directory('x', 'y') — FAILED\nError: Unknown error\n"))
def q99b_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 2, "list_directory", ["x", "y"], False, None, None), (1, 1, "read_file", ["a"], True, "abc", None)]
    return chat.formatted_results(spark.createDataFrame(rows, "conv_id long, seq int, tool string, args array<string>, success boolean, content string, error string"))
