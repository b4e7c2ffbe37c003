"""Small repositories, from source texts to answers."""

import pytest
from pyspark.sql import functions as F

from codeloom.engine import Repository
from codeloom.operators import calls, graph, imports, parsing
from codeloom.sources import packages, repository

APP = {
    "core.py": 'class User:\n    """A user."""\n\n    def save(self):\n        return store(self)\n\n\ndef store(x):\n    return x\n',
    "models/__init__.py": "from .order import Order\n",
    "models/order.py": "from core import User\n\n\nclass Order:\n    def owner(self):\n        u = User()\n        return u.save()\n",
    "api.py": "import os\nimport numpy as np\nfrom core import User, store\nfrom models import Order\n\n\ndef handle(a, b=1):\n    x = store(a)\n    return store(x)\n",
    "tests/test_api.py": "from api import handle\n\n\ndef test_handle():\n    assert handle(1, b=2) == 1\n",
    "broken.py": "def f(:\n",
    "web/main.ts": 'import { Button } from "@/ui/button";\nimport { helper } from "./util";\nexport function start(n: number) { helper(n); return Button(n); }\n',
    "web/util.js": "export function helper(x) { return x; }\n",
    "src/ui/button/index.tsx": "export const Button = (p) => p;\n",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}} // aliases\n',
    "requirements.txt": "PyYAML>=5  # comment\n-r other.txt\npython-dateutil[x]==2\n",
}


@pytest.fixture(scope="module")
def repo(make_files):
    return Repository(make_files(APP))


def pairs(df):
    return {(r.src, r.dst, r.kind) for r in df.collect()}


def test_edges(repo):
    assert pairs(repo.edges) == {
        ("models/__init__.py", "models/order.py", "Import"), ("models/order.py", "core.py", "Import"), ("api.py", "core.py", "Import"), ("api.py", "models/__init__.py", "Import"),
        ("api.py", "models/order.py", "Import"), ("tests/test_api.py", "api.py", "Import"), ("web/main.ts", "web/util.js", "Import"), ("web/main.ts", "src/ui/button/index.tsx", "Import"),
    }


def test_answers(repo):
    assert repo.top_ranked(1).first().path == "core.py"
    assert {r.path for r in repo.dependents("core.py").collect()} == {"models/order.py", "api.py"}
    assert {r.path for r in repo.dependencies("tests/test_api.py").collect()} == {"api.py"}
    status = repo.status().first()
    assert status.n_nodes == 8 and status.n_import == 8 and status.n_unresolved == 0
    text = repo.repository_map(3)
    assert "core.py" in text and "★" in text and "models/" in text
    assert repo.health().first().status == "degraded"
    assert {r.name for r in repo.callees("tests/test_api.py", "test_handle").collect()} == {"handle"}
    assert {(r.name, r.path) for r in repo.callers("core.py", "store").collect()} == {("save", "core.py"), ("handle", "api.py")}
    assert [r.line for r in repo.file_symbols("api.py").collect()] == ["  L7-9: function handle(a, b = 1)"]
    assert repo.skeleton("core.py") == 'class User:\n    """A user."""\n\n    def save(self):\n        ...\n\ndef store(x):\n    ...\n'
    assert repo.relevant("store user", 3).count() == 3
    context = repo.context("how is a user stored", budget=2000)
    assert "REPOSITORY_MAP" in context and "core.py (SKELETON)" in context


def test_update(make_files, spark):
    repo = Repository(make_files({"a.py": "import b\n", "b.py": "x = 1\n", "c.py": "y = 2\n"}))
    assert pairs(repo.edges) == {("a.py", "b.py", "Import")}
    changed = make_files({"a.py": "import c\n", "b.py": "def broken(:\n"})
    found = {(r.src, r.dst, r.change) for r in repo.update(changed).collect()}
    assert found == {("a.py", "b.py", "removed"), ("a.py", "c.py", "added")}
    again = Repository(make_files({"a.py": "import c\n", "b.py": "x = 1\n", "c.py": "y = 2\n"}))
    assert pairs(again.edges) == pairs(repo.edges)
    repo.update(make_files({}), spark.createDataFrame([("c.py",)], "path string"))
    assert pairs(repo.edges) == set() and not graph.has_file(repo.nodes, "c.py")


def test_calls(make_files):
    files = make_files(
        {
            "m.py": "import util as u\nfrom util import C\n\n\nclass A:\n    def run(self):\n        self.go(1)\n        print(u.top(2, k=3))\n        C.make()\n        return go(4)\n\n    def go(self, n):\n        return n\n\n\ndef go(n):\n    if n:\n        return go(n)\n    return n\n",
            "util.py": "def top(a, k):\n    return a\n\n\nclass C:\n    def make(self):\n        return 1\n",
        }
    )
    repo = Repository(files)
    nodes, sites, found = repo.call_graph()
    names = {r.node_id: (r.path, r.parent_class, r.name) for r in nodes.filter(F.col("kind").isin("function", "method")).collect()}
    got = {(names[r.caller_id][2], r.rule, names[r.callee_id]) for r in found.collect()}
    assert got == {("run", 1, ("m.py", "A", "go")), ("run", 4, ("util.py", None, "top")), ("run", 5, ("util.py", "C", "make")), ("run", 2, ("m.py", None, "go")), ("go", 2, ("m.py", None, "go"))}
    edges = calls.call_edges(found, sites, nodes)
    arguments = {(r.variable, r.position) for r in edges.filter("kind = 'DataFlowArgument'").collect()}
    assert arguments == {("n", 0), ("a", 0), ("k", 1)}
    assert edges.filter("kind = 'DataFlowReturn'").count() > 0
    assert sites.count() == calls.innermost(sites).count()


def test_ambiguous_call_stays_open(make_files):
    files = make_files({"a.py": "def f():\n    return 1\n", "b.py": "def f():\n    return 2\n", "c.py": "def g():\n    return f()\n"})
    assert Repository(files).call_graph()[2].count() == 0


def test_reaching_by_joins_agrees(make_files):
    code = "def f(a):\n    x = 1\n    while a:\n        if x:\n            x = a\n        else:\n            a = x\n        try:\n            y = x\n        except E:\n            y = a\n    return x + y\n"
    files = make_files({"f.py": code})
    nodes, edges = parsing.cpg_nodes(files), parsing.cpg_edges(files)
    own = nodes.filter("function_id is not null")
    defs, uses = (own.select("node_id", F.explode(c).alias("variable")) for c in ("defs", "uses"))
    flow = edges.filter(F.col("kind").startswith("ControlFlow"))
    got = {tuple(r) for r in calls.reaching_by_joins(defs, uses, flow).collect()}
    assert got == {(r.src, r.dst, r.variable) for r in edges.filter("kind = 'DataFlowReach'").collect()} and got
    assert {r.variable for r in calls.kill_pairs(nodes).collect()} == {"x", "a", "y"}


def test_relative_imports(make_files):
    files = make_files(
        {"p/__init__.py": "", "p/a.py": "from . import b, c as d\nfrom .b import x as y\nfrom .. import q\nfrom .nothing import z\nfrom . import *\n", "p/b.py": "x = 1\n", "p/c.py": "", "p/s/__init__.py": "", "p/s/t.py": "from ..b import x\nfrom ... import p\n", "n/m.py": "from .o import k\n", "n/o.py": "k = 1\n", "src/z/__init__.py": "", "src/z/w.py": "import z.v\nfrom z import v\n", "src/z/v.py": ""}
    )
    roots = tuple(packages.source_roots(files))
    assert roots == ("src",)
    index = imports.module_index(files, roots)
    found = imports.resolved(parsing.imports(files), files, index, roots)
    got = {(r.src, r.dst) for r in imports.import_targets(found).collect()}
    assert got == {("p/a.py", "p/b.py"), ("p/a.py", "p/c.py"), ("p/a.py", "p/__init__.py"), ("p/s/t.py", "p/b.py"), ("p/s/t.py", "p/__init__.py"), ("n/m.py", "n/o.py"), ("src/z/w.py", "src/z/v.py"), ("src/z/w.py", "src/z/__init__.py")}
    bound = {(r.local_name, r.resolved_path, r.imported_symbol) for r in imports.bindings(found).filter("path = 'p/a.py'").collect()}
    assert bound == {("b", "p/b.py", None), ("d", "p/c.py", None), ("y", "p/b.py", "x")}


def test_packages(make_files):
    files = make_files(
        {
            "requirements.txt": APP["requirements.txt"], "sub/pyproject.toml": '[project]\ndependencies = ["scikit-learn>1"]\n[tool.poetry.dependencies]\npython = "3"\nattrs = "1"\n', "bad/pyproject.toml": "[[[",
            "package.json": '{"dependencies": {"react": "1", "@scope/x": "2"}}',
        }
    )
    assert {r.package for r in packages.requirements(files).collect()} == {"yaml", "pyyaml", "dateutil", "python_dateutil", "python"}
    assert {r.package for r in packages.pyproject_dependencies(files).collect()} == {"sklearn", "scikit_learn", "scikit", "attrs"}
    node = {r.package for r in packages.node_packages(files).collect()}
    assert {"react", "@scope/x", "@scope", "fs"} <= node
    assert packages.declared_roots('[tool.hatch.build.targets.wheel]\npackages = ["src/a"]') == ["src"]
    assert packages.declared_roots('[tool.setuptools.packages.find]\nwhere = ["lib"]') == ["lib"]
    assert packages.path_aliases([("tsconfig.json", APP["tsconfig.json"])]) == ("", [("@/*", "src/*")])


def test_scan(spark, tmp_path):
    for path, text in {"a.py": "x", ".gitignore": "*.log\n/out/\n!keep.log\n", "b.log": "", "keep.log": "", "out/c.py": "", "sub/out/d.py": "", ".git/config": "", "node_modules/e.js": "", "sub/.gitignore": "d.py\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bin.py").write_bytes(b"\xff\xfe\x00")
    tracked = spark.createDataFrame([("b.log",)], "path string")
    got = {r.path for r in repository.read_repository(spark, str(tmp_path), tracked=tracked).collect()}
    assert got == {"a.py", ".gitignore", "keep.log", "sub/.gitignore", "b.log"}
    assert repository.list_directory(str(tmp_path))[0] == ".git/"
    with pytest.raises(ValueError):
        repository.read_file(str(tmp_path), "../x")
    with pytest.raises(ValueError):
        repository.write_file(str(tmp_path), "n.py", "def (")
    repository.write_file(str(tmp_path), "a.py", "y = 1\n")
    assert repository.read_file(str(tmp_path), "a.py") == "y = 1\n" and len(list(tmp_path.glob("a.py.*.bak"))) == 1
