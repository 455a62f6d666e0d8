"""Imports by alias, relative level, star and re-export lead to what they name."""

from terravane.operators import extraction
from terravane.plans.service import Repository
from terravane.sources.files import scan

TREE = {
    "pkg/__init__.py": "from .api import run as go\n",
    "pkg/api.py": "from .core.util import *\nimport pkg.core.util as tools\n\ndef other():\n    return tools.helper()\n",
    "pkg/core/__init__.py": "",
    "pkg/core/util.py": "def run():\n    return 1\n\ndef helper():\n    return 2\n\nclass Base:\n    pass\n",
    "pkg/sub/deep.py": "from .. import go as f, core\nfrom ..core import util\nfrom ..core.util import Base as B\n\nclass Mine(B):\n    def use(self):\n        return f() + util.helper()\n",
    "elsewhere/util.py": "def run():\n    return 3\n\ndef helper():\n    return 4\n\nclass Base:\n    pass\n",
    "web/index.ts": "export { load as fetchAll } from './impl';\n",
    "web/impl.ts": "export function load() {\n  return 1;\n}\n",
    "web/use.ts": "import { fetchAll as all } from './index';\nfunction page() {\n  return all();\n}\n",
    "half.py": "def begun():\n    return (\n\nclass Later:\n",
    "x.rb": "class Ruby\n  def go\n  end\nend\n",
}


def test_names_are_followed_to_their_definitions(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    repo = Repository(spark, str(tmp_path / "store"))
    repo.update(str(root))
    e = {r["id"]: (r["path"], r["qualified_name"]) for r in repo.table("entities").collect()}
    edges = {(e[r["source_id"]], r["type"], e[r["target_id"]]) for r in repo.table("edges").where("provenance = 'resolved'").collect()}
    use, util = ("pkg/sub/deep.py", "Mine.use"), "pkg/core/util.py"
    assert (use, "calls", (util, "run")) in edges  # two re-exports, one of them a star
    assert (use, "calls", (util, "helper")) in edges  # a module bound by name
    assert (("pkg/sub/deep.py", "Mine"), "inherits", (util, "Base")) in edges
    assert (("pkg/api.py", "other"), "calls", (util, "helper")) in edges  # import as
    assert (("pkg/sub/deep.py", "pkg/sub/deep.py"), "imports", ("pkg/core/__init__.py", "pkg/core/__init__.py")) in edges
    assert (("web/use.ts", "page"), "calls", ("web/impl.ts", "load")) in edges
    assert not any(t[0] == "elsewhere/util.py" for _, kind, t in edges if kind != "imports")
    assert [r["path"] for r in repo.table("failed").collect()] == ["half.py"]
    assert {("half.py", "begun"), ("half.py", "Later"), ("x.rb", "Ruby")} <= set(e.values())


def test_python_annotations_aliases_and_levels():
    text = 'from ...a.b import c as d\nimport numpy as np\nimport os.path\n\nclass K(Base[int]):\n    def f(self, x: "Foo", y: list[Bar], *a: Baz, **k: "m.Qux | None") -> Optional[Out]: ...\n'
    symbols, refs = extraction._python("x.py", text)
    found = {(r[2], r[3], r[4], r[6]) for r in refs}
    assert {("imports", "c", "...a.b", "d"), ("imports", "numpy", None, "np"), ("imports", "os.path", None, "os.path"), ("imports", "os", None, "os")} <= found
    assert ("inherits", "Base", None, None) in found
    assert {n for kind, n, _, _ in found if kind == "accepts_type"} == {"Foo", "list", "Bar", "Baz", "Qux"}
    assert {n for kind, n, _, _ in found if kind == "returns_type"} == {"Optional", "Out"}
    assert extraction._python("x.py", "def f(:") is None


def test_files_that_begin_with_an_underscore_are_scanned(spark, tmp_path):
    for name in ("a.py", "__init__.py", "_own/b.py", "pkg/_c.py", ".gitignore", "pkg/.ignore", "pkg/gone.py", "_own/gone.py", "node_modules/_d.py", ".hid/_e.py"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("gone.py\n" if "ignore" in name else f"x = '{name}'\n")
    got = {r["path"]: r["content"].decode() for r in scan(spark, str(tmp_path)).collect()}
    assert got == {n: f"x = '{n}'\n" for n in ("a.py", "__init__.py", "_own/b.py", "pkg/_c.py")}
