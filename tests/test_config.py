"""Layers of settings, and replies."""

import json

from terravane.plans import config


def test_later_layers_win_and_are_named(tmp_path):
    (tmp_path / "u.toml").write_text("[retrieval]\nlexical = 10\nfanout = 3\n")
    (tmp_path / "w.toml").write_text("[retrieval]\nlexical = 20\n")
    got, origins = config.load(str(tmp_path / "u.toml"), str(tmp_path / "w.toml"), {"TERRAVANE_RETRIEVAL__FANOUT": "7", "OTHER__X": "1"}, {"index": {"exclude": ["*.log"]}})
    assert got["retrieval"]["lexical"] == 20 and got["retrieval"]["fanout"] == 7 and got["retrieval"]["semantic"] == 40
    assert origins == {"retrieval.lexical": "workspace", "retrieval.fanout": "environment", "index.exclude": "call"}
    assert config.DEFAULTS["retrieval"]["lexical"] == 40


def test_envelope():
    assert json.loads(config.envelope("search", error="no"))["ok"] is False


def test_decisions_are_typed_and_kept():
    from terravane.plans import decisions as D

    asked, now = [], [0.0]

    def provider(state, questions):
        asked.append(sorted(questions))
        return {"a": "x", "b": 3, "c": True}

    d = D.Decisions(provider, lambda: now[0])
    q = {"a": D.choice("?", ["x", "y"]), "b": D.score("?"), "c": D.predicate("?")}
    assert d.ask("s", q) == {"a": "x", "b": None, "c": True}
    assert d.ask("s", q) == {"a": "x", "b": None, "c": True} and len(asked) == 1
    now[0] = 20.0
    d.ask("s", q)
    assert asked[1:] == [["b"]]
    now[0] = 400.0
    d.ask("s", q)
    assert asked[2:] == [["a", "b", "c"]]
    assert D.Decisions(lambda s, q: {"route": "lexical"}).route("?", ["exact", "lexical", "semantic", "graph"]) == ["exact", "lexical"]
    assert D.Decisions(lambda s, q: 1 / 0).rejected(["p"]) == set()


def test_registered_functions(spark):
    from terravane.plans import extensions

    assert extensions.register(spark, lambda texts: [[len(t), 1] for t in texts]) == ["tv_symbols", "tv_embed"]
    got = spark.sql("select tv_embed(x) as v from values ('abc'), ('a'), (null) t(x)").collect()
    assert [r["v"] for r in got] == [[3.0, 1.0], [1.0, 1.0], [0.0, 1.0]]
    assert [r["name"] for r in spark.sql("select * from tv_symbols('a.py', 'python', 'def f():\n    pass\n')").collect()] == ["f"]


def test_git_and_roots(spark, tmp_path):
    import subprocess

    from terravane.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    assert files.git_state(str(tmp_path)) == (None, None) and files.dirty_paths(spark, str(tmp_path)).count() == 0
    git = lambda *x: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *x], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "x.py").write_text("1")
    git("add", "x.py")
    git("commit", "-qm", "m")
    (tmp_path / "x.py").write_text("2")
    (tmp_path / "y z.py").write_text("3")
    assert files.detect_root(str(tmp_path / "a" / "b")) == str(tmp_path.resolve()) and files.git_state(str(tmp_path))[0] == "main"
    assert sorted(r["path"] for r in files.dirty_paths(spark, str(tmp_path)).collect()) == ["x.py", "y z.py"]
