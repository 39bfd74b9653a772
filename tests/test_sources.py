import hashlib
import json

from repolith.sources import coverage, repository, sinks


def test_walk_and_files(spark, tmp_path):
    put = {
        "src/app.ts": "export {}", "src/app.test.ts": "", "dist/x.js": "", "README.md": "", "Dockerfile": "", ".github/ci.yml": "",
        "node_modules/p/i.js": "", "skip.log": "", "keep.log": "", ".gitignore": "*.log\n!keep.log\n", "logo.png": "", "a/__init__.py": "",
        "tsconfig.json": "{}", "vendor/v.js": "", "test_a.py": "", "LICENSE": "", "requirements.txt": "",
    }
    for p, t in put.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "nul.ts").write_bytes(b"a\x00b")
    paths = repository.walk(str(tmp_path))
    assert paths == sorted(paths) and "skip.log" not in paths and "keep.log" in paths and not any("node_modules" in p for p in paths)
    rows = {r["path"]: r for r in repository.files(repository.read_files(spark, str(tmp_path), paths)).collect()}
    role = {p: r["classification"] for p, r in rows.items()}
    assert role["src/app.ts"] == "source" and role["src/app.test.ts"] == "test" and role["dist/x.js"] == "generated"
    assert role["README.md"] == "documentation" and role["Dockerfile"] == "infrastructure" and role[".github/ci.yml"] == "infrastructure"
    assert role["logo.png"] == "asset" and role["tsconfig.json"] == "config" and role["vendor/v.js"] == "vendored" and role["test_a.py"] == "test"
    assert role["LICENSE"] == "documentation" and role["requirements.txt"] == "config" and role["keep.log"] == "unknown"
    assert rows["nul.ts"]["encoding"] == "binary" and rows["src/app.ts"]["content_hash"] == hashlib.sha256(b"export {}").hexdigest()
    wanted, said = repository.parseable(repository.files(repository.read_files(spark, str(tmp_path), paths)))
    assert said.count() == 0 and {r["path"] for r in wanted.collect()}.isdisjoint({"logo.png", "nul.ts", "dist/x.js"})


def test_paths_outside_are_left_out(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "in.ts").write_text("a")
    (tmp_path / "out.ts").write_text("b")
    (root / "link.ts").symlink_to(tmp_path / "out.ts")
    assert repository.inside(str(root), "in.ts") and not repository.inside(str(root), "/etc/passwd")
    rows = repository.read_files(spark, str(root), ["in.ts", "../out.ts", "link.ts"]).collect()
    assert [(r["path"], bytes(r["content"])) for r in rows] == [("in.ts", b"a")]


def test_delta(spark):
    shape = "path string, content_hash string"
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", None)], shape)
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None), ("e", None)], shape)
    got = {r["path"]: r["status"] for r in repository.delta(now, before).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added", "e": "unchanged"}
    assert repository.delta(now.limit(0), before.limit(0)).count() == 0


def test_snippets(spark):
    texts = spark.createDataFrame([("a", "0\r\n1\n2\n3\n4\n5"), ("big", "x" * (sinks.SNIPPET_BYTES + 1)), ("none", None)], "path string, text string")
    places = [("a", 0), ("a", 3), ("a", 3), ("a", 5), ("a", 9), ("a", None), ("a", -1), ("big", 0), ("none", 0), ("gone", 0)]
    got = sinks.snippets(spark.createDataFrame(places, "path string, line int"), texts).orderBy("line").collect()
    assert [(r["path"], r["line"], r["start_line"], r["highlight"], r["lines"]) for r in got] == [
        ("a", 0, 1, 1, ["0", "1", "2"]), ("a", 3, 2, 4, ["1", "2", "3", "4", "5"]), ("a", 5, 4, 6, ["3", "4", "5"]), ("a", 9, 8, 10, []),
    ]


def test_packages(spark):
    assert repository.package_manager({"yarn.lock", "package-lock.json"}) == "yarn"
    assert [repository.package_manager({p}) for p in ("package.json", "pyproject.toml", "requirements.txt", "x")] == ["npm", "poetry", "pip", "unknown"]
    assert repository.pnpm_globs("packages:\n  # all\n\n  - 'packages/*'\n  - apps/web\nother: 1\n  - no") == ["packages/*", "apps/web"]
    assert repository.package_json("{") is None
    texts = [(json.dumps({"dependencies": {"react": "1", "next": "2"}}),), (json.dumps({"devDependencies": {"vue": "3"}}),)]
    got = repository.frameworks(spark.createDataFrame(texts, "text string")).collect()
    assert [r["framework"] for r in got] == ["node", "nextjs", "react", "vue"]


def test_coverage(spark):
    files = spark.createDataFrame([(p, p) for p in ("src/covered.ts", "src/uncovered.ts", "src/no-report.ts")], "id string, path string")
    lcov = "TN:\nSF:src/covered.ts\nDA:1,3\nDA:2,1\nBRDA:1,0,0,1\nend_of_record\nSF:/abs/src/uncovered.ts\nDA:1,0\nend_of_record\nSF:src/does-not-exist.ts\nDA:1,1\nend_of_record\n"
    place = lambda n: {"start": {"line": n}}
    one = lambda p, s: {"path": p, "statementMap": {"0": place(1)}, "s": {"0": s}, "branchMap": {"0": {"loc": place(1)}}, "b": {"0": [s]}}
    istanbul = json.dumps({p: one(p, s) for p, s in (("src/covered.ts", 2), ("./src/uncovered.ts", 0), ("src/does-not-exist.ts", 1))})
    py = json.dumps({"files": {"src/covered.ts": {"executed_lines": [1, 2], "missing_lines": []}, "src/uncovered.ts": {"executed_lines": [], "missing_lines": [1]}, "src/does-not-exist.ts": {"executed_lines": [1], "missing_lines": []}}})
    for path, text in (("c.info", lcov), ("c.json", istanbul), ("p.json", py)):
        kind = coverage.report_format(path, text)
        lines, branches = coverage.READERS[kind](spark.createDataFrame([(text,)], "text string"))
        mapped, said = coverage.map_files(lines, files)
        by = {}
        for r in mapped.collect():
            by.setdefault(r["file_id"], []).append(r["hits"])
        assert all(by["src/covered.ts"]) and by["src/uncovered.ts"] == [0] and "src/no-report.ts" not in by, kind
        assert [r["code"] for r in said.collect()] == ["COVERAGE_UNMAPPED_FILE"]
        if kind == "lcov":
            assert [tuple(r) for r in branches.collect()] == [("src/covered.ts", 1, "0:0", True)]


def test_texts_and_workspaces(spark):
    files = spark.createDataFrame([("a", b"plain"), ("b", b"x\x00y"), ("e", b"\x10\x0a\x00x"), ("f", b"\x10\x00"), ("g", b"\x10\x01"), ("c", None), ("d", b"z" * (repository.MAX_TEXT + 1))], "path string, content binary")
    assert {r["path"]: (r["text"], r["skipped"]) for r in repository.texts(files).collect()} == {"a": ("plain", None), "b": (None, "binary"), "e": (None, "binary"), "f": (None, "binary"), "g": ("\x10\x01", None), "c": (None, "unreadable"), "d": (None, "too-large")}
    paths = ["package.json", "packages/a/package.json", "packages/a/b/package.json", "apps/x/y/package.json", "other/package.json", "packages.x/a/package.json"]
    manifests = spark.createDataFrame([(p, json.dumps({"name": p})) for p in paths], "path string, text string")
    globs = spark.createDataFrame([("packages/*",), ("apps/**",)], "glob string")
    assert sorted(r["name"] for r in repository.workspace_packages(manifests, globs).collect()) == ["apps/x/y/package.json", "packages/a/package.json"]


def test_packages_of_repositories(spark):
    """Precedence of globs, what they name, and the packages of roots without any."""
    js = lambda **kw: json.dumps(kw)
    files = {
        "x/pnpm": {"pnpm-workspace.yaml": "packages:\n  # all\n\n  - 'packages/*' # here\n  - ./apps/web/\n  - '!packages/b'\nother:\n  - no", "package.json": js(name="top", workspaces=["no"]), "pnpm-lock.yaml": "",
                   "packages/a/package.json": js(name="@x/a"), "packages/b/package.json": "{}", "packages/c/package.json": "{bad", "packages/a/deep/package.json": js(name="deep"), "apps/web/package.json": js(name="web"), "no/package.json": "{}"},
        "x/npm": {"package.json": js(name="top", workspaces={"packages": ["./*", ".", "a"]}), "yarn.lock": "", "a/package.json": js(name="a"), "b/c/package.json": js(name="c")},
        "x/empty": {"package.json": js(workspaces=[]), "a/package.json": js(name="a")},
        "x/bare": {"pnpm-workspace.yaml": "other: 1", "package.json": js(name="top")},
        "x/single/": {"package.json": js(version="1"), "a/package.json": js(name="a")},
        "x/poetry": {"pyproject.toml": "", "requirements.txt": ""},
        "x/pip": {"requirements.txt": "", "package.json": "[]"},
        "x/none": {"README.md": "", "a/package.json": js(name="a")},
    }
    frame = spark.createDataFrame([(r, p, t) for r, own in files.items() for p, t in own.items()], "root string, path string, text string")
    got = sorted((r["root"][2:].rstrip("/"), r["path"], r["name"], r["manifest"], r["manager"]) for r in repository.packages(frame).collect())
    assert got == [
        ("npm", ".", "top", "package.json", "yarn"), ("npm", "a", "a", "a/package.json", "yarn"), ("npm", "a", "a", "a/package.json", "yarn"),
        ("pip", ".", "pip", "requirements.txt", "pip"),
        ("pnpm", "apps/web", "web", "apps/web/package.json", "pnpm"), ("pnpm", "packages/a", "@x/a", "packages/a/package.json", "pnpm"), ("pnpm", "packages/b", "packages/b", "packages/b/package.json", "pnpm"),
        ("poetry", ".", "poetry", "pyproject.toml", "poetry"), ("single", ".", "single", "package.json", "npm"),
    ]
    assert repository.packages(frame.where("false")).count() == 0
