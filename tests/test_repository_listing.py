"""Repository files are listed and read by tasks, not by the driver."""

from pyspark.sql import functions as F

from tessera.sources import code
from tessera.sources.code import listed_files, repository_files


def _tree(root):
    texts = {"a.py": "x", "src/__init__.py": "y", "src/deep/er/b.ts": "zz", "_own/c.md": "", "node_modules/x/d.js": "no", "src/build/e.ts": "no", ".git/f": "no", "src/.g/h.py": "no", "i.min.js": "no", "src/[j] {k}%20.py": "ok"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "empty" / "folder").mkdir(parents=True)
    return {name: text for name, text in texts.items() if text != "no"}


def test_files_are_listed_by_tasks(spark, tmp_path):
    want = _tree(tmp_path)
    files = repository_files(spark, f"file://{tmp_path}")
    assert {(r.path, r.content, r["size"]) for r in files.collect()} == {(p, t, len(t)) for p, t in want.items()} and files.count() == len(want)
    assert "binaryFile" not in files._jdf.queryExecution().toString() and files.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_folders_that_are_never_indexed_are_not_listed(spark, tmp_path):
    _tree(tmp_path)
    system, root = code._open_folder(spark, str(tmp_path))
    listed = {r.path for r in listed_files(spark, system, root).collect()}
    assert "src/__init__.py" in listed and not any(p.startswith(("node_modules/", ".git/", "src/build/", "src/.g/")) for p in listed)


def test_globs_and_large_files(spark, tmp_path):
    _tree(tmp_path)
    for i in range(3):
        (tmp_path / f"large{i}.txt").write_bytes(b"a" * 9_000_000 + b"\n")
    names = lambda glob: {r.path for r in repository_files(spark, str(tmp_path), glob).select("path").collect()}
    assert names("*.{py,md}") == {"a.py", "src/__init__.py", "_own/c.md", "src/[j] {k}%20.py"} and names("?.py") == {"a.py"} and names("none") == set()
    found = repository_files(spark, str(tmp_path), "large*").coalesce(1).select("path", F.length("content").alias("n"), "size", "readable").collect()
    assert sorted(map(tuple, found)) == [(f"large{i}.txt", 9_000_001, 9_000_001, True) for i in range(3)]


def test_systems_that_arrow_does_not_know(spark, tmp_path, monkeypatch):
    want = {p for p in _tree(tmp_path) if "_" not in p}
    monkeypatch.setattr(code, "_open_folder", lambda spark, folder: (None, folder))
    assert {r.path for r in repository_files(spark, str(tmp_path)).collect()} == want
