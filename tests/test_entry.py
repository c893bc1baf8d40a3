"""The driver's contract, and what holds when a dependency or the shared folder is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(code: str) -> list[str]:
    out = subprocess.run([sys.executable, "-c", code + "\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint('NAMES', *e.queries())"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]
    return out.stdout.split("NAMES")[1].split()


def test_a_missing_dependency_costs_only_its_queries():
    whole = names("")
    for module in ("ahocorasick", "sentencepiece", "xxhash", "tessera.llm"):
        left = names(f"import sys; sys.modules['{module}'] = None")
        assert "k01_lexical_top100" in left and not [x for x in left if x.startswith("op")] and "pipeline" not in left
        assert {x for x in whole if not x.startswith("op") and x != "pipeline"} == set(left)
    assert "pipeline" not in names("import sys; sys.modules['corpus_pipeline'] = None")


class FakeSession:
    """A session's settings alone."""

    def __init__(self, **conf):
        self.held = {"spark." + k.replace("_", "."): v for k, v in conf.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.held.get(key, default)

    def set(self, key, value):
        self.held[key] = value


def test_a_cluster_needs_a_shared_folder():
    from tessera.storage import shared_folder

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(FakeSession(master="spark://host:7077"))
    assert shared_folder(FakeSession(master="spark://host:7077", checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    local = FakeSession(master="local[4]")
    assert shared_folder(local) == local.get("spark.tessera.folder") == shared_folder(local)
