"""The repository source: every file once however it is dealt out, git's metadata from its files, and what is no repository."""

import os
import subprocess

import pytest

from fernweave.sources import files as scans
from fernweave.sources import repository


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, content in {"a.py": b"x", ".hidden": b"h", "_odd/b.js": b"y", "app/service.py": b"s", "app/deep/er/c.ts": b"z" * 1000, "node_modules/m/d.js": b"n", "empty/.keep": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    os.symlink(root / "a.py", root / "link.py")
    os.symlink(root / "app", root / "loop")
    return root


EVERY = {"a.py", ".hidden", "_odd/b.js", "app/service.py", "app/deep/er/c.ts", "node_modules/m/d.js", "empty/.keep"}


@pytest.mark.parametrize("folders", ["1", "2", "3", "100"])
def test_every_file_once(spark, tree, folders):
    rows = repository.read_repository(spark, str(tree), folders=folders).collect()
    assert sorted(r.relative_path for r in rows) == sorted(EVERY)
    assert all(r.size_bytes == len(r.content) and r.error is None and r.repository_root is None and r.branch is None for r in rows)


def test_pruned_folders_are_not_entered(spark, tree):
    got = {r.relative_path for r in repository.read_repository(spark, str(tree), prune="node_modules,deep").collect()}
    assert got == {"a.py", ".hidden", "_odd/b.js", "app/service.py", "empty/.keep"}


def commit_tree(root, branch="main"):
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", branch)
    git("add", "-A")
    git("commit", "-qm", "first")
    git("remote", "add", "other", "https://example.com/other.git")
    git("remote", "add", "origin", "https://example.com/o/r.git")
    return git


def test_git_metadata_of_a_folder_inside(spark, tree):
    git = commit_tree(tree, "feature/x")
    seen, rows = repository.local_snapshot(spark, str(tree / "app" / "deep"))
    head = git("rev-parse", "HEAD")
    assert seen == {"repository_root": str(tree), "head_commit": head, "branch": "feature/x", "remote_url": "https://example.com/o/r.git"}
    got = rows.collect()
    assert {r.relative_path for r in got} == EVERY and {(r.head_commit, r.branch, r.remote_url, r.repository_root) for r in got} == {(head, "feature/x", "https://example.com/o/r.git", str(tree))}
    part = repository.read_repository(spark, str(tree / "app"), whole="false").collect()
    assert {r.relative_path for r in part} == {"service.py", "deep/er/c.ts"} and part[0].branch == "feature/x"
    git("pack-refs", "--all")
    assert repository.git_metadata(str(tree))["head_commit"] == head
    git("checkout", "-q", "--detach")
    assert repository.git_metadata(str(tree)) == {"head_commit": head, "branch": None, "remote_url": "https://example.com/o/r.git"}


def test_worktree_and_branch_without_commit(tree, tmp_path):
    git = commit_tree(tree)
    git("worktree", "add", "-q", "-b", "side", str(tmp_path / "side"))
    assert repository.git_metadata(str(tmp_path / "side")) == {"head_commit": git("rev-parse", "HEAD"), "branch": "side", "remote_url": "https://example.com/o/r.git"}
    subprocess.run(["git", "init", "-q", "-b", "new", str(tmp_path / "new")], check=True)
    assert repository.git_metadata(str(tmp_path / "new")) == {"head_commit": None, "branch": "new", "remote_url": None}


def test_what_is_no_folder_raises(spark, tree, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        repository.read_repository(spark, str(tmp_path / "nothing")).collect()
    with pytest.raises(Exception, match="NotADirectoryError"):
        repository.read_repository(spark, str(tree / "a.py")).collect()
    with pytest.raises(ValueError, match="no repository"):
        repository.local_snapshot(spark, str(tree))


def test_scan_of_a_repository(spark, tree):
    commit_tree(tree)
    _, rows = repository.local_snapshot(spark, str(tree))
    got = {r.relative_path: r.status for r in scans.scan(rows.select("relative_path", "size_bytes", "content"), scans.ScanOptions(max_bytes=999)).where("pruned is null").collect()}
    assert got == {"a.py": "included", ".hidden": "unsupported", "_odd/b.js": "included", "app/service.py": "included", "app/deep/er/c.ts": "oversized", "empty/.keep": "unsupported"}
