"""Changed files and former versions of files, from git on the driver. What git cannot tell is left out."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

NO_COMMIT = "0" * 40


def _git(root: str, *args: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def blob(root: str, ref: str, path: str) -> bytes | None:
    """The content of a file at a commit, or None."""
    return _git(root, "show", f"{ref}:" + path.replace("\\", "/"))


def changed_files(root: str, base: str | None = None, head: str | None = None, staged: bool = False) -> list[str]:
    """Paths that differ: between two commits, between base and the working folder, or staged."""
    args = ["--cached"] if staged else [x for x in (base, head) if x]
    found = _git(root, "diff", "--name-only", *args)
    return [line for line in (found or b"").decode("utf-8", "replace").split("\n") if line]


def first_changes(root: str) -> tuple[list[str], str]:
    """(paths, base) of the first that has any: staged files, those of the working folder, the last commit."""
    for paths, base in ((changed_files(root, staged=True), "HEAD"), (changed_files(root), "HEAD")):
        if paths:
            return paths, base
    return changed_files(root, "HEAD~1"), "HEAD~1"


def diff_base(env: Mapping[str, str], changed: bool, platform: str | None = None) -> str:
    """What a build server compares with. changed: whether the working folder or the index has changes."""
    platform = platform or ("github" if "GITHUB_ACTIONS" in env else "gitlab" if "GITLAB_CI" in env else "local")
    if platform == "github":
        return f"origin/{env['GITHUB_BASE_REF']}" if env.get("GITHUB_BASE_REF") else "HEAD~1"
    if platform == "gitlab":
        known = (env.get(name) for name in ("CI_MERGE_REQUEST_DIFF_BASE_SHA", "CI_COMMIT_BEFORE_SHA"))
        return next((x for x in known if x and x != NO_COMMIT), "HEAD~1")
    return "HEAD" if changed else "HEAD~1"


def versions(spark: SparkSession, root: str, paths: list[str], base: str | None) -> DataFrame:
    """(path, version, content) of changed files: old at ``base``, new in the working folder; what is missing has no row."""
    rows = []
    for path in paths:
        old = blob(root, base, path) if base else None
        where = os.path.join(root, path)
        if old is not None:
            rows.append((path, "old", bytearray(old)))
        if os.path.isfile(where):
            with open(where, "rb") as file:
                rows.append((path, "new", bytearray(file.read())))
    return spark.createDataFrame(rows, "path string, version string, content binary")
