"""Files as rows: discovery by extension, content hashes, change detection, a content-addressed store."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def with_extension(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files (path, ...) with one of the extensions; hidden files and those in hidden folders are out."""
    return files.where(F.substring_index("path", ".", -1).isin(*extensions) & ~F.col("path").rlike(r"(^|/)\.[^/]"))


def ignore_pattern(lines: list[str], folder: str = "") -> list[tuple[str, bool]]:
    """Rules of an ignore file in ``folder`` as (regular expression of paths, whether they are taken back), in order."""
    rules = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        back = line.startswith("!")
        line = line[back:].lstrip("\\")
        if not line or line.startswith("#"):
            continue
        fixed, only_folder = "/" in line.rstrip("/"), line.endswith("/")
        parts = re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^\]]*\])", line.strip("/"))
        known = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(known.get(p) or (p.replace("[!", "[^") if p.startswith("[") else re.escape(p)) for p in parts)
        base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        rules.append((f"^{base}{'' if fixed else '(?:.*/)?'}{body}{'/.*' if only_folder else '(?:/.*)?'}$", back))
    return rules


def listed(root: str, extensions: tuple[str, ...]) -> list[str]:
    """Paths below root, from root on, of files with one of the extensions. Hidden files and folders are out, and so is
    what the .gitignore files on the way name: of their rules that fit, the last one counts."""
    system, top = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    found, todo = [], [("", [])]
    while todo:
        folder, rules = todo.pop()
        here = system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/")))
        for info in here:
            if info.base_name == ".gitignore":
                with system.open_input_stream(info.path) as file:
                    rules = rules + ignore_pattern(file.read().decode("utf-8", "replace").split("\n"), folder)
        for info in here:
            path = f"{folder}{info.base_name}"
            folder_like = info.type == fs.FileType.Directory
            ignored = False
            for pattern, back in rules:
                if re.match(pattern, path + "/." if folder_like else path):
                    ignored = not back
            if info.base_name.startswith(".") or (ignored and not (folder_like and any(back for _, back in rules))):
                continue
            if folder_like:
                todo.append((path + "/", rules))
            elif not ignored and info.extension in extensions:
                found.append(path)
    return sorted(found)


def discover(spark, root: str, extensions: tuple[str, ...], files_a_task: int = 200) -> DataFrame:
    """(path, content) of the files that listed() names; contents are read by the executors. Spark's own reader of files
    would leave out names that begin with an underscore."""
    paths = listed(root, extensions)
    base = root if "://" in root else f"file://{os.path.abspath(root)}"

    def read(batches):
        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{top}/{path}") as file:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], names=["path", "content"])

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // files_a_task))
    return table.mapInArrow(read, "path string, content binary")


def hashed(files: DataFrame) -> DataFrame:
    """(path, hash): SHA-256 of the contents, in lower-case hex."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): Added, Modified or Deleted between two manifests (path, hash)."""
    both = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full")
    change = F.when(F.col("old_hash").isNull(), "Added").when(F.col("new_hash").isNull(), "Deleted").when(F.col("old_hash") != F.col("new_hash"), "Modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def commit_changes(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest after the changes: unchanged rows of old, changed ones of new."""
    kept = old.join(changes, "path", "left_anti")
    return kept.unionByName(new.join(changes.where("change <> 'Deleted'"), "path", "left_semi"))


def object_store(files: DataFrame) -> DataFrame:
    """(hash, path, copies): one object for each content, where it is kept and how many files have it."""
    return hashed(files).groupBy("hash").agg(F.count("*").alias("copies")).select("hash", F.concat(F.lit("objects/"), F.substring("hash", 1, 2), F.lit("/"), F.substring("hash", 3, 62)).alias("path"), "copies")


def put_objects(files: DataFrame, folder: str) -> DataFrame:
    """Writes the contents that the store in ``folder`` does not have, one row for each, parted by the first two digits
    of their hash; returns (hash) of those that were new."""
    own = files.select(F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.col("content").cast("binary").alias("content")).dropDuplicates(["hash"])
    new = cut(own.join(stored(files.sparkSession, folder).select("hash"), "hash", "left_anti"))
    new.withColumn("part", F.substring("hash", 1, 2)).repartition("part").write.mode("append").partitionBy("part").parquet(folder)
    return new.select("hash")


def stored(spark, folder: str) -> DataFrame:
    """(hash, content): all objects of a store; none if there is no store yet."""
    try:
        return spark.read.schema("hash string, content binary, part string").parquet(folder).select("hash", "content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "hash string, content binary")


def get_objects(spark, folder: str, hashes: DataFrame) -> DataFrame:
    """(hash, content) of the asked hashes (hash) that the store has."""
    own = hashes.select("hash").distinct()
    return stored(spark, folder).join(own, "hash", "left_semi")


def imports(files: DataFrame) -> DataFrame:
    """(path, module): the distinct modules that the lines of each file import. files: (path, language, text)."""
    lines = files.select("path", "language", F.explode(F.split("text", "\n")).alias("x")).withColumn("x", F.regexp_replace("x", r"^\s+|\s+\z", ""))
    get = lambda pattern: F.regexp_extract("x", pattern, 1)
    begins = lambda word: F.startswith("x", F.lit(word))
    source = F.when(begins("import "), F.regexp_replace(get(r"^.*?from (.*)\z"), "^[\\s\"';]+|[\\s\"';]+\\z", ""))
    required = F.coalesce(F.nullif(get("require\\(\"([^\"']*)[\"']"), F.lit("")), get("require\\('([^\"']*)[\"']"))
    listed = F.transform(F.split(F.substring("x", 8, 1 << 30), ","), lambda m: F.trim(F.substring_index(m, " as ", 1)))
    used = F.trim(F.regexp_replace(get(r"^use (.*)\z"), r";+\z", ""))
    inside = ~F.trim(F.substring_index(used, "::", 1)).isin("self", "super", "")
    script = F.col("language").isin("typescript", "javascript")
    python = F.col("language") == "python"
    found = F.when(script, F.array(source, required)).when(python & begins("from "), F.array(get("^from ([^ ]*)"))).when(python & begins("import "), listed).when((F.col("language") == "rust") & inside, F.array(used))
    return lines.select("path", F.explode(found).alias("module")).where("module <> ''").distinct()


def dependencies(packages: DataFrame) -> DataFrame:
    """(path, name): the distinct names under dependencies and devDependencies of package files (path, json)."""
    both = packages.select("path", F.from_json("json", "dependencies map<string, string>, devDependencies map<string, string>").alias("j"))
    keys = lambda name: F.coalesce(F.map_keys(f"j.{name}"), F.array().cast("array<string>"))
    return both.select("path", F.explode(F.array_union(keys("dependencies"), keys("devDependencies"))).alias("name"))
