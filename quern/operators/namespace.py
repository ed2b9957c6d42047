"""Operators over a hierarchical namespace: one row for each entry (path, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import codecs

#: Entries of a listing page unless asked otherwise.
PAGE = 100


def with_parents(entries: DataFrame) -> DataFrame:
    """Entries and every directory above them: (path, is_directory); a file's path wins over none."""
    up = entries.select(F.explode(codecs.ancestors(F.col("path"))).alias("path")).distinct().withColumn("is_directory", F.lit(True))
    own = entries.select("path").distinct().join(up.select("path"), "path", "left_anti").withColumn("is_directory", F.lit(False))
    return up.unionByName(own)


def parent(path):
    """Directory of an entry; the root has none."""
    return F.when(path == "/", F.lit(None).cast("string")).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/")))


def list_page(tree: DataFrame, directory: str, after: str = "", limit: int = PAGE) -> DataFrame:
    """Children of a directory by name, from just after ``after``."""
    own = tree.where(parent(F.col("path")) == directory).withColumn("name", codecs.file_name(F.col("path")))
    return own.where(F.col("name") > after).orderBy("name").limit(limit).select("path", "name", "is_directory")


def below(tree: DataFrame, path: str) -> DataFrame:
    """An entry and everything under it; siblings that only share its letters stay out."""
    return tree.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))


def delete_recursive(tree: DataFrame, path: str) -> DataFrame:
    """The tree without an entry and everything under it."""
    return tree.join(below(tree, path).select("path"), "path", "left_anti")


def upsert(tree: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (path, mtime, crtime, ...) put into a tree; an entry that was there keeps its time of creation."""
    old = tree.select("path", F.col("crtime").alias("__crtime"))
    new = entries.join(old, "path", "left").withColumn("crtime", F.coalesce("__crtime", "crtime")).drop("__crtime")
    return tree.join(entries.select("path"), "path", "left_anti").unionByName(new)


def get(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, is_directory, found) of wanted paths; the root is always there."""
    own = wanted.select("path").distinct().join(tree.select("path", "is_directory", F.lit(True).alias("__there")), "path", "left")
    root = F.col("path") == "/"
    return own.select("path", F.coalesce("is_directory", root).alias("is_directory"), (root | F.coalesce("__there", F.lit(False))).alias("found"))


def create(tree: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new tree, conflicts, unused chunks) of putting entries (path, is_directory, mtime, crtime, chunks) into a tree of the same columns.

    An entry below a file, be it there or put at the same time, is a conflict
    and isn't put. Directories above that are missing are made with the time of
    the first entry below them. An entry that was there keeps its time of
    creation, and the chunks that its new version no longer has are unused.
    """
    above = entries.select("path", "mtime", F.explode(codecs.ancestors(F.col("path"))).alias("up"))
    files = tree.where("NOT is_directory").select(F.col("path").alias("up")).union(entries.where("NOT is_directory").select(F.col("path").alias("up"))).distinct()
    conflicts = above.join(files, "up", "left_semi").select("path").distinct()
    fine = entries.join(conflicts, "path", "left_anti")
    made = above.where("up <> '/'").join(conflicts, "path", "left_anti").groupBy(F.col("up").alias("path")).agg(F.min("mtime").alias("mtime"))
    made = made.join(tree.select("path"), "path", "left_anti").join(fine.select("path"), "path", "left_anti")
    made = made.select("path", F.lit(True).alias("is_directory"), "mtime", F.col("mtime").alias("crtime"), F.array().cast("array<string>").alias("chunks"))
    old = tree.select("path", F.col("crtime").alias("__crtime"), F.col("chunks").alias("__chunks"))
    new = fine.join(old, "path", "left").withColumn("crtime", F.coalesce("__crtime", "crtime"))
    unused = new.select("path", F.explode(F.array_except("__chunks", "chunks")).alias("chunk"))
    rest = tree.join(fine.select("path"), "path", "left_anti")
    return rest.unionByName(made).unionByName(new.drop("__crtime", "__chunks")), conflicts, unused


def served(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, action) of wanted paths: list a directory, answer that there is nothing or no content, pass one chunk on, or assemble several."""
    own = wanted.select("path").distinct().join(tree.select("path", "is_directory", F.size("chunks").alias("__n")), "path", "left")
    action = F.when((F.col("path") == "/") | F.col("is_directory"), "list").when(F.col("is_directory").isNull(), "not found").when(F.col("__n") == 0, "no content").when(F.col("__n") == 1, "pass on").otherwise("assemble")
    return own.select("path", action.alias("action"))
