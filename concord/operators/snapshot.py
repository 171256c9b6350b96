"""Frozen inputs: digests of a tree of files by levels, what changed since, and the last check of a run.

Files are rows of path (parts joined by /, none empty) and sha256. A folder's digest
covers every file below it, so two trees are equal if their roots' digests are, and a
comparison goes on only below folders that differ. Files of a folder are dealt into
parts by the digest of their path: no task holds a folder, but one of its parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Hexadecimal digits that name a part: 4,096 parts a folder.
DIGITS = 3


def parent(path: Column | str) -> Column:
    """The folder that a path lies in; the root is empty."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _known(files: DataFrame, digits: int) -> DataFrame:
    name = F.sha2("path", 256)
    # a file without a digest couldn't be read; it differs from any that could
    return files.filter(F.col("path").isNotNull()).select("path", F.coalesce("sha256", F.lit("")).alias("sha256"), name.alias("name"), F.left(name, F.lit(digits)).alias("part"))


def parts(files: DataFrame, digits: int = DIGITS) -> DataFrame:
    """folder, part, n_files and digest, for each folder that holds a file at any depth, the root included.

    A part's digest is the SHA-256 of its files' lines in order of the path's digest:
    that digest, a colon, the file's own and a line feed. Files without a path are left
    out; a path that comes twice counts twice.
    """
    pieces = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda n: F.array_join(F.slice(pieces, 1, n), "/"))
    rows = _known(files, digits).select(F.explode(above).alias("folder"), "part", F.concat_ws(":", "name", "sha256").alias("line"))
    return rows.groupBy("folder", "part").agg(F.count("*").alias("n_files"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")), 256).alias("digest"))


def folders(told: DataFrame) -> DataFrame:
    """folder, n_files and digest from its parts: the SHA-256 of `part:digest` and a line feed each, in order."""
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "digest"))), "\n")
    return told.groupBy("folder").agg(F.sum("n_files").alias("n_files"), F.sha2(F.concat(lines, F.lit("\n")), 256).alias("digest"))


def _differing(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    a, b = (df.select(*keys, F.col("digest").alias(n)) for df, n in ((before, "__a"), (after, "__b")))
    return a.join(b, list(keys), "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b")))


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """folder and change (added, removed or changed), from the parts of two states; no row if nothing differs."""
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return _differing(folders(before), folders(after), "folder").select("folder", change.alias("change"))


def difference(before: DataFrame, after: DataFrame, frozen: DataFrame | None = None, now: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """path and change of each file that isn't the same in both states, found through the parts that differ.

    frozen and now are parts() of the two states where they are at hand, such as those
    that were written when the input was frozen. Only files of a part that differs are
    compared one by one. A path that comes several times is compared by all its digests.
    """
    frozen, now = (parts(f, digits) if p is None else p for f, p in ((before, frozen), (after, now)))
    open_ = _differing(frozen, now, "folder", "part").select("folder", "part")

    def within(files: DataFrame, name: str) -> DataFrame:
        rows = _known(files, digits).withColumn("folder", parent("path")).join(open_, ["folder", "part"], "left_semi")
        return rows.groupBy("path").agg(F.array_sort(F.collect_list("sha256")).alias(name))

    both = within(before, "__was").join(within(after, "__is"), "path", "full_outer")
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(F.col("__was") != F.col("__is"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def same(before: DataFrame, after: DataFrame) -> bool:
    """Whether the parts of two states have the same root."""
    return changed_folders(before.filter("folder = ''"), after.filter("folder = ''")).isEmpty()


def final_check(expected: DataFrame, tasks: DataFrame, receipts: DataFrame, files: DataFrame, stages: tuple[str, ...] = (), keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """check and key: whatever forbids to call a run finished; no row if nothing does.

    missing_task: an expected task that didn't succeed. unproven_task: one that succeeded
    without a receipt for any file. changed_artifact: a receipt whose file is gone, empty
    or has another digest. missing_stage: one of the stages without a task that succeeded.
    tasks has the keys, stage and status; receipts the keys, path and sha256; files path,
    sha256 and bytes.
    """
    done = tasks.filter("status = 'succeeded'")
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    wanted = expected.select(*keys).distinct()
    found = [
        ("missing_task", wanted.join(done, list(keys), "left_anti").select(key.alias("key"))),
        ("unproven_task", wanted.join(done, list(keys), "left_semi").join(receipts, list(keys), "left_anti").select(key.alias("key"))),
    ]
    had = files.select("path", F.col("sha256").alias("__sha"), F.col("bytes").alias("__bytes"))
    gone = ~F.col("sha256").eqNullSafe(F.col("__sha")) | (F.coalesce("__bytes", F.lit(0)) == 0)
    found.append(("changed_artifact", receipts.select("path", "sha256").join(had, "path", "left").filter(gone).select(F.col("path").alias("key"))))
    if stages:
        named = tasks.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
        found.append(("missing_stage", named.join(done.select("stage"), "stage", "left_anti").select(F.col("stage").alias("key"))))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("check"), "key") for name, rows in found])
