import hashlib

from concord.operators import snapshot

FILES = "path string, sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_by_levels_against_a_plain_one(spark):
    rows = [(f"a/b{k % 3}/f{k}", sha(str(k))) for k in range(40)] + [("top", sha("t")), ("a/none", None), ("é\n/x", sha("x"))]
    parts = snapshot.parts(spark.createDataFrame([*rows, (None, "x")], FILES), digits=1)
    want, wanted = {}, {}
    for path, digest in rows:
        pieces = path.split("/")
        for n in range(len(pieces)):
            want.setdefault(("/".join(pieces[:n]), sha(path)[0]), []).append(f"{sha(path)}:{digest or ''}\n")
    for (folder, part), lines in want.items():
        wanted.setdefault(folder, []).append(f"{part}:{sha(''.join(sorted(lines)))}\n")
    assert {(r.folder, r.part): r.digest for r in parts.collect()} == {k: sha("".join(sorted(v))) for k, v in want.items()}
    got = {r.folder: (r.n_files, r.digest) for r in snapshot.folders(parts).collect()}
    assert got == {f: (sum(len(v) for (g, _), v in want.items() if g == f), sha("".join(sorted(v)))) for f, v in wanted.items()}


def test_differences_are_found_below_changed_folders_only(spark):
    rows = [(f"a/b{k % 3}/f{k}", str(k)) for k in range(30)]
    before = spark.createDataFrame([*rows, ("gone/x", "1"), ("twice", "1"), ("twice", "2")], FILES)
    after = spark.createDataFrame([("a/b1/f1", "other") if p == "a/b1/f1" else (p, s) for p, s in rows if p != "a/b0/f0"] + [("a/new", "n"), ("twice", "2"), ("twice", "1")], FILES)
    assert {(r.path, r.change) for r in snapshot.difference(before, after).collect()} == {("a/b0/f0", "removed"), ("a/b1/f1", "changed"), ("a/new", "added"), ("gone/x", "removed")}
    a, b = snapshot.parts(before), snapshot.parts(after)
    assert {(r.folder, r.change) for r in snapshot.changed_folders(a, b).collect()} == {("", "changed"), ("a", "changed"), ("a/b0", "changed"), ("a/b1", "changed"), ("gone", "removed")}
    assert snapshot.same(a, snapshot.parts(before.repartition(7))) and not snapshot.same(a, b) and snapshot.same(a.limit(0), b.limit(0))
    assert snapshot.difference(before, before).count() == 0


def test_final_check_names_what_is_open(spark):
    tasks = spark.createDataFrame([("t1", "examiner", "succeeded"), ("t2", "examiner", "failed"), ("t3", "examiner", "succeeded"), ("c", "composite", "succeeded")], "task_id string, stage string, status string")
    receipts = spark.createDataFrame([("t1", "a", "1"), ("c", "b", "2"), ("c", "d", "4"), ("c", "e", "5")], "task_id string, path string, sha256 string")
    files = spark.createDataFrame([("a", "1", 3), ("b", "x", 3), ("e", "5", 0)], "path string, sha256 string, bytes long")
    told = snapshot.final_check(spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t3",)], "task_id string"), tasks, receipts, files, ("composite", "ensemble"))
    assert sorted((r.check, r.key) for r in told.collect()) == [("changed_artifact", "b"), ("changed_artifact", "d"), ("changed_artifact", "e"), ("missing_stage", "ensemble"), ("missing_task", "t2"), ("unproven_task", "t3")]
