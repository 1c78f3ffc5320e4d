import random
from pathlib import Path

from pyspark.sql import functions as F

from graphloom.operators import history
from graphloom.session import cut
from graphloom.sources.gitlog import read_git_log
from helpers import bag

LOG = """c3|move it|ann@x.org|2024-03-02

1\t2\tsrc/{old => new}/a.py
-\t-\tlogo.png
c2|fix a|b thing|bob@x.org|2024-02-02
5\t1\tsrc/old/a.py
c1|start|ann@x.org|2024-02-01
10\t0\tsrc/old/a.py
3\t0\tREADME.md
"""


def log(spark, folder, text=LOG, name="repo"):
    (Path(folder) / f"{name}.log").write_text(text)
    return read_git_log(spark, folder)


def test_commits(spark, folder):
    got = history.parse_commits(log(spark, folder))
    assert bag(got, "repo", "hash", "message", "author", "date", "files_changed", "insertions", "deletions") == [
        ("repo", "c1", "start", "ann", "2024-02-01", 2, 13, 0),
        ("repo", "c2", "fix a|b thing", "bob", "2024-02-02", 1, 5, 1),
        ("repo", "c3", "move it", "ann", "2024-03-02", 1, 1, 2)]
    # Strict parsing does not see the subject with a bar; its line goes to the commit above.
    strict = history.parse_commits(log(spark, folder), strict=True)
    assert bag(strict, "hash", "insertions") == [("c1", 13), ("c3", 6)]
    assert bag(history.parse_commits(log(spark, folder), max_commits=1), "hash") == [("c3",)]
    assert bag(history.parse_commits(log(spark, folder), since="2024-02-02"), "hash") == [("c2",), ("c3",)]


def test_aggregates(spark, folder):
    lines = log(spark, folder)
    commits = history.parse_commits(lines)
    people = history.contributors(commits)
    assert [(r.name, r.commits, r.insertions) for r in people.collect()] == [("ann", 2, 14), ("bob", 1, 5)]
    e = history.repo_evolution(commits).first()
    assert (e.total_commits, e.net_change, e.first_commit, e.last_commit) == (3, 16, "2024-02-01", "2024-03-02")
    assert bag(history.monthly_commits(commits), "month", "commits") == [("2024-02", 2), ("2024-03", 1)]
    assert bag(history.code_churn(commits, "2024-02-02"), "date", "files") == [("2024-02-02", 1), ("2024-03-02", 1)]
    assert history.latest_commit(commits).first().hash == "c3"
    drawn = [r.line for r in history.contributor_lines(people).orderBy("section", "line_no").collect()]
    assert drawn[4] == '    C0["ann\\n2次提交"]:::topContributor' and drawn[-1] == "    C0 -.->|协作| C1"


def test_file_history_follows_renames(spark, folder):
    lines = log(spark, folder)
    asked = spark.createDataFrame([("repo", "src/new/a.py")], "repo string, path string")
    assert bag(history.file_history(lines, asked), "file", "total_commits", "authors", "last_modified") == [
        ("src/new/a.py", 3, 2, "2024-03-02")]
    plain = history.file_history(lines)
    assert bag(plain, "file", "total_commits") == [("README.md", 1), ("logo.png", 1), ("src/new/a.py", 1), ("src/old/a.py", 2)]
    latest = history.latest_file_commits(history.file_commits(lines, asked), 2)
    assert bag(latest, "hash") == [("c2",), ("c3",)]


def test_a_new_file_at_an_old_path_is_another(spark, folder):
    (Path(folder) / "repo.log").write_text(
        "c4|again|x@x.org|2024-04-04\n1\t0\ta.py\nc3|new|x@x.org|2024-03-03\n1\t0\ta.py\n"
        "c2|move|x@x.org|2024-02-02\n1\t0\ta.py => b.py\nc1|first|x@x.org|2024-01-01\n1\t0\ta.py\n")
    lines = read_git_log(spark, folder)
    asked = spark.createDataFrame([("repo", "b.py"), ("repo", "a.py")], "repo string, path string")
    assert bag(history.file_commits(lines, asked), "file", "hash") == [
        ("a.py", "c1"), ("a.py", "c3"), ("a.py", "c4"), ("b.py", "c1"), ("b.py", "c2")]


def test_forty_renames_in_six_rounds(spark, folder, monkeypatch):
    """A file renamed 40 times, its names used again by others; every round is one written table of reached moves."""
    text = ""
    for i in range(40, 0, -1):
        text += f"m{i}|move|x@x.org|2024-01-01\n1\t0\tf{i - 1}.py => f{i}.py\n"
        text += f"o{i}|other|x@x.org|2024-01-01\n1\t0\tf{i}.py\n" if i % 3 else ""
    (Path(folder) / "repo.log").write_text(text + "c0|first|x@x.org|2024-01-01\n1\t0\tf0.py\n")
    lines = read_git_log(spark, folder)
    asked = spark.createDataFrame([("repo", "f40.py"), ("repo", "f20.py"), ("repo", "none.py")], "repo string, path string")
    written = []
    monkeypatch.setattr(history, "cut", lambda df: written.append(1) or cut(df))
    found = history.file_commits(lines, asked)
    assert len(written) <= 4 + 2 * 6
    got = {f: {r["hash"] for r in found.where(F.col("file") == f).collect()} for f in ("f40.py", "f20.py", "none.py")}
    # An f20.py edited before the name was given was another file, which the log knows no more of.
    assert got["f40.py"] == {f"m{i}" for i in range(1, 41)} | {"c0"}
    assert got["none.py"] == set()
    assert got["f20.py"] == {f"m{i}" for i in range(1, 21)} | {"c0"}


def plain_names(touched, asked):
    """Names of a file with the commits they held for; commits grow towards the past."""
    path, after, out = asked, -1, []
    while True:
        moves = sorted((at, old) for at, new, old in touched if new == path and old is not None and at > after)
        out.append((path, after, moves[0][0] if moves else None))
        if not moves:
            return out
        after, path = moves[0]


def test_random_renames(spark):
    rng = random.Random(12)
    touched = []
    for at in range(120):
        for new, old in {(f"n{rng.randrange(9)}", rng.choice([None, f"n{rng.randrange(9)}"])) for _ in range(rng.randrange(3))}:
            if not any(t[:2] == (at, new) for t in touched) and new != old:
                touched.append((at, new, old))
    frame = spark.createDataFrame([("r", at, new, old) for at, new, old in touched], "repo string, commit long, path string, old_path string")
    asked = spark.createDataFrame([("r", f"n{i}") for i in range(10)], "repo string, path string")
    got = history._names_over_time(frame, asked).collect()
    want = [(f"n{i}", p, None if a < 0 else a, u) for i in range(10) for p, a, u in plain_names(touched, f"n{i}")]
    assert sorted((tuple(r)[1:] for r in got), key=repr) == sorted(want, key=repr)


def test_splits_of_one_log_keep_their_order(spark, folder):
    """A log read in many splits gives the same commits as one read whole."""
    text = "".join(
        f"c{i}|m|u{i % 3}@x.org|2024-01-{i % 28 + 1:02d}\n" + "".join(f"{j}\t1\tf{j}\n" for j in range(i % 5)) for i in range(3000))
    (Path(folder) / "big.log").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        lines = read_git_log(spark, folder)
        assert lines.select("block").distinct().count() > 4
        got = history.parse_commits(lines)
        assert bag(got, "hash", "files_changed", "insertions") == sorted(
            [(f"c{i}", i % 5, sum(range(i % 5))) for i in range(3000)], key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_types(spark):
    paths = ["a.py", "b.py", "x/.env", "x/y.tar.gz", "LICENSE", "z.md"]
    df = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    rows = history.file_type_histogram(df, 2).orderBy(F.desc("count"), "ext").collect()
    assert [(r.ext, r["count"], r.total_files) for r in rows] == [(".py", 2, 6), (history.NO_SUFFIX, 2, 6)]
