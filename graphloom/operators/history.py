"""Commit history from log lines.

Input rows are (repo, block, line_no, line) as read_git_log gives them; ``block``
is an order-preserving piece of a repository's log, so that assigning lines to
commits never sorts a whole log in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions.ordered import dense_index, last_known, top_per
from graphloom.functions.text import strip, suffix
from graphloom.session import cut

# --- fixed values: the layout of a log --------------------------------------
HEADER = r"^([^|]*)\|(.*)\|([^|]*)\|([0-9]{4}-[0-9]{2}-[0-9]{2})$"
FOUR_PARTS = r"^([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)$"
NUMSTAT = r"^([0-9]+|-)\t([0-9]+|-)\t([^\t]+)$"
NO_SUFFIX = "无扩展名"
# --- end of fixed values ----------------------------------------------------


def _owned_lines(lines: DataFrame, strict: bool) -> DataFrame:
    """Lines with the ``commit`` they belong to: the line_no of its header.

    ``strict`` takes only lines with exactly four fields as headers, so a subject
    with a bar in it is not one.
    """
    pattern = FOUR_PARTS if strict else HEADER
    text = strip(F.col("line"))
    rows = lines.select("repo", "block", "line_no", text.alias("line")).where("line <> ''")
    is_header = F.col("line").rlike(pattern)
    rows = rows.withColumn("_header", F.when(is_header, F.col("line_no")))
    owned = last_known(rows, ["repo"], "line_no", "_header", "commit", ["block"])
    return owned.where("commit is not null").withColumn("is_header", F.col("_header").isNotNull()).drop("_header")


def _header_fields(strict: bool) -> Column:
    pattern = FOUR_PARTS if strict else HEADER
    names = ["hash", "message", "email", "date"]
    return F.struct(*[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def _number(group: int) -> Column:
    return F.coalesce(F.regexp_extract("line", NUMSTAT, group).try_cast("bigint"), F.lit(0))


def parse_commits(
    lines: DataFrame, max_commits: int | None = None, since: str | None = None, strict: bool = False
) -> DataFrame:
    """Commits with changed files, insertions and deletions.

    Binary files (``-``) are not counted. ``since`` is a date, ``max_commits`` keeps
    the first ones of each log.
    """
    owned = _owned_lines(lines, strict)
    counted = ~F.col("is_header") & F.col("line").rlike(r"^[0-9]") & F.col("line").rlike(NUMSTAT)
    commits = owned.groupBy("repo", "commit").agg(
        F.max(F.when(F.col("is_header"), _header_fields(strict))).alias("h"),
        F.count(F.when(counted, 1)).alias("files_changed"),
        F.sum(F.when(counted, _number(1)).otherwise(0)).alias("insertions"),
        F.sum(F.when(counted, _number(2)).otherwise(0)).alias("deletions"),
    )
    commits = commits.select(
        "repo", "commit", "h.hash", "h.message", F.substring_index("h.email", "@", 1).alias("author"),
        "h.email", "h.date", "files_changed", "insertions", "deletions",
    )
    if since is not None:
        commits = commits.where(F.col("date") >= since)
    if max_commits is not None:
        commits = top_per(commits, ["repo"], ["commit"], max_commits)
    return commits


def contributors(commits: DataFrame) -> DataFrame:
    """Commits, insertions and deletions per email, most commits first."""
    return commits.groupBy("repo", "email").agg(
        F.min_by("author", "commit").alias("name"), F.count("*").alias("commits"),
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.min("commit").alias("first_seen"),
    ).orderBy("repo", F.desc("commits"), "first_seen")


def touched_paths(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, commit, path, old_path): what each commit touched; old_path where it renamed."""
    return _touched(_owned_lines(lines, strict))


def _touched(owned: DataFrame) -> DataFrame:
    owned = owned.where(~F.col("is_header") & F.col("line").rlike(NUMSTAT))
    raw = F.regexp_extract("line", NUMSTAT, 3)
    renames = F.contains(raw, F.lit(" => "))

    def side(group):
        braces = F.regexp_replace(raw, r"\{(.*) => (.*)\}", f"${group}")
        plain = F.regexp_replace(braces, r"^(.*) => (.*)$", f"${group}")
        return F.regexp_replace(plain, "//+", "/")

    return owned.select(
        "repo", "commit", F.when(renames, side(2)).otherwise(raw).alias("path"),
        F.when(renames, side(1)).alias("old_path"),
    )


def _names_over_time(touched: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, asked, path, after, until): every name the asked files had, and the commits it held for.

    A log has the newest commit first. A name holds from after the commit that renamed it on (``after``)
    back to the one that gave it (``until``, null if none), so a new file at an old path is another file.
    """
    key = ["repo", "at", "path"]
    moves = cut(touched.where("old_path is not null").groupBy("repo", F.col("commit").alias("at"), "path").agg(F.min("old_path").alias("old_path")))
    # Of each move the one before it: the nearest older one that gave the name it took the file from. Newest first, older
    # is a greater commit; from the oldest on, the last naming passed is the nearest.
    events = moves.select("repo", F.col("path").alias("name"), "at", F.lit(True).alias("gives"), F.lit(None).cast("string").alias("path")).unionByName(
        moves.select("repo", F.col("old_path").alias("name"), "at", F.lit(False).alias("gives"), "path"))
    passed = Window.partitionBy("repo", "name").orderBy(F.desc("at"), "gives").rowsBetween(Window.unboundedPreceding, -1)
    nearest = events.withColumn("_at", F.last(F.when(F.col("gives"), F.col("at")), ignorenulls=True).over(passed)).where("not gives")
    pointer = cut(nearest.where("_at is not null").select(*key, F.col("_at").alias("to_at"), F.col("name").alias("to_path")))
    # The last move of each asked file, and by doubled pointers all before it: as many rounds as the logarithm of the renames.
    asked = paths.select("repo", F.col("path").alias("asked")).distinct()
    newest = moves.groupBy("repo", "path").agg(F.min("at").alias("at"))
    found = cut(asked.join(newest.withColumn("asked", F.col("path")), ["repo", "asked"]).select("repo", "asked", "at", "path"))
    jump = pointer
    while not jump.isEmpty():
        more = found.join(jump, key).select("repo", "asked", F.col("to_at").alias("at"), F.col("to_path").alias("path"))
        found = cut(found.unionByName(more))
        onward = jump.select("repo", F.col("at").alias("to_at"), F.col("path").alias("to_path"), F.col("to_at").alias("_at"), F.col("to_path").alias("_path"))
        jump = cut(jump.join(onward, ["repo", "to_at", "to_path"]).select(*key, F.col("_at").alias("to_at"), F.col("_path").alias("to_path")))
    earlier = found.join(moves, key).join(pointer, key, "left").select(
        "repo", "asked", F.col("old_path").alias("path"), F.col("at").alias("after"), F.col("to_at").alias("until"))
    present = asked.join(newest.select("repo", F.col("path").alias("asked"), F.col("at").alias("until")), ["repo", "asked"], "left")
    return present.select("repo", "asked", F.col("asked").alias("path"), F.lit(None).cast(moves.schema["at"].dataType).alias("after"), "until").unionByName(earlier)


def file_commits(lines: DataFrame, paths: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(repo, file, commit, hash, message, email, date) of the commits that touched files.

    With ``paths`` (repo, path) renames are followed; without, every path stands for itself.
    """
    # Read by the paths and by the headers, so parsed once.
    owned = cut(_owned_lines(lines, strict).select("repo", "commit", "is_header", "line"))
    touched = _touched(owned)
    if paths is None:
        rows = touched.select("repo", F.col("path").alias("file"), "commit").distinct()
    else:
        names = _names_over_time(touched, paths)
        held = (F.col("after").isNull() | (F.col("commit") > F.col("after"))) & (F.col("until").isNull() | (F.col("commit") <= F.col("until")))
        rows = touched.join(names, ["repo", "path"]).where(held).select("repo", F.col("asked").alias("file"), "commit").distinct()
    heads = owned.where("is_header").select("repo", "commit", _header_fields(strict).alias("h"))
    return rows.join(heads, ["repo", "commit"]).select("repo", "file", "commit", "h.*")


def file_history(lines: DataFrame, paths: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Commit count, author count and last change per file."""
    rows = file_commits(lines, paths, strict)
    return rows.groupBy("repo", "file").agg(
        F.count("*").alias("total_commits"), F.countDistinct("email").alias("authors"),
        F.min_by("date", "commit").alias("last_modified"),
    )


def latest_file_commits(rows: DataFrame, k: int | None = None) -> DataFrame:
    """The commits per file, all or the most recent ``k``; a log has the newest first."""
    return top_per(rows, ["repo", "file"], ["commit"], k)


def code_churn(commits: DataFrame, since: str | None = None) -> DataFrame:
    """Insertions, deletions and changed files per day."""
    rows = commits if since is None else commits.where(F.col("date") >= since)
    return rows.where("files_changed > 0").groupBy("repo", "date").agg(
        F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.sum("files_changed").alias("files"),
    )


def repo_evolution(commits: DataFrame) -> DataFrame:
    """Totals per repository, and its oldest and newest commit in log order."""
    return commits.groupBy("repo").agg(
        F.count("*").alias("total_commits"), F.sum("insertions").alias("total_insertions"),
        F.sum("deletions").alias("total_deletions"),
        (F.sum("insertions") - F.sum("deletions")).alias("net_change"),
        F.max_by("date", "commit").alias("first_commit"), F.min_by("date", "commit").alias("last_commit"),
    )


def monthly_commits(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("commits"))


def contributor_lines(people: DataFrame, k: int | None = None) -> DataFrame:
    """Mermaid star of the contributors per repository, all or the top ``k``: (repo, section, line_no, line)."""
    if k is None:
        keyed = people.withColumn("_most", -F.col("commits"))
        top = dense_index(keyed, ["repo", "_most", "first_seen"], "n", within="repo").drop("_most")
    else:
        place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("commits"), "first_seen"))
        top = people.withColumn("n", place).where(F.col("n") <= k).withColumn("n", F.col("n") - 1)
    style = F.when(F.col("n") == 0, "topContributor").otherwise("contributor")
    label = F.format_string(
        '    C%d["%s\\n%d次提交"]:::%s', "n", F.replace(F.col("name"), F.lit(" "), F.lit("_")), "commits", style
    )
    head = F.array(
        F.lit("graph TD"), F.lit("    classDef topContributor fill:#4CAF50,stroke:#388E3C,color:white"),
        F.lit("    classDef contributor fill:#2196F3,stroke:#1565C0,color:white"), F.lit(""),
    )

    def rows(frame, section, number, line):
        return frame.select("repo", F.lit(section).alias("section"), number.alias("line_no"), line.alias("line"))

    repos = top.select("repo").distinct().select("repo", F.posexplode(head).alias("n", "line"))
    return (
        rows(repos, 0, F.col("n"), F.col("line"))
        .unionByName(rows(top, 1, F.col("n"), label))
        .unionByName(rows(top.where("n = 0"), 2, F.lit(0), F.lit("")))
        .unionByName(rows(top.where("n > 0"), 3, F.col("n"), F.format_string("    C0 -.->|协作| C%d", "n")))
    )


def file_type_histogram(files: DataFrame, k: int | None = None) -> DataFrame:
    """Suffixes per repository, all or the ``k`` most frequent, with the number of its files. Files are (repo, path)."""
    ext = suffix(F.col("path"))
    counts = files.withColumn("ext", F.when(ext == "", NO_SUFFIX).otherwise(ext)).groupBy("repo", "ext").agg(
        F.count("*").alias("count"), F.min("path").alias("_first")
    )
    totals = counts.groupBy("repo").agg(F.sum("count").alias("total_files"))
    return top_per(counts, ["repo"], [F.desc("count"), F.col("_first")], k).drop("_first").join(totals, "repo")


def latest_commit(commits: DataFrame) -> DataFrame:
    """The newest commit per repository: the first of its log."""
    return commits.groupBy("repo").agg(
        F.min_by(F.struct("hash", "message", "author", "date"), "commit").alias("c")
    ).select("repo", "c.*")
