"""Repository locators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The host and prefix the locators are recognised by.
HOST = "github.com"
SSH_PREFIX = "git@github.com:"


def parse_repo_url(url: Column) -> Column:
    """``STRUCT<owner, name, url>`` of a repository locator, null if it is none.

    Takes ``git@github.com:o/r.git``, ``https://github.com/o/r`` and ``o/r``.
    """
    text = F.rtrim(F.trim(url), F.lit("/"))
    ssh = F.split(F.replace(F.replace(text, F.lit(SSH_PREFIX), F.lit("")), F.lit(".git"), F.lit("")), "/")
    web = F.split(F.substring_index(text, HOST + "/", -1), "/")
    short = F.split(text, "/")

    def repo(owner, name):
        return F.struct(
            owner.alias("owner"), name.alias("name"),
            F.concat(F.lit(f"https://{HOST}/"), owner, F.lit("/"), name).alias("url"),
        )

    def part(parts, i):
        return F.try_element_at(parts, F.lit(i))

    return (
        F.when(F.startswith(text, F.lit(SSH_PREFIX)) & (F.size(ssh) == 2), repo(part(ssh, 1), part(ssh, 2)))
        .when(
            F.contains(text, F.lit(HOST)) & (F.size(web) >= 2),
            repo(part(web, 1), F.replace(part(web, 2), F.lit(".git"), F.lit(""))),
        )
        .when(F.size(short) == 2, repo(part(short, 1), part(short, 2)))
    )
