"""Repository history: git runs on the driver, its text is parsed by DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNIT = "\x1f"
LOG_FORMAT = f"--pretty=format:\x1e%H{UNIT}%an{UNIT}%ae{UNIT}%aI{UNIT}%s"


def run_git(repo: str, *args: str) -> str:
    """Output of git; no argument may hold a NUL, and none after the first may be an unknown option of a user."""
    if any("\0" in a for a in args):
        raise ValueError("an argument holds a NUL")
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def text_rows(spark: SparkSession, text: str) -> DataFrame:
    """(line_no, line) of a text."""
    rows = text.split("\n")
    return spark.createDataFrame(list(enumerate(rows, 1)) or [], "line_no long, line string")


def log_records(spark: SparkSession, text: str) -> DataFrame:
    """(record) of a log in LOG_FORMAT: a row per commit."""
    return spark.createDataFrame([(r,) for r in text.split("\x1e") if r.strip()] or [], "record string")


def parse_log(records: DataFrame) -> DataFrame:
    """(commit, author, email, date, subject, file_path, added, deleted) of `git log --numstat`, a row per file; binary files count 0.

    A record is parsed by itself, so the log needs no order.
    """
    parts = F.split(F.substring_index("record", "\n", 1), UNIT)
    rows = records.select(parts.alias("c"), F.explode(F.slice(F.split("record", "\n"), 2, 1 << 30)).alias("line")).where(F.trim("line") != "")
    stat = F.split("line", "\t")
    count = lambda i: F.coalesce(F.expr(f"try_cast(get(split(line, '\t'), {i}) as int)"), F.lit(0))
    return rows.select(
        *[F.col("c")[i].alias(n) for i, n in enumerate(("commit", "author", "email"))],
        F.to_timestamp(F.col("c")[3]).alias("date"),
        F.col("c")[4].alias("subject"),
        F.coalesce(F.try_element_at(stat, F.lit(3)), F.col("line")).alias("file_path"),
        count(0).alias("added"),
        count(1).alias("deleted"),
    )


def parse_blame(rows: DataFrame) -> DataFrame:
    """(line_no, commit, author, email, date, content) of `git blame --porcelain`; attributes of a commit come from its first record."""
    header = F.col("line").rlike("^[0-9a-f]{40} \\d+ \\d+")
    fill = W.partitionBy(F.lit(1)).orderBy("line_no")  # one file, read in its order
    at = rows.withColumn("commit", F.last(F.when(header, F.substring("line", 1, 40)), ignorenulls=True).over(fill)).withColumn("n", F.last(F.when(header, F.regexp_extract("line", r"^\S+ \d+ (\d+)", 1).cast("int")), ignorenulls=True).over(fill))
    pick = lambda key: F.max(F.when(F.startswith("line", F.lit(key + " ")), F.expr(f"substring(line, {len(key) + 2})")))
    who = at.groupBy("commit").agg(pick("author").alias("author"), pick("author-mail").alias("email"), pick("author-time").alias("t"))
    body = at.where(F.startswith("line", F.lit("\t"))).select(F.col("n").alias("line_no"), "commit", F.expr("substring(line, 2)").alias("content"))
    return body.join(who, "commit").select("line_no", "commit", "author", F.translate("email", "<>", "").alias("email"), F.date_format(F.timestamp_seconds(F.col("t").cast("long")), "yyyy-MM-dd HH:mm:ss").alias("date"), "content")


def parse_status(rows: DataFrame) -> DataFrame:
    """(file_path, state) of `git status --porcelain`: staged, unstaged or untracked, a row each."""
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    states = F.array(F.when(x == "?", "untracked"), F.when(~x.isin(" ", "?"), "staged"), F.when(~y.isin(" ", "?"), "unstaged"))
    return rows.where(F.length("line") > 3).select(F.expr("substring(line, 4)").alias("file_path"), F.explode(F.array_compact(states)).alias("state"))


def commit_diff(rows: DataFrame) -> DataFrame:
    """(file_path, added, deleted) of `git show --numstat`."""
    return rows.where(F.col("line").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t")).select(F.split("line", "\t")[2].alias("file_path"), F.coalesce(F.expr("try_cast(split(line, '\t')[0] as int)"), F.lit(0)).alias("added"), F.coalesce(F.expr("try_cast(split(line, '\t')[1] as int)"), F.lit(0)).alias("deleted"))


def hotspots(log: DataFrame, n: int = 20) -> DataFrame:
    """(file_path, commits, last_modified, score): files by number of commits, scores against the greatest."""
    per = log.groupBy("file_path").agg(F.countDistinct("commit").alias("commits"), F.max("date").alias("last_modified"))
    most = per.agg(F.max("commits").alias("most"))
    return per.crossJoin(F.broadcast(most)).select("file_path", "commits", "last_modified", F.round(F.col("commits") / F.col("most"), 6).alias("score")).orderBy(F.desc("commits"), "file_path").limit(n)  # one row: a scalar


def contributors(log: DataFrame) -> DataFrame:
    """(email, author, commits, added, deleted) from one scan of the log."""
    return log.groupBy("email").agg(F.max_by("author", F.struct("date", "author")).alias("author"), F.countDistinct("commit").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def branch_info(repo: str) -> dict:
    """Current branch, its upstream, and how far they are apart."""
    out = {"branch": run_git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip(), "upstream": None, "ahead": 0, "behind": 0}
    try:
        out["upstream"] = run_git(repo, "rev-parse", "--abbrev-ref", "@{upstream}").strip()
        out["behind"], out["ahead"] = map(int, run_git(repo, "rev-list", "--left-right", "--count", "@{upstream}...HEAD").split())
    except subprocess.CalledProcessError:
        pass
    return out


def file_history(spark: SparkSession, repo: str, path: str, n: int | None = None) -> DataFrame:
    """Commits of a file, the latest first, renames followed."""
    args = ["log", "--numstat", LOG_FORMAT, "--follow", *([f"-n{n}"] if n else []), "--", path]
    return parse_log(log_records(spark, run_git(repo, *args)))


def recent_changes(spark: SparkSession, repo: str, n: int = 20) -> DataFrame:
    """Files of the last n commits, a row per commit and file."""
    return parse_log(log_records(spark, run_git(repo, "log", "--numstat", LOG_FORMAT, f"-n{n}")))


def symbol_history(spark: SparkSession, repo: str, name: str, globs: list[str] | None = None) -> DataFrame:
    """Commits that changed how often a name stands in the sources."""
    from orrery.sources.tree import LANGUAGE_OF

    if name.startswith("-"):
        raise ValueError("a name doesn't begin with a dash")
    globs = globs if globs is not None else [f"*.{x}" for x in sorted(LANGUAGE_OF)]
    return parse_log(log_records(spark, run_git(repo, "log", "--numstat", LOG_FORMAT, f"-S{name}", "--", *globs)))
