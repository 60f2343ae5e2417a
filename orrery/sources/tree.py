"""Source trees: listing, language, content hash, incremental choice, manifests."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 2 * 1024 * 1024
# Directories that are never listed.
SKIPPED = ["node_modules", "target", "dist", "build", ".git", "vendor", "__pycache__", ".venv", "venv", ".next", "out", "coverage", ".cache", ".idea"]
# Extensions per language.
EXTENSIONS = {
    "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs", "jsx": "jsx", "python": "py pyi", "rust": "rs", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "php": "php", "ruby": "rb",
    "swift": "swift", "kotlin": "kt kts", "scala": "scala sc", "dart": "dart", "lua": "lua", "bash": "sh bash", "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs", "elm": "elm", "clojure": "clj cljs cljc", "ocaml": "ml mli",
    "zig": "zig", "nix": "nix", "powershell": "ps1 psm1", "groovy": "groovy gradle", "verilog": "v sv", "fortran": "f90 f95 f03", "r": "r R",
}
LANGUAGE_OF = {x: lang for lang, xs in EXTENSIONS.items() for x in xs.split()}
# Manifests, frameworks they may name, with a category.
MANIFESTS = ["package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile", "composer.json"]
FRAMEWORKS = {
    "react": "frontend", "vue": "frontend", "svelte": "frontend", "@angular/core": "frontend", "next": "fullstack", "nuxt": "fullstack", "express": "backend", "fastify": "backend", "koa": "backend", "@nestjs/core": "backend", "jest": "testing",
    "mocha": "testing", "vitest": "testing", "django": "backend", "flask": "backend", "fastapi": "backend", "pytest": "testing", "actix-web": "backend", "axum": "backend", "rocket": "backend", "tokio": "runtime", "gin-gonic/gin": "backend",
    "labstack/echo": "backend", "gofiber/fiber": "backend", "spring-boot": "backend", "junit": "testing", "rails": "backend", "sinatra": "backend", "rspec": "testing", "laravel/framework": "backend",
}


def language_of(path: Column) -> Column:
    """The language of a path's extension; the case counts but for R. Unknown gives null."""
    table = F.create_map(*[F.lit(x) for kv in sorted(LANGUAGE_OF.items()) for x in kv])
    return F.try_element_at(table, F.regexp_extract(path, r"\.([^./]+)$", 1))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def ignored_by_git(root: str) -> set[str] | None:
    """Paths below root that git lists, or None outside of a repository."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    return set(out.decode("utf-8", "replace").split("\0")) - {""}


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, size_bytes, content, content_hash) of the supported sources below root.

    Hidden and skipped directories and files over MOST_BYTES are left out before their bytes are read; texts that are
    not UTF-8 are left out, and so are empty files, which the reader passes over. In a git repository, what git ignores is left out too.
    """
    base = Path(root).resolve().as_uri()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^" + base.replace("file:///", "file:/+") + "/", "")
    inside = ~path.rlike(r"(?:^|/)(?:\.[^/]+|" + "|".join(d.replace(".", r"\.") for d in SKIPPED) + ")/") & ~path.rlike(r"(?:^|/)\.[^/]+$")
    rows = files.where(F.col("length") <= MOST_BYTES).withColumn("file_path", path).where(inside).withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    listed = ignored_by_git(root)
    if listed is not None:
        rows = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in sorted(listed)], "file_path string")), "file_path", "left_semi")  # one repository's list
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("file_path", "language", F.col("length").alias("size_bytes"), text.alias("content")).where("content is not null").withColumn("content_hash", content_hash(F.col("content")))


# Directories that the security scan passes over, besides those with a dot.
SCAN_SKIPPED = ["node_modules", "target", "dist", "build", "vendor", "__pycache__"]


def scan_dir_security(spark: SparkSession, root: str, exclude_tests: bool = False) -> DataFrame:
    """(file_path, language, content) for the security scan: what git ignores is read too, dot names and SCAN_SKIPPED aren't."""
    from orrery.operators.security import is_test_path

    base = Path(root).resolve().as_uri()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^" + base.replace("file:///", "file:/+") + "/", "")
    inside = ~path.rlike(r"(?:^|/)\.") & ~path.rlike("(?:^|/)(?:" + "|".join(SCAN_SKIPPED) + ")/")
    rows = files.where(F.col("length") <= MOST_BYTES).withColumn("file_path", path).where(inside).withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    if exclude_tests:
        rows = rows.where(~is_test_path(F.col("file_path")))
    return rows.select("file_path", "language", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("content is not null")


def changed(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files whose (path, hash) the index lacks."""
    return files.join(hashes.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")


def removed(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file_path) of the index that are no longer listed."""
    return hashes.select("file_path").distinct().join(files.select("file_path"), "file_path", "left_anti")


def detect_frameworks(manifests: DataFrame) -> DataFrame:
    """(name, category, manifest, version) of known frameworks named in manifests (path, content), the first by path."""
    hits = [F.when(F.col("content").rlike(r"(?:^|[\s\"'/:])" + k.replace(".", r"\.") + r"(?:[\s\"'=<>~^:@\[]|-starter|$)"), F.struct(F.lit(k).alias("name"), F.lit(c).alias("category"), F.regexp_extract("content", k.replace(".", r"\.") + r"[\"']?\s*(?::|=+|>=|~=|@|\s)\s*[\"']?[\^~>=v]*([0-9][\w.\-]*)", 1).alias("version"))) for k, c in FRAMEWORKS.items()]
    found = manifests.select("path", F.explode(F.array_compact(F.array(*hits))).alias("f")).select("f.*", F.col("path").alias("manifest"))
    return found.groupBy("name").agg(F.min(F.struct("manifest", "category", "version")).alias("m")).select("name", "m.category", "m.manifest", "m.version")
