"""Line-oriented analyses of program text: lines, definitions and uses, dead stores, reaching definitions, complexity.

Texts become one row per line by a generator inside the JVM; the order-dependent parts are windows over (key, variable).
Null texts have no lines; an empty text has one empty line; carriage returns at line ends are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Keywords that open a branch, and those that nest.
BRANCHES = ["if", "elif", "else if", "else", "for", "while", "case", "catch", "except", "match"]
NESTING = ["if", "for", "while", "switch", "try", "match", "elif", "case", "catch", "except"]
FLAT = ["else", "break", "continue", "goto"]
DECLARE = ["let", "const", "var", "final", "mut", "auto", "static", "int", "float", "double", "long", "bool", "boolean", "char", "string", "String", "export", "local", "readonly", "val"]
KEYWORDS = sorted({*BRANCHES, *NESTING, *FLAT, *DECLARE, "return", "def", "fn", "func", "function", "class", "struct", "enum", "interface", "trait", "import", "from", "in", "of", "is", "not", "and", "or", "new", "await", "async", "yield", "throw", "throws", "raise", "pub", "self", "this", "null", "None", "nil", "true", "false", "True", "False", "use", "crate", "defer", "range", "append", "assert", "echo", "else if"} - {"else if"})
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): line numbers from 1."""
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("p", "line")).select("key", (F.col("p") + 1).alias("line_no"), "line")


def _count(words: Column, wanted: list[str]) -> Column:
    """Occurrences of single words in the words of a line."""
    single = [w for w in wanted if " " not in w]
    return F.size(F.filter(words, lambda x: x.isin(*single)))


def complexity(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cyclomatic, cognitive): 1 + branch keywords and logical operators; nesting keywords weighted by their indent."""
    rows = lines(texts, key, text).where(F.trim("line") != "")
    rows = rows.withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    base = F.min("indent").over(W.partitionBy("key"))
    level = F.least(F.floor((F.col("indent") - base) / 2), F.lit(10))
    line = F.col("line")
    pairs = lambda pattern: F.when(line.rlike(pattern), F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))).otherwise(0)
    words = F.col("words")
    return (
        rows.withColumn("level", level)
        .withColumn("words", F.split(line, "[^A-Za-z0-9_]+"))
        .select("key", (_count(words, BRANCHES) + pairs(r"\belse\sif\b")).alias("b"), pairs(r"&&|\|\|").alias("o"), (_count(words, NESTING) * (1 + F.col("level"))).alias("n"), _count(words, FLAT).alias("f"))
        .groupBy("key")
        .agg((F.lit(1) + F.sum(F.col("b") + F.col("o"))).alias("cyclomatic"), F.sum(F.col("n") + F.col("f") + F.col("o")).alias("cognitive"))
    )


def complexity_report(texts: DataFrame, key: str, text: str, least: int = 5, n: int = 50) -> DataFrame:
    return complexity(texts, key, text).where(F.col("cyclomatic") >= least).orderBy(F.desc("cyclomatic"), "key").limit(n)


def definitions(rows: DataFrame) -> DataFrame:
    """(key, var, line_no): one definition per line at most, `name = value` with or without a declaring keyword."""
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    declared = r"^(?:(?:" + "|".join(DECLARE) + r")\s+)*(" + IDENTIFIER + r")\s*(?::\s*[\w<>\[\], ]+?)?\s*(?::=|=)(?![=>])"
    name = F.regexp_extract(line, declared, 1)
    return rows.where(~line.rlike(r"^(?://|#|\*|/\*)")).select("key", name.alias("var"), "line_no").where((F.col("var") != "") & ~F.col("var").isin(*KEYWORDS))


def uses(rows: DataFrame) -> DataFrame:
    """(key, var, line_no): identifiers that are read, one row per line; string contents and comments are left out."""
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    bare = F.regexp_replace(line, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "")
    bare = F.regexp_replace(bare, r"(?://|(?<=\s)#).*$", "")
    right = F.regexp_replace(bare, r"^(?:(?:" + "|".join(DECLARE) + r")\s+)*" + IDENTIFIER + r"\s*(?::\s*[\w<>\[\], ]+?)?\s*(?::=|=)(?![=>])", "")
    names = F.array_distinct(F.regexp_extract_all(right, F.lit(r"(?<![A-Za-z0-9_$.])(" + IDENTIFIER + ")"), F.lit(1)))
    return rows.where(~line.rlike(r"^(?://|#|\*|/\*)")).select("key", "line_no", F.explode(names).alias("var")).where(~F.col("var").isin(*KEYWORDS)).select("key", "var", "line_no")


def def_use(defs: DataFrame, use: DataFrame) -> DataFrame:
    """(key, var, defs, uses): sorted line numbers of each variable that is defined or used, as text."""
    both = defs.select("key", "var", "line_no", F.lit(True).alias("d")).unionByName(use.select("key", "var", "line_no", F.lit(False).alias("d")))
    listed = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(F.col("d") == flag, F.col("line_no")))).cast("array<string>"), ",")
    return both.groupBy("key", "var").agg(listed(True).alias("defs"), listed(False).alias("uses"))


def dead_stores(defs: DataFrame, use: DataFrame) -> DataFrame:
    """(key, var, line_no, next_def): definitions that another follows without a use after the one and up to the other.

    The last definition of a variable is never dead here. One window over both kinds of events, no join.
    """
    events = defs.select("key", "var", "line_no", F.lit(1).alias("d")).distinct().unionByName(use.select("key", "var", "line_no", F.lit(0).alias("d")).distinct())
    order = W.partitionBy("key", "var").orderBy("line_no", "d")  # of one line, the use comes first
    return events.withColumns({"nd": F.lead("d").over(order), "nl": F.lead("line_no").over(order)}).where("d = 1 and nd = 1").select("key", "var", "line_no", F.col("nl").alias("next_def"))


def uninitialized(defs: DataFrame, use: DataFrame) -> DataFrame:
    """(key, var, first_use): used before the first definition, or never defined and with a small initial."""
    both = defs.select("key", "var", F.col("line_no").alias("d"), F.lit(None).cast("int").alias("u")).unionByName(use.select("key", "var", F.lit(None).cast("int").alias("d"), F.col("line_no").alias("u")))
    first = both.groupBy("key", "var").agg(F.min("d").alias("d"), F.min("u").alias("first_use"))
    return first.where("first_use is not null and (first_use < d or (d is null and var rlike '^[a-z]'))").select("key", "var", "first_use")


def reaching(defs: DataFrame, use: DataFrame, at: int) -> DataFrame:
    """(key, var, defs): definitions up to a line, of variables used within one line of it."""
    near = use.where(F.col("line_no").between(at - 1, at + 1)).select("key", "var").distinct()
    return defs.where(F.col("line_no") <= at).join(near, ["key", "var"], "left_semi").groupBy("key", "var").agg(F.array_join(F.array_sort(F.collect_set("line_no")).cast("array<string>"), ",").alias("defs"))
