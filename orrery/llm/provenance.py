"""Generated, minified or vendored source files and data blobs (problem 6): thresholds on layout statistics per language.

Each node's body gives the longest and the mean line, the shares of white space, of letters and digits, of numeric
literals, of encoded text (across quotes, escapes and line ends) and of long dense lines. They are summed per file,
combined before the shuffle, so a file with a third of all nodes is no burden, and held against the thresholds of the
file's language. Two more signs come before them: the place in the tree, and a banner: a comment at the head of a body, of
any length, with several kinds of evidence that the file was made from something or copied from somewhere (the word for
it, the tool, the source, a checksum, the order not to edit it).

Defined results: a null path is no file; a null or empty body has no statistics; repeated rows of a node only weigh more;
a file without nodes is judged by its path; the language of most characters counts (of equals, the first by name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import canonical_path

# Directories that hold code of others, anywhere in the path.
VENDOR_DIRS = ["vendor", "vendored", "node_modules", "bower_components", "jspm_packages", "web_modules", "site-packages", "dist-packages", "third_party", "third-party", "thirdparty", "3rdparty", "Pods", "Carthage", "Godeps"]
# Directories of generated code, anywhere in the path.
GENERATED_DIRS = ["__generated__", "generated", "generated-sources", "generated-src", "generated_src", "gen-src", "autogen", "_generated"]
# Directories that mean it only at the root of a repository.
ROOT_VENDOR_DIRS = ["deps", "external", "externals", "extern", "contrib/vendor"]
ROOT_GENERATED_DIRS = ["gen", "target/codegen", "target/generated", "build/generated"]
BUILD_DIRS = ["dist", "build", "out", "public/assets", "static/dist", "static/build", "public/build", "public/dist", "build/out", "target/classes", "target/dist"]

VENDOR_PATH = "(?:^|/)(?:" + "|".join(VENDOR_DIRS) + ")/|^[^/]+/(?:" + "|".join(ROOT_VENDOR_DIRS) + ")/"
GENERATED_PATH = "(?:^|/)(?:" + "|".join(GENERATED_DIRS) + ")/|^[^/]+/(?:" + "|".join(ROOT_GENERATED_DIRS) + r")/|(?:[._]generated|\.gen|_gen|\.g|_pb2|_pb2_grpc|\.pb|\.pb\.gw|_pb|_grpc_pb|\.designer|\.autogen)\.\w+$|(?:^|/)zz_generated\.[^/]*$|\.pb\.(?:cc|h)$"
MINIFIED_PATH = r"[.-]min\.(?:js|mjs|cjs|css|jsx|ts)$|\.(?:bundle|chunk|umd\.min|packed)\.(?:js|mjs|cjs)$|^[^/]+/(?:" + "|".join(BUILD_DIRS) + ")/"

# Lines that belong to a comment at the head of a body (attributes and preprocessor lines don't).
COMMENT_LINE = r"""^\s*(?://|#(?!!?\[|include\b|define\b|if|pragma\b)|--|;|/\*|\*|<!--|"{3}|'{3}|\(\*|%)|^\s*$"""
COMMENT_START = r"""^\s*(?://|#|--|;|/\*|\*|<!--|"{3}|'{3}|\(\*|%)"""
COMMENT_BLOCK = r"""(?s)\A\s*(/\*.*?\*/|<!--.*?-->|"{3}.*?"{3}|'{3}.*?'{3})"""

# What a banner is made of. No phrase alone makes one: a line of the head comment starts with one of the first words, and
# several kinds of evidence meet. The words of each kind.
_VERBS = "generated|created|(?:re)?written|produced|emitted|compiled|built|scaffolded|rendered|erzeugt|generiert|erstellt|geschrieben|gebaut|générée?|genere|créée?|produite?|generado|creado|producido|gerado|criado|gegenereerd|сгенерирован\\w*|создан\\w*"
_MADE = rf"\b(?:{_VERBS})\b|\boutput of\b|\b(?:compiler|generator|codegen)\s*:|自動生成|自动生成"
_AUTOMATIC = r"\bauto[- ]?(?:generated|written|created|gen)\b|\bautomati\w+|\bautomáti\w+|\bmachine[- ](?:generated|written|made)|@generated\b|<auto-?generated|自動|自动"
_ORDER = (
    r"\b(?:do not|don't|never|please don't|not to be|ne pas|no|não|niet|не)\s+(?:be\s+)?(?:manually |hand[- ]?|by hand )?(?:edit|modif|chang|touch|alter|patch|éditer|edit|bewerk|редактир|измен)"
    r"|\bnicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)|\b(?:by|von) hand\b|\bà la main\b|\ba mano\b|\bmanual(?:ly)? (?:changes|edit)"
    r"|\b(?:changes|edits|änderungen|modifications|cambios)\b.{0,60}\b(?:lost|overwritten|discarded|verloren|überschrieben|perdu|perdid|sobrescri)"
    r"|\bnot (?:this|the) (?:output|file|copy|code)\b|\bregenerate\b|\bneu geschrieben\b|手動で|勿编辑|请勿|編集しない"
)
_SOURCE = r"\b[\w./-]+\.(?:proto|idl|schema|toml|ya?ml|json|xml|xsd|wsdl|thrift|graphql|avsc|fbs|g4|tmpl|tpl|template|in|sql|csv|def|spec)\b"
_TOOL = rf"(?:{_VERBS})\W+(?:\S+\W+){{0,3}}?(?:by|with|using|via|mit|von|durch|par|avec|con|por|door)\s+\S|\b(?:compiler|generator|tool)\s*[:=]|\(\s*[a-z][\w.-]+\s*\)\W*$|`[^`\n]+`|\b[a-z][\w-]+ v?\d+\.\d+"
_SELF = r"\b(?:this|diese[rs]?|ce(?:tte)?|est[ea]|dit) (?:file|code|module|source|output|class|script|datei|modul|quelltext|fichier|classe|archivo|módulo|código|bestand)\b|\bcode generated\b"
_CHECKSUM = r"\b(?:checksum|sha-?\d+|md5|digest|crc|prüfsumme)\b\W*[0-9a-f]{4,}"
_GENERATED_START = rf"(?m)^\W*(?:{_SELF}|{_MADE}|{_AUTOMATIC}|{_ORDER}|(?:source|code|file|bindings|input|quelle)\b)"

_COPIED = r"\bvendored\b|\bthird[- ]party\b|\b(?:copied|imported|mirrored|forked|taken|bundled|übernommen|kopiert|copié|copiado)\b|\bcopy of\b|\bupstream\b|\bverbatim\b"
_PACKAGE = r"[\w@./-]*\w(?:@| v?| release | version )\d+\.\d+"
_ORIGIN = r"\b(?:from|of|aus|von|de|desde)\s+(?:the\s+)?\S|https?://|\bupstream\b|\b(?:project|repository)\b"
_OWNER = r"\(c\)|©|\bcopyright\b|\bcontributors\b|\blicen[sc]e"
_LEAVE = r"\b(?:do not|don't|never|nicht|ne pas|no)\s+(?:patch|edit|modif|chang|touch)|\bunmodified\b|\bverbatim\b|\bunverändert\b|\blocal(?:ly)? (?:changes|patch)"
_PACKAGE_START = rf"(?m)^\W*{_PACKAGE}"

# Fixed values, by language. Of a node: the shares of its characters in encoded text and in numeric literals from which it
# is a blob. Of a file: the share of its characters in blobs; the length of a line that no hand writes, with the share of
# characters in long dense lines; the mean line, white space and alphanumeric share beyond which code is minified. They lie
# between the hand-written and the other files of each language; `layout_error` gives the error on files that path or
# banner tell of.
THRESHOLDS = {
    "": {"longest": 300, "dense": 0.3, "encoded": 0.4, "numeric": 0.33, "blob": 0.2, "mean": 200, "blanks": 0.05, "alphanumeric": 0.85},
    "javascript": {"longest": 300, "dense": 0.2, "encoded": 0.4, "numeric": 0.33, "blob": 0.2, "mean": 180, "blanks": 0.055, "alphanumeric": 0.82},
    "typescript": {"longest": 300, "dense": 0.2, "encoded": 0.4, "numeric": 0.33, "blob": 0.2, "mean": 200, "blanks": 0.055, "alphanumeric": 0.85},
    "python": {"longest": 300, "dense": 0.3, "encoded": 0.4, "numeric": 0.36, "blob": 0.2, "mean": 200, "blanks": 0.05, "alphanumeric": 0.84},
    "go": {"longest": 300, "dense": 0.3, "encoded": 0.4, "numeric": 0.33, "blob": 0.2, "mean": 180, "blanks": 0.05, "alphanumeric": 0.86},
    "java": {"longest": 350, "dense": 0.3, "encoded": 0.4, "numeric": 0.33, "blob": 0.2, "mean": 180, "blanks": 0.045, "alphanumeric": 0.84},
    "rust": {"longest": 320, "dense": 0.3, "encoded": 0.4, "numeric": 0.33, "blob": 0.2, "mean": 200, "blanks": 0.045, "alphanumeric": 0.8},
    "bash": {"longest": 400, "dense": 0.3, "encoded": 0.45, "numeric": 0.33, "blob": 0.2, "mean": 180, "blanks": 0.045, "alphanumeric": 0.78},
}
_SUMS = ("size", "lines", "blanks", "alphanumeric", "numeric", "encoded", "dense", "data")
DENSE_LINE, DENSE_BLANKS, DENSE_SIGNS, LEAST_BLOB = 300, 0.05, 0.15, 400
NUMBER = r"(?<![\w.])(?:0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)(?![\w.])"
#: A key between its armour lines is a credential in code and no data.
ARMOUR = r"(?s)-----BEGIN [^-\n]*-----[^-]*(?:-----END [^-\n]*-----)?"
#: Text of a code, whatever quotes, escapes and line ends cut it: escaped bytes; one long run; runs on lines of their own.
ENCODED = (
    r"(?:\\x[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]{4,6}\}?|\\[0-3][0-7]{2}){4,}"
    r"|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]{0,50}[0-9])[A-Za-z0-9+/=_-]{60,}"
    r"|(?m:^)[ \t]*[\"'`]?(?=[A-Za-z+/=_-]{0,50}[0-9])[A-Za-z0-9+/=_-]{24,}[\"'`]?[ \t]*[+,;.\\&]?[ \t]*\r?(?m:$)"
)


def _evidence(head: Column, kinds: list[str]) -> Column:
    """How many of the kinds stand in a head comment."""
    out = F.lit(0)
    for kind in kinds:
        out = out + head.rlike("(?im)" + kind).cast("int")
    return out


def head_comment(body: Column, lines: Column) -> Column:
    """The comment at the head of a body, as long as it is: all leading comment lines, and a leading block as a whole."""
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT_LINE)), True).cast("int")
    leading = F.slice(lines, F.lit(1), F.when(code == 0, F.size(lines)).otherwise(code - 1))
    return F.when(body.rlike(COMMENT_START), F.concat_ws("\n", F.regexp_extract(body, COMMENT_BLOCK, 1), F.array_join(leading, "\n"))).otherwise("")


def banners(head: Column) -> tuple[Column, Column]:
    """(generated, vendored): whether a head comment says that the file was made from something, or copied."""
    marked = head.rlike("(?i)@generated\\b|<auto-?generated")
    made = head.rlike("(?i)" + _GENERATED_START) & (head.rlike(f"(?i){_MADE}|{_AUTOMATIC}")) & (_evidence(head, [_AUTOMATIC, _ORDER, _SOURCE, _TOOL, _SELF, _CHECKSUM]) >= 2)
    copied = head.rlike("(?i)" + _COPIED) & (_evidence(head, [_PACKAGE, _ORIGIN, _OWNER, _LEAVE]) >= 2)
    named = head.rlike("(?i)" + _PACKAGE_START) & head.rlike("(?i)" + _OWNER)
    return marked | made, copied | named


def layout(nodes: DataFrame) -> DataFrame:
    """One row per node row: (file_path, language, size, lines, longest, blanks, alphanumeric, numeric, encoded, dense, data, generated_banner, vendored_banner). `data` is the size of a blob, else 0."""
    body = F.col("body")
    size = F.length(body)
    without = lambda pattern: size - F.length(F.regexp_replace(body, pattern, ""))
    lines = F.split(body, "\n")
    dense = F.aggregate(
        F.filter(F.col("__lines"), lambda x: F.length(x) >= DENSE_LINE),
        F.lit(0),
        lambda acc, x: acc + F.when((F.length(F.regexp_replace(x, r"\s+", "")) >= F.length(x) * (1 - DENSE_BLANKS)) & (F.length(F.regexp_replace(x, "[A-Za-z0-9]+", "")) >= F.length(x) * DENSE_SIGNS), F.length(x)).otherwise(0),
    )
    open_ = F.when(body.contains("-----BEGIN "), F.regexp_replace(body, ARMOUR, "")).otherwise(body)
    generated, vendored = banners(F.col("__head"))
    has_head = F.col("__head").rlike(r"\w")
    return (
        nodes.where(F.col("file_path").isNotNull() & (size > 0))
        .select(canonical_path(F.col("file_path")).alias("file_path"), F.lower(F.coalesce("language", F.lit(""))).alias("language"), body, size.alias("size"), lines.alias("__lines"), open_.alias("__open"))
        .withColumns({"longest": F.array_max(F.transform("__lines", lambda x: F.length(x))), "__head": head_comment(body, F.col("__lines"))})
        .select(
            "file_path",
            "language",
            "size",
            F.size("__lines").alias("lines"),
            "longest",
            without(r"\s+").alias("blanks"),
            without("[A-Za-z0-9]+").alias("alphanumeric"),
            F.when(body.rlike(r"\d\S*[^\w.]+\S*\d"), without(NUMBER)).otherwise(0).alias("numeric"),
            (F.length("__open") - F.length(F.regexp_replace("__open", ENCODED, ""))).alias("encoded"),
            dense.alias("dense"),
            (has_head & generated).alias("generated_banner"),
            (has_head & vendored).alias("vendored_banner"),
        )
        .withColumn("data", F.when((F.col("size") >= LEAST_BLOB) & ((F.col("encoded") >= F.col("size") * _threshold("encoded")) | (F.col("numeric") >= F.col("size") * _threshold("numeric"))), F.col("size")).otherwise(0))
    )


def file_statistics(nodes: DataFrame) -> DataFrame:
    """One row per canonical file: sums and greatest values of its nodes' layout."""
    per_language = (
        layout(nodes)
        .groupBy("file_path", "language")
        .agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("longest").alias("longest"), F.max("generated_banner").alias("generated_banner"), F.max("vendored_banner").alias("vendored_banner"))
    )
    return per_language.groupBy("file_path").agg(
        F.max(F.struct("size", F.col("language"))).alias("top"),
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.max(c).alias(c) for c in ("longest", "generated_banner", "vendored_banner")],
    ).withColumn("language", F.col("top.language")).drop("top")


def _threshold(name: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in THRESHOLDS.items() if k for x in (k, v[name])])
    return F.coalesce(table[F.col("language")], F.lit(THRESHOLDS[""][name]))


def classify_files(hashes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, kind, reason, and the statistics): kind is generated, minified, vendored, data or hand-written."""
    files = hashes.where(F.col("file_path").isNotNull()).select(canonical_path(F.col("file_path")).alias("file_path")).distinct()
    share = lambda c: F.col(c) / F.col("size")
    path = F.col("file_path")
    rules = [
        ("vendored", "path", path.rlike(VENDOR_PATH)),
        ("generated", "path", path.rlike(GENERATED_PATH)),
        ("minified", "path", path.rlike(MINIFIED_PATH)),
        ("generated", "banner", F.col("generated_banner")),
        ("vendored", "banner", F.col("vendored_banner")),
        ("data", "encoded runs", (share("data") >= _threshold("blob")) & (F.col("encoded") > F.col("numeric"))),
        ("data", "numeric literals", share("data") >= _threshold("blob")),
        ("minified", "dense lines", (F.col("longest") >= _threshold("longest")) & (share("dense") >= _threshold("dense"))),
        ("minified", "layout", (F.col("size") / F.col("lines") >= _threshold("mean")) & (share("blanks") <= _threshold("blanks")) & (share("alphanumeric") <= _threshold("alphanumeric"))),
    ]
    pick = lambda at: F.coalesce(*[F.when(F.coalesce(r[2], F.lit(False)), F.lit(r[at])) for r in rules])
    return files.join(file_statistics(nodes), "file_path", "left").select(
        "file_path",
        F.coalesce(pick(0), F.lit("hand-written")).alias("kind"),
        pick(1).alias("reason"),
        "language",
        "longest",
        *[F.round(share(c), 4).alias(f"{c}_share") for c in ("blanks", "alphanumeric", "numeric", "encoded", "dense", "data")],
        F.round(F.col("size") / F.col("lines"), 2).alias("mean_line"),
    )


def layout_error(kinds: DataFrame) -> DataFrame:
    """(language, files, flagged): of the files in `kinds` that neither path nor banner tells of, how many the layout flags.

    With (reason = 'path' or 'banner') as known cases and the rest as hand-written, this shows where the thresholds lie.
    """
    told = F.col("reason").isin("path", "banner")
    return kinds.where(F.col("language").isNotNull() & ~F.coalesce(told, F.lit(False))).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("kind") != "hand-written").alias("flagged"))
