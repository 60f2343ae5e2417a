"""Functions paired with their documentation (problem 3): packrat grammars per language, then a filter for what is said.

The documentation of a function or method is `doc_comment` or, where that is null or blank, the comment directly before
the declaration or the docstring directly after it in `body`. A grammar per language reads the head of a body and keeps
source offsets: comments, annotations, and the declaration with its name and parameters, whose brackets nest as deep as
they do. Where a declaration has another form, its first line stands for it. Documentation, wherever it stands, is read by
a grammar of its own into blank lines, lines that say nothing, tags and prose. The description then has to say something
that the name, the parameters and types, bare tags, references, placeholders, tool directives, rulers, licence lines and
disabled code don't say.

Defined results: a null body has no comment; a null signature is replaced by the parsed declaration; a null language is
read as the C-like one; brackets nested hundreds deep make a head without parts; repeated rows and ids give one row each;
other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.peg import Expr, Parser, ahead, first, many, maybe, rule, seq, span, token

_NL = r"[ \t]*(?:\r?\n|\Z)"


_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"


def _grammar(line_comment: str, block_comment: str | None, annotation: Expr | None, declaration: list[Expr], docstring: bool) -> dict[str, Expr]:
    """A head: comments, annotations and the declaration, with the docstring after it. `declaration` are ordered choices."""
    blank = token(r"[ \t]*\r?\n")
    one = token(r"[ \t]*" + line_comment + r"[^\n]*(?:\n|\Z)")
    comments = [many(one, 1)] + ([token(r"[ \t]*" + block_comment + _NL)] if block_comment else [])
    g = {
        # brackets nest as deep as they do; literals inside keep theirs to themselves
        "literal": first(token(r'"(?:[^"\\\n]|\\.)*"'), token(r"'(?:[^'\\\n]|\\.)*'"), token(r"`(?:[^`\\]|\\.)*`")),
        "round": seq(token(r"\("), many(first(rule("literal"), rule("round"), rule("square"), rule("curly"), token(r"[^()\[\]{}\"'`]+|[\"'`]"))), token(r"\)")),
        "square": seq(token(r"\["), many(first(rule("literal"), rule("round"), rule("square"), rule("curly"), token(r"[^()\[\]{}\"'`]+|[\"'`]"))), token(r"\]")),
        "curly": seq(token(r"\{"), many(first(rule("literal"), rule("round"), rule("square"), rule("curly"), token(r"[^()\[\]{}\"'`]+|[\"'`]"))), token(r"\}")),
        "angle": seq(token("<"), many(first(rule("angle"), token(r"[^<>(){};\n]+"))), token(">")),
        "parameters": span("parameters", rule("round")),
        "comment": first(*comments),
        "annotation": annotation or token(r"(?!)"),
        "declaration": first(*declaration),
        # comments that something else parts from the declaration are passed over
        "before": seq(span("comment", rule("comment")), many(rule("annotation")), ahead(rule("declaration"))),
        "passed": first(blank, rule("comment"), rule("annotation")),
        "head": seq(many(seq(ahead(rule("before"), False), rule("passed"))), first(rule("before"), many(rule("annotation")))),
        "function": seq(rule("head"), span("declaration", rule("declaration")), maybe(rule("docstring"))),
    }
    if docstring:
        quoted = first(token(r'[rRuUbB]{0,2}"""(?:[^\\]|\\.)*?(?:"""|\Z)', re.S), token(r"[rRuUbB]{0,2}'''(?:[^\\]|\\.)*?(?:'''|\Z)", re.S), token(r'[rRuU]?"(?:[^"\\\n]|\\.)*"'), token(r"[rRuU]?'(?:[^'\\\n]|\\.)*'"))
        g["docstring"] = seq(token(r"\s*"), span("docstring", quoted))
    else:
        g["docstring"] = token(r"(?!)")
    return g


def _named(pattern: str) -> Expr:
    return span("name", token(pattern))


_ID = r"[A-Za-z_$][\w$]*"
_S = token(r"[ \t]*")
_GAP = token(r"\s*")
_TYPES = maybe(rule("angle"))
#: What may stand between the parameters and the block.
_RESULT = token(r"[^\n{;=]*(?:=(?!>)[^\n{;]*)?")
_OPEN = token(r"[ \t]*(?:\{|=>|;|\r?\n|\Z)")
_AT = seq(token(r"[ \t]*@[\w.$]+"), maybe(rule("round")), token(_NL))
#: Any line that isn't a comment: for bodies that are cut or begin elsewhere.
_LINE = token(r"[ \t]*[^\s/*#@][^\n{;]*(?:\{|;|=>|\n|\Z)")
_SCRIPT = [
    seq(_S, token(r"(?:(?:export|default|async|declare)[ \t]+)*function\b[ \t]*\*?[ \t]*"), maybe(_named(_ID)), _TYPES, rule("parameters"), _RESULT, _OPEN),
    seq(_S, token(r"(?:(?:export|default|declare)[ \t]+)*(?:const|let|var)[ \t]+"), _named(_ID), token(r"[^\n=]*=[ \t]*(?:async[ \t]+)?"), rule("parameters"), _RESULT, token(r"[ \t]*=>[^\n{]*(?:\{|\n|\Z)")),
    seq(_S, token(r"(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract)[ \t]+)*\*?[ \t]*"), ahead(token(r"(?:if|for|while|switch|return|catch)\b"), False), _named(r"#?" + _ID), _TYPES, rule("parameters"), _RESULT, _OPEN),
    _LINE,
]
_JAVA = [
    seq(_S, token(r"(?:(?:public|private|protected|static|final|abstract|synchronized|default|native|strictfp)[ \t]+)*"), _TYPES, _S, ahead(token(r"(?:if|for|while|switch|return|catch|new|throw|else)\b"), False), token(r"[\w.]+"), _TYPES, token(r"[\[\] \t.]*"), maybe(_named(_ID)), rule("parameters"), _RESULT, _OPEN),
    _LINE,
]
_GO = [
    seq(_S, token(r"func[ \t]*"), maybe(seq(span("receiver", rule("round")), _S)), maybe(_named(_ID)), maybe(rule("square")), rule("parameters"), _S, maybe(rule("round")), _RESULT, _OPEN),
    _LINE,
]
_RUST = [
    seq(_S, token(r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|const|unsafe|default|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+"), _named(_ID), _TYPES, rule("parameters"), _RESULT, _OPEN),
    _LINE,
]
_PYTHON = [
    seq(_S, token(r"(?:async[ \t]+)?def[ \t]+"), _named(r"\w+"), maybe(rule("square")), rule("parameters"), token(r"[^\n:]*(?::|\n|\Z)")),
    token(r"[ \t]*(?:async[ \t]+)?(?:def|class|lambda|struct|trait)\b[^\n(:]*(?:\([^\n]*)?(?::|\n|\Z)"),
]
_SHELL = [
    seq(_S, token(r"(?:function[ \t]+)?"), _named(r"[A-Za-z_][\w\-:]*"), token(r"[ \t]*\([ \t]*\)"), _GAP, token(r"\{|\(|\Z")),
    token(r"[ \t]*[^\s#][^\n{]*(?:\{|\n|\Z)"),
]
_RUBY = [
    seq(_S, token(r"(?:(?:private|public|protected)[ \t]+)?def[ \t]+(?:self\.)?"), _named(r"[A-Za-z_]\w*[?!=]?"), maybe(rule("parameters")), token(r"[^\n]*(?:\n|\Z)")),
    token(r"[ \t]*[^\s#][^\n]*(?:\n|\Z)"),
]
GRAMMARS = {
    "script": _grammar("//", _BLOCK, _AT, _SCRIPT, False),
    "java": _grammar("//", _BLOCK, _AT, _JAVA, False),
    "go": _grammar("//", _BLOCK, None, _GO, False),
    "rust": _grammar("//", _BLOCK, token(r"[ \t]*#!?\[[^\n]*\]" + _NL), _RUST, False),
    "c": _grammar("//", _BLOCK, first(_AT, token(r"[ \t]*#!?\[[^\n]*\]" + _NL)), [*_SCRIPT[:1], *_JAVA], False),
    "python": _grammar("#", None, token(r"[ \t]*@[^\n]*\n"), _PYTHON, True),
    "shell": _grammar("#", None, None, _SHELL, False),
    "ruby": _grammar("#", None, None, _RUBY, False),
}
# The grammar of each language; others are read as C-like.
LANGUAGES = {
    "typescript": "script", "tsx": "script", "javascript": "script", "jsx": "script", "java": "java", "kotlin": "c", "csharp": "c", "go": "go", "rust": "rust", "python": "python",
    "bash": "shell", "shell": "shell", "sh": "shell", "r": "shell", "perl": "shell", "ruby": "ruby", "elixir": "ruby",
}


def parse_head(body: str, language: str) -> tuple[str | None, str, tuple[int, int] | None]:
    """(documentation or None, declaration, offsets of the documentation) of a body."""
    grammar = GRAMMARS[LANGUAGES.get(language.lower(), "c")]
    try:
        spans = Parser(grammar, body).parse("function") or []
    except RecursionError:  # brackets nested deeper than the parser follows
        spans = []
    parts = {name: (a, b) for name, a, b in spans}
    at = parts.get("comment") or parts.get("docstring")
    if "comment" in parts and "docstring" in parts and not informative_text(body[slice(*parts["comment"])], "", ""):
        at = parts["docstring"]
    decl = body[slice(*parts["declaration"])] if "declaration" in parts else body.split("\n", 1)[0]
    return (body[slice(*at)] if at else None), decl, at


# Words that say nothing about a function by themselves.
FILLER = set(
    """a an the of for to and or in on at by as is are be was it its this that these those with from into via given new all any each
function functions method methods func fn def procedure routine callback handler helper helpers util utility constructor ctor getter setter accessor
implementation implements impl class object instance value values variable var param params parameter parameters arg args argument arguments kwargs
return returns returned returning yield yields result results output input type types perform performs do does make makes execute executes run runs
call calls called use uses used using simple main default see also note void none null nil true false undefined todo fixme xxx hack tbd wip
le la les un une des du de et est pour fonction méthode der die das ein eine und für ist funktion methode el los las una para función método""".split()
)
# Names of types.
TYPE_WORDS = set("int integer str string bool boolean float double number char byte long short dict list tuple set map array vec vector option optional result object any unit self promise future error err exception u8 u16 u32 u64 i8 i16 i32 i64 usize f32 f64 bytes iterator iterable generator callable union".split())
# Texts that stand for documentation that isn't there.
PLACEHOLDER = re.compile(
    r"""^\W*(?:todo|fixme|xxx|hack|tbd|tba|tbc|wip|n/?a|none|null|nil|undefined|empty|placeholder|stub|\.+|-+|\?+
    |(?:todo|fixme|xxx|hack|tbd)\s*(?:\([^)]*\))?\s*[:\-]?\s*(?:(?:please\s+)?(?:add|write|fill|update|complete|insert)?\s*(?:in\s+)?(?:the\s+|some\s+|missing\s+)*(?:docs?|docstrings?|documentation|comments?|descriptions?|document(?:\s+(?:this|me|it))?)(?:\s+(?:here|missing|later|needed|me|this(?:\s+\w+)?))*)?
    |(?:please\s+)?(?:document|describe|explain)(?:\s+(?:me|this|it|that))?(?:\s+(?:function|method|later|properly))*
    |(?:add|write|insert|missing|no|needs?|lacks?|without)\s+(?:a\s+|the\s+|some\s+|any\s+|more\s+)?(?:docs?|docstrings?|documentation|comments?|descriptions?)(?:\s+(?:here|later|yet|needed|available|provided|given))*
    |(?:docs?|docstring|documentation|description|comment)\s*(?:missing|needed|pending|to\s+come|goes\s+here|here|tbd|todo|to\s+be\s+written|coming\s+soon)
    |(?:auto-?generated|generated)\s+(?:method|function|constructor|docs?|documentation|comment)?\s*(?:stub)?
    |\(?non-javadoc\)?|lorem\s+ipsum.*|see\s+above|see\s+below|same\s+as\s+above|ditto|self[- ]explanatory|(?:noch\s+)?(?:zu\s+)?dokument(?:ieren|ation\s+fehlt)|à\s+(?:documenter|compléter)|por\s+documentar|pendiente(?:\s+de\s+documentar)?|待补充|待完善|无|暂无|未記入|なし|後で書く)\W*$""",
    re.I | re.X,
)
# Instructions to tools.
DIRECTIVE = re.compile(
    r"""^\W*(?:eslint\b|tslint\b|jshint\b|jslint\b|jscs\b|standard-|prettier-ignore|biome-ignore|@ts-|ts-(?:ignore|expect-error|nocheck)|istanbul\b|c8\s+ignore|v8\s+ignore|webpackchunkname|sourcemappingurl|@?flow\b(?!\s+\w+\s+\w+)|nolint|lint:|go:\w+|\+build\b|export_test|pylint:|noqa\b|type:\s*ignore|mypy:|pyright:|pragma\b|flake8|isort:|fmt:\s*(?:on|off|skip)|yapf:|black:|nosec\b|bandit:|coverage:|shellcheck\b|rubocop:|sorbet|rustfmt|clippy|allow\(|checkstyle|nopmd|nosonar|suppress|spotless|noinspection|clang-(?:format|tidy)|cspell|spell-?checker|@formatter|codespell|sonar|region\b|endregion\b|vim:|-\*-|!/|usr/bin|language=|@jsx\b|use\s+strict|@internal\b|@private\b|@public\b|@override\b|@inheritdoc\b|\{@inheritdoc\}|@hidden\b|@ignore\b|@generated\b)""",
    re.I | re.X,
)
LICENCE = re.compile(r"spdx-license|licen[sc]ed?\s+under|copyright\b|\(c\)\s*\d{4}|©|all\s+rights\s+reserved|(?:apache|mit|bsd|gpl|mozilla)[- ](?:public\s+)?licen[sc]e|permission\s+is\s+hereby|without\s+warranty|licen[sc]e\s*:", re.I)
CODE = re.compile(
    r"""^(?:(?:const|let|var|return|yield|await|async|if|elif|else|for|while|switch|match|import|from|export|def|func|fn|pub|defer|try|catch|except|assert|echo|raise|throw|throws|new|delete|print|final|static|private|public|protected|self\.|this\.)\b.*(?:[({=;\[].*[)}\];"'$\w]|[;{}])$
    |[\w.$\[\]'"]+(?:\s*,\s*[\w.$\[\]]+)*\s*(?::=|\+=|-=|\*=|/=|\|=|=)(?!=)\s*\S.*
    |[\w.$:&!]+\((?:[^()]|\([^()]*\))*\)[\w.()?]*[;,]?$
    |.*[;{}]$|^[)}\]]+[;,]?$|\[\s+-\w\s.*\]|.*=>\s*[{(\w].*[;,})]$|.*\)\s*(?:&&|\|\|)\s*\w+.*\(.*
    |(?:let|mut)\s+\w+.*=.*|(?:return|yield|await|del|goto|throw|raise)\s+!?[\w$]+(?:(?:\.|::|->)[\w$]+)+(?:\(.*\))?;?|(?:break|continue|pass))$""",
    re.X,
)
TAG = re.compile(r"^\s*(?:[@\\](?P<at>[a-zA-Z]\w*)|:(?P<sphinx>param|parameter|arg|argument|key|type|return|returns|rtype|raise|raises|var|yields?)\b(?P<of>[^:]*):|-\s+(?P<dash>\w+)\s*:)\s*(?P<rest>.*)$", re.S)
SECTION = re.compile(r"^\s*(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|attributes?|examples?|notes?|see\s+also|keyword\s+args?|kwargs|receives|warnings?|warns|methods|references|todo)\s*:?\s*$", re.I)
#: Tags that are followed by a name.
NAMED = {"param", "parameter", "arg", "argument", "property", "prop", "template", "tparam", "typeparam", "var", "key"}
#: Tags whose rest is a reference or a value and no description.
REFERENCE = {"see", "link", "seealso", "author", "since", "version", "type", "typedef", "module", "category", "group", "memberof", "extends", "implements", "augments", "ticket", "issue", "copyright", "license", "name", "function", "method", "class", "constructor", "override", "inheritdoc", "package", "file", "date", "async", "public", "private", "protected", "static", "abstract", "readonly", "final", "internal", "rtype"}
_REF = re.compile(r"\{@\w+[^}]*\}|<see\s[^>]*/>|https?://\S+|\[\[?[^\]]*\]\]?\([^)]*\)|</?\w+[^>]*>|#\d+\b|\bsee\s*:?\s+[`\w.#]+(?:\(\))?\.?\s*$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def stem(word: str) -> str:
    """A rough stem: inflected forms of a verb or noun meet."""
    w = word.lower()
    for end, least in (("ies", 4), ("ying", 6), ("ied", 5), ("ing", 6), ("ers", 6), ("ed", 5), ("er", 5), ("es", 4), ("or", 6), ("ation", 8), ("ion", 6), ("s", 3), ("e", 4), ("y", 4)):
        if w.endswith(end) and len(w) > least:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w.rstrip("ei") if len(w) > 3 else w


def known_words(*texts: str) -> set[str]:
    """Stems of the words of names and signatures, parts of compound names included."""
    out = set()
    for text in texts:
        for token_ in re.findall(r"\w+", text or ""):
            out.add(stem(token_))
            for part in _PARTS.findall(token_):
                out.add(stem(part))
            out.add(stem(re.sub(r"[\d_]+", "", token_)))
    return out


_DELIMITERS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\w)|//+!?|#+|;+|--+(?=\s)|<!--|\"\"\"|'''|r\"\"\"|\{-|\(\*)|(?:\*+/|-->|\"\"\"|'''|-\}|\*\))\s*$")


def clean_lines(comment: str) -> list[str]:
    """The lines without comment signs."""
    out = []
    for line in comment.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        before = None
        while before != line:
            before = line
            line = _DELIMITERS.sub("", line)
        out.append(line.strip())
    return out


def _line(pattern: re.Pattern, anywhere: bool = False) -> Expr:
    """A whole line that the pattern fits."""
    fits = pattern.search if anywhere else pattern.match

    def run(p: Parser, at: int) -> int:
        end = p.text.find("\n", at)
        end = len(p.text) if end < 0 else end
        return end if fits(p.text[at:end]) else -1

    return run


#: The grammar of a documentation, wherever it stands: the first kind that fits a line is its kind.
DOCUMENTATION = {
    "text": seq(many(seq(rule("line"), token(r"\n"))), rule("line")),
    "line": first(
        span("blank", _line(re.compile(r"[\W_]*$"))),
        span("said nothing", first(_line(DIRECTIVE), _line(LICENCE, True), _line(PLACEHOLDER), _line(SECTION), _line(CODE))),
        span("tag", _line(TAG)),
        span("prose", token(r"[^\n]*")),
    ),
}


def description(comment: str, names: list[str] | None = None) -> list[str]:
    """The parts of a comment that may describe: text and descriptions of tags, without all that says nothing.

    `names` gets the parameters that tags and argument lists name.
    """
    names = [] if names is None else names
    text = "\n".join(clean_lines(comment))
    if PLACEHOLDER.match(text.replace("\n", " ").strip()):
        return []
    out, reference = [], False
    for kind, a, b in Parser(DOCUMENTATION, text).parse("text") or []:
        line = text[a:b]
        if kind == "blank":
            reference = False
            continue
        if kind == "said nothing":
            continue
        if kind == "tag":
            tag = TAG.match(line)
            name = (tag["at"] or tag["sphinx"] or "param").lower()
            rest = tag["rest"]
            reference = name in REFERENCE
            if reference:
                continue
            rest = re.sub(r"^\s*\{[^}]*\}", "", rest)
            if name in NAMED and tag["at"]:
                m = re.match(r"^\s*\[?([\w.$]+)(?:=[^\]]*)?\]?\s*[-:]*", rest)
                if m:
                    names.append(m[1])
                    rest = rest[m.end() :]
            elif tag["of"] or tag["dash"]:
                names.append(tag["of"] or tag["dash"])
            elif name in ("throws", "exception", "raises", "raise"):
                rest = re.sub(r"^\s*[A-Z]\w*(?:Error|Exception)\b", "", rest)
            line = rest
        elif reference:
            continue
        else:
            line = re.sub(r"^\s*(?:args?|returns?|yields?|raises?)\s*:\s*", "", line, flags=re.I)
            m = re.match(r"^\s*\*{0,2}(\w+)\s*(?:\([^)]*\))?\s*:\s+(?=\S)", line)
            if m and ("_" in m[1] or m[1].islower() or re.search(r"[a-z][A-Z]", m[1])):  # `name: text` of an argument list
                names.append(m[1])
                line = line[m.end() :]
        line = _REF.sub(" ", line)
        if line.strip() and not PLACEHOLDER.match(line):
            out.append(line)
    return out


def informative_text(comment: str, name: str, declaration: str, least: int = 2) -> bool:
    """Whether a comment says at least `least` things that the declaration doesn't."""
    names: list[str] = []
    parts = description(comment, names)
    known = known_words(name, declaration, *names) | {stem(w) for w in TYPE_WORDS}
    said = set()
    for part in parts:
        wide = _WIDE.findall(part)
        if len(wide) >= 4:
            return True
        for word in _WORD.findall(part):
            w = word.lower()
            if len(w) < 2 or w in FILLER or w in TYPE_WORDS:
                continue
            s = stem(w)
            if s in known or w in known or (re.search(r"[a-z][A-Z]", word) and all(stem(x) in known for x in _PARTS.findall(word))):
                continue
            said.add(s)
            if len(said) >= least:
                return True
    return False


def _signature_head(signature: str, language: str) -> str:
    """The declaration of a signature that may hold comments and body text."""
    return parse_head(signature, language)[1]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = {k: [] for k in ("id", "description", "code", "doc_start", "doc_end", "real")}
        cols = [batch.column(c).to_pylist() for c in ("id", "name", "language", "signature", "doc_comment", "body")]
        for id_, name, language, signature, doc, body in zip(*cols):
            at = None
            decl = _signature_head(signature, language or "") if signature else ""
            code = body or signature or ""
            if not (doc and doc.strip()):
                doc, parsed, at = parse_head(body, language or "") if body else (None, "", None)
                decl = decl or parsed
            elif not decl and body:
                decl = parse_head(body, language or "")[1]
            kept["id"].append(id_)
            kept["description"].append(doc)
            kept["code"].append(code)
            kept["doc_start"].append(at[0] if at else None)
            kept["doc_end"].append(at[1] if at else None)
            kept["real"].append(bool(doc) and informative_text(doc, name or "", decl))
        yield pa.RecordBatch.from_pydict(kept, pa.schema([("id", pa.string()), ("description", pa.string()), ("code", pa.string()), ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("real", pa.bool_())]))


def documentation(nodes: DataFrame) -> DataFrame:
    """One row per node row of a function or method: (id, description, code, doc_start, doc_end, real)."""
    functions = nodes.where(F.lower("type").isin("function", "method") & F.col("id").isNotNull())
    return functions.select("id", "name", "language", "signature", "doc_comment", "body").mapInArrow(_pairs, "id string, description string, code string, doc_start int, doc_end int, real boolean")


def documented(nodes: DataFrame) -> DataFrame:
    """(id): functions and methods with real documentation."""
    return documentation(nodes).where("real").select("id").distinct()


def pairs(nodes: DataFrame) -> DataFrame:
    """(id, description, code) of each documented function: one row per id, the least text of its rows."""
    return documentation(nodes).where("real").groupBy("id").agg(F.min(F.struct("description", "code")).alias("p")).select("id", "p.description", "p.code")
