"""What the extractor knows of each language: comments, definitions, imports, inheritance, and how a block ends.

A definition is (kind, pattern): the pattern is searched line by line in text whose comments and literals are blank, and
its group is the name. A function inside a container is a method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_ID = r"([A-Za-z_$][\w$]*)"
_W = r"([A-Za-z_]\w*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|partial|readonly|inline|suspend|data|lateinit|companion|const|extern|unsafe|new|synchronized|native|default|fileprivate|mutating|required|convenience|weak|lazy|implicit|case|external|factory|operator|infix|tailrec|strictfp|transient|volatile|export|declare)\s+)*"
_GENERIC = r"(?:<[^>(){}]*>)?"
_ARGS = r"\((?:[^(){};]|\([^(){};]*\))*\)"


@dataclass
class Language:
    definitions: list[tuple[str, str]]
    imports: str = r"(?!)"
    #: groups: child, then for each kind of reference a list of names.
    inherits: list[tuple[str, str]] = field(default_factory=list)
    line_comment: str = "//"
    block_comment: str | None = r"/\*.*?\*/"
    quotes: str = "\"'`"
    #: brace, end, indent or paren
    block: str = "brace"
    exported: str | None = None
    private: str | None = None
    types: str | None = r"[:>]\s*([A-Z]\w*)|<\s*([A-Z]\w*)|\bnew\s+([A-Z]\w*)|(?:^|[(,;{]|\b(?:final|static|private|public|protected|const|readonly)\s)\s*([A-Z]\w*)(?:<[^>(){};]*>)?[\[\]?*&\s]+[a-z_]\w*\s*[=;,)(:]"
    opens: str = ""


_JS = Language(
    [
        ("class", rf"\bclass\s+{_ID}"), ("interface", rf"\binterface\s+{_ID}"), ("enum", rf"\benum\s+{_ID}"), ("type_alias", rf"\btype\s+{_ID}\s*(?:<[^=]*>)?\s*="), ("function", rf"\bfunction\s*\*?\s*{_ID}"),
        ("function", rf"\b(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"), ("variable", rf"\b(?:const|let|var)\s+{_ID}"),
        ("method", rf"^\s+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*{_ID}\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?::\s*[^{{;]+)?\{{"),
    ],
    r"""import\s+(?:type\s+)?(?:(?P<names>[\w$*{}\s,]+?)\s+from\s+)?["'](?P<a>[^"']+)["']|(?:^|[^\w.])require\(\s*["'](?P<b>[^"']+)["']\s*\)|export\s+(?P<reexported>\*|\{[^}]*\})\s+from\s+["'](?P<c>[^"']+)["']""",
    [("extends", rf"\b(?:class|interface)\s+{_ID}[^{{\n]*?\bextends\s+([\w$.,<>\s]+?)\s*(?:\bimplements\b|\{{)"), ("implements", rf"\bclass\s+{_ID}[^{{\n]*?\bimplements\s+([\w$.,<>\s]+?)\s*\{{")],
    exported=r"\bexport\b",
)
_JVM = [("extends", rf"\b(?:class|interface)\s+{_W}[^{{\n]*?\bextends\s+([\w.,<>\s]+?)\s*(?:\bimplements\b|\{{)"), ("implements", rf"\b(?:class|enum|record)\s+{_W}[^{{\n]*?\bimplements\s+([\w.,<>\s]+?)\s*\{{")]
_COLON = [("extends", rf"\b(?:class|struct|interface|protocol|actor|record)\s+{_W}[^:{{\n]*:\s*(?:public\s+|private\s+|protected\s+|virtual\s+)*([\w.,<>()\s:]+?)\s*(?:\bwhere\b|\{{|$)")]
_C_FUNCTION = ("function", rf"^[ \t]*(?!(?:return|else|if|while|for|switch|case|typedef|struct|enum|union|new|delete|throw)\b)[A-Za-z_][\w \t*&<>,:]*?[ \t*&]{_W}\s*{_ARGS}\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{{")

# The languages.
LANGUAGES: dict[str, Language] = {
    "typescript": _JS, "tsx": _JS, "javascript": _JS, "jsx": _JS,
    "java": Language([("class", rf"\b(?:class|record)\s+{_W}"), ("interface", rf"\binterface\s+{_W}"), ("enum", rf"\benum\s+{_W}"), ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?!return|else|new|throw)[\w<>\[\], ?.]+\s+{_W}\s*{_ARGS}\s*(?:throws [\w, .]+)?\{{")], r"^import\s+(?:static\s+)?(?P<a>[\w.*]+);", _JVM, exported=r"\bpublic\b"),
    "go": Language([("method", rf"^func\s+\([^)]*\)\s*{_W}"), ("function", rf"^func\s+{_W}"), ("class", rf"^type\s+{_W}\s+struct"), ("interface", rf"^type\s+{_W}\s+interface"), ("type_alias", rf"^type\s+{_W}\s+\w"), ("variable", rf"^(?:var|const)\s+{_W}")], r'^import\s+(?:\w+\s+)?"(?P<a>[^"]+)"|^\s+(?:\w+\s+)?"(?P<b>[\w./\-]+)"$', exported=r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)[A-Z]", types=r"[\s*\]]([A-Z]\w*)\s*[,){]"),
    "rust": Language([("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_W}"), ("class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_W}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_W}"), ("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_W}"), ("type_alias", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+{_W}"), ("variable", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:static|const)\s+{_W}\s*:")], r"^\s*use\s+(?P<a>[\w:]+)", [("implements", rf"^\s*impl(?:<[^>]*>)?\s+(?P<parent>\w+)(?:<[^>]*>)?\s+for\s+(?P<child>\w+)")], exported=r"\bpub\b", types=r"(?::|->)\s*&?(?:mut\s+)?([A-Z]\w*)|<\s*&?([A-Z]\w*)", quotes="\""),
    "c": Language([_C_FUNCTION, ("class", rf"^\s*(?:typedef\s+)?(?:struct|union)\s+{_W}\s*\{{"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+{_W}\s*\{{"), ("type_alias", rf"^\s*typedef\b[^;{{]*?\b{_W}\s*;"), ("type_alias", rf"^\}}\s*{_W}\s*;")], r'^\s*#\s*include\s*[<"](?P<a>[^>"]+)[>"]', private=r"\bstatic\b"),
    "cpp": Language([_C_FUNCTION, ("class", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+{_W}\s*(?:final\s*)?[:{{]"), ("enum", rf"^\s*enum\s+(?:class\s+|struct\s+)?{_W}"), ("type_alias", rf"^\s*(?:using\s+{_W}\s*=)"), ("type_alias", rf"^\s*typedef\b[^;{{]*?\b{_W}\s*;"), ("method", rf"^[\w:<>*&\s]*?\b[A-Za-z_]\w*::~?{_W}\s*{_ARGS}[^;{{]*\{{"), ("method", rf"^\s+~?{_W}\s*{_ARGS}\s*(?::[^;{{]*)?\{{")], r'^\s*#\s*include\s*[<"](?P<a>[^>"]+)[>"]', _COLON, private=r"\bstatic\b"),
    "csharp": Language([("class", rf"^\s*{_MODS}(?:class|struct|record)\s+{_W}"), ("interface", rf"^\s*{_MODS}interface\s+{_W}"), ("enum", rf"^\s*{_MODS}enum\s+{_W}"), ("method", rf"^\s+{_MODS}(?!return|else|new|throw|await|using)[\w<>\[\],.? ]+\s+{_W}\s*{_GENERIC}{_ARGS}\s*(?:where[^{{]*)?(?:\{{|=>|$)")], r"^\s*using\s+(?:static\s+)?(?P<a>[\w.]+)\s*;", _COLON, exported=r"\bpublic\b"),
    "php": Language([("class", rf"^\s*{_MODS}(?:class|trait)\s+{_W}"), ("interface", rf"^\s*interface\s+{_W}"), ("enum", rf"^\s*enum\s+{_W}"), ("function", rf"^\s*{_MODS}function\s+&?{_W}"), ("variable", rf"^\s*{_MODS}const\s+{_W}\s*=")], r"^\s*use\s+(?P<a>[\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<b>[^'\"]+)", _JVM, line_comment=r"//|#(?!\[)", private=r"\b(?:private|protected)\b"),
    "kotlin": Language([("class", rf"^\s*{_MODS}(?:class|object)\s+{_W}"), ("interface", rf"^\s*{_MODS}(?:fun\s+)?interface\s+{_W}"), ("enum", rf"^\s*{_MODS}enum\s+class\s+{_W}"), ("type_alias", rf"^\s*{_MODS}typealias\s+{_W}"), ("function", rf"^\s*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>.?]+\.)?{_W}\s*\("), ("variable", rf"^{_MODS}va[lr]\s+{_W}")], r"^import\s+(?P<a>[\w.*]+)", [("extends", rf"\b(?:class|interface|object)\s+{_W}[^:{{\n]*?(?:\([^)]*\))?\s*:\s*([\w.,<>()\s]+?)\s*(?:\{{|$)")], private=r"\b(?:private|internal|protected)\b"),
    "swift": Language([("class", rf"^\s*{_MODS}(?:class|struct|actor)\s+(?!func\b|var\b){_W}"), ("interface", rf"^\s*{_MODS}protocol\s+{_W}"), ("enum", rf"^\s*{_MODS}(?:indirect\s+)?enum\s+{_W}"), ("type_alias", rf"^\s*{_MODS}typealias\s+{_W}"), ("function", rf"^\s*{_MODS}(?:class\s+)?func\s+{_W}"), ("variable", rf"^{_MODS}(?:let|var)\s+{_W}")], r"^\s*import\s+(?:class\s+|struct\s+|func\s+)?(?P<a>[\w.]+)", _COLON, private=r"\b(?:private|fileprivate)\b"),
    "scala": Language([("class", rf"^\s*{_MODS}(?:class|object)\s+{_W}"), ("interface", rf"^\s*{_MODS}trait\s+{_W}"), ("enum", rf"^\s*enum\s+{_W}"), ("type_alias", rf"^\s*{_MODS}type\s+{_W}"), ("function", rf"^\s*{_MODS}def\s+{_W}"), ("variable", rf"^\s*{_MODS}va[lr]\s+{_W}")], r"^\s*import\s+(?P<a>[\w.]+)", [("extends", rf"\b(?:class|object|trait)\s+{_W}[^{{\n]*?\bextends\s+([\w.]+)")], private=r"\b(?:private|protected)\b"),
    "dart": Language([("class", rf"^\s*{_MODS}(?:class|mixin|extension)\s+{_W}"), ("enum", rf"^\s*enum\s+{_W}"), ("type_alias", rf"^\s*typedef\s+{_W}"), ("function", rf"^\s*{_MODS}(?!return|else|new|throw|await)[\w<>?\[\], ]+\s+{_W}\s*{_ARGS}\s*(?:async\*?\s*)?(?:\{{|=>)")], r"""^\s*import\s+['"](?P<a>[^'"]+)""", _JVM),
    "groovy": Language([("class", rf"^\s*{_MODS}class\s+{_W}"), ("interface", rf"^\s*{_MODS}(?:interface|trait)\s+{_W}"), ("enum", rf"^\s*{_MODS}enum\s+{_W}"), ("function", rf"^\s*{_MODS}(?:def|void|[A-Z]\w*)\s+{_W}\s*{_ARGS}\s*\{{")], r"^import\s+(?:static\s+)?(?P<a>[\w.*]+)", _JVM, private=r"\bprivate\b"),
    "zig": Language([("function", rf"^\s*(?:pub\s+|export\s+|inline\s+)*fn\s+{_W}"), ("class", rf"^\s*(?:pub\s+)?const\s+{_W}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)"), ("enum", rf"^\s*(?:pub\s+)?const\s+{_W}\s*=\s*enum"), ("variable", rf"^(?:pub\s+)?(?:const|var)\s+{_W}")], r'@import\("(?P<a>[^"]+)"\)', exported=r"\bpub\b", block_comment=None, quotes="\""),
    "bash": Language([("function", r"^\s*(?:function\s+)?([A-Za-z_][\w\-]*)\s*\(\)"), ("function", r"^\s*function\s+([A-Za-z_][\w\-]*)"), ("variable", rf"^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?{_W}=")], r"^\s*(?:source|\.)\s+(?P<a>[^\s;]+)", line_comment=r"(?<![$\w{])#", block_comment=None, types=None),
    "powershell": Language([("function", r"(?i)^\s*function\s+([A-Za-z_][\w\-:]*)"), ("class", rf"(?i)^\s*class\s+{_W}"), ("enum", rf"(?i)^\s*enum\s+{_W}")], r"(?i)^\s*(?:Import-Module|using\s+module)\s+(?P<a>[\w.\-/\\]+)", line_comment="#", block_comment=r"<#.*?#>", types=None),
    "r": Language([("function", r"^\s*([A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\b"), ("variable", r"^([A-Za-z.][\w.]*)\s*<-")], r"^\s*(?:library|require)\(\s*[\"']?(?P<a>[\w.]+)", line_comment="#", block_comment=None, types=None),
    "ruby": Language([("class", rf"^\s*(?:class|module)\s+(?:\w+::)*{_W}"), ("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("variable", r"^\s*([A-Z][A-Z0-9_]+)\s*=[^=]")], r"^\s*require(?:_relative)?\s+['\"](?P<a>[^'\"]+)", [("extends", rf"^\s*class\s+{_W}\s*<\s*([\w:]+)")], line_comment="#", block_comment=r"^=begin\b.*?^=end\b", block="end", opens=r"^\s*(?:class|module|def|if|unless|while|until|for|case|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$", types=None),
    "lua": Language([("function", r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?([A-Za-z_]\w*)"), ("function", rf"^\s*(?:local\s+)?(?:[\w.]+\.)?{_W}\s*=\s*function\b"), ("variable", rf"^local\s+{_W}\s*=")], r"""require\s*\(?\s*["'](?P<a>[^"']+)""", line_comment="--", block_comment=r"--\[\[.*?\]\]", block="end", opens=r"\bfunction\b|^\s*(?:if|for|while)\b|^\s*do\b", private=r"\blocal\b", types=None),
    "elixir": Language([("class", r"^\s*defmodule\s+(?:\w+\.)*([A-Z]\w*)"), ("interface", r"^\s*defprotocol\s+(?:\w+\.)*([A-Z]\w*)"), ("function", r"^\s*defp?(?:macro)?\s+([a-z_]\w*[?!]?)")], r"^\s*(?:import|alias|use|require)\s+(?P<a>[\w.]+)", line_comment="#", block_comment=None, block="end", opens=r"\bdo\s*$|\bfn\b(?!.*\bend\b)", private=r"\bdefp\b", types=None),
    "fortran": Language([("class", rf"(?i)^\s*(?:module(?!\s+procedure)|type(?:\s*,[^:]*)?(?:\s*::)?)\s+{_W}"), ("function", rf"(?i)^(?![ \t]*end)[\w \t()=,*]*\b(?:function|subroutine|program)[ \t]+{_W}")], r"(?i)^\s*use\s+(?P<a>\w+)", line_comment="!", block_comment=None, block="end", opens=r"(?i)^(?!\s*end).*\b(?:function|subroutine|program)\s+\w|(?i:^\s*(?:module\s+\w|type(?:\s*,[^:]*)?(?:\s*::)?\s+\w|do\b))|(?i:\bthen\s*$)", types=None),
    "verilog": Language([("class", rf"^\s*(?:module|interface|class|package)\s+{_W}"), ("function", rf"^\s*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)*{_W}\s*[;(]")], r'^\s*`include\s+"(?P<a>[^"]+)"', block="end", opens=r"\b(?:module|interface|class|package|function|task|begin|case)\b", types=None, quotes="\""),
    "haskell": Language([("function", r"^([a-z_][\w']*)\s*::"), ("class", r"^(?:data|newtype)\s+(?:\([^)]*\)\s*=>\s*)?([A-Z]\w*)"), ("interface", r"^class\s+(?:[^=\n]*=>\s*)?([A-Z]\w*)"), ("type_alias", r"^type\s+(?:family\s+)?([A-Z]\w*)")], r"^import\s+(?:qualified\s+)?(?P<a>[\w.]+)", line_comment="--", block_comment=r"\{-.*?-\}", block="indent", types=None, quotes="\""),
    "elm": Language([("function", r"^([a-z]\w*)\s*:"), ("type_alias", r"^type\s+alias\s+([A-Z]\w*)"), ("enum", r"^type\s+(?!alias\b)([A-Z]\w*)")], r"^import\s+(?P<a>[\w.]+)", line_comment="--", block_comment=r"\{-.*?-\}", block="indent", types=None, quotes="\""),
    "ocaml": Language([("class", r"^\s*module\s+(?:type\s+)?([A-Z]\w*)"), ("type_alias", r"^\s*type\s+(?:'\w+\s+|\([^)]*\)\s*)?([a-z_]\w*)"), ("function", r"^\s*let\s+(?:rec\s+)?([a-z_]\w*)\s+[^=\n]"), ("variable", r"^let\s+([a-z_]\w*)\s*=")], r"^\s*open\s+(?P<a>[\w.]+)", line_comment="(?!)", block_comment=r"\(\*.*?\*\)", block="indent", types=None, quotes="\""),
    "nix": Language([("function", r"^\s*([A-Za-z_][\w\-']*)\s*=\s*\w+\s*:"), ("variable", r"^\s{0,4}([A-Za-z_][\w\-']*)\s*=[^=]")], r"\bimport\s+(?P<a>[./\w<>\-]+)", line_comment="#", block="indent", types=None, quotes="\""),
    "clojure": Language([("function", r"\(defn-?\s+(?:\^\S+\s+)*([^\s()\[\]{}]+)"), ("function", r"\(defmacro\s+([^\s()\[\]{}]+)"), ("interface", r"\(defprotocol\s+([^\s()\[\]{}]+)"), ("class", r"\(def(?:record|type)\s+([^\s()\[\]{}]+)"), ("variable", r"\(def\s+(?:\^\S+\s+)*([^\s()\[\]{}]+)")], r"\(:?require\s+'?\[(?P<a>[\w.\-]+)", line_comment=";", block_comment=None, block="paren", private=r"\(defn-", types=None, quotes="\""),
    "erlang": Language([("function", r"^([a-z]\w*)\([^.]*?\)\s*(?:when\b[^>]*)?->"), ("class", r"^-record\(\s*([a-z]\w*)"), ("type_alias", r"^-type\s+([a-z]\w*)")], r"^-(?:include|include_lib)\(\"(?P<a>[^\"]+)|^-import\((?P<b>\w+)", line_comment="%", block_comment=None, block="indent", types=None, quotes="\""),
    # read by its own parser where that can; this is for files with syntax errors
    "python": Language([("class", rf"^\s*class\s+{_W}"), ("function", rf"^\s*(?:async\s+)?def\s+{_W}"), ("variable", rf"^{_W}\s*(?::[^=]+)?=[^=]")], r"^\s*import\s+(?P<a>[\w.]+)|^\s*from\s+(?P<b>[\w.]+)\s+import\s+(?P<names>[\w, *()]+)", [("extends", rf"^\s*class\s+{_W}\s*\(([\w.,\s]+)\)")], line_comment="#", block_comment=r'"""(?:[^\\]|\\.)*?"""' + r"|'''(?:[^\\]|\\.)*?'''", quotes="\"'", block="indent", private=r"(?:class|def)\s+_", types=r"(?::|->)\s*([A-Z]\w*)"),
}

# Names of types that languages and their libraries bring along; references to them aren't edges.
BUILTIN_TYPES = set(
    """Any AnyObject Array ArrayList Bool Boolean Box Byte Callable Char Character Class Collection Comparable Date Decimal Dict Dictionary Double Enum Error Exception File Float Func Function Future Generic
    HashMap HashSet Hashtable Int Int8 Int16 Int32 Int64 Integer Iterable Iterator IEnumerable List Long Map Math Mutex Never Nothing Null Number Object Option Optional Pair Partial Pick Predicate Promise Protocol
    Rc ReadonlyArray Record RegExp Required Result Runnable RuntimeException Self Sequence Set Short Some String Str Supplier Symbol Task Thread Throwable Tuple Type TypeVar UInt Uint8Array Union Unit Vec Vector Void
    Arc BigInt BigDecimal BigInteger Consumer Err FnMut FnOnce Instant LinkedList Literal Mapping None Ok Omit Optional Override Queue Stack StringBuilder TreeMap UUID WeakMap""".split()
)


def blank_out(text: str, language: Language) -> str:
    """The text with comments and the insides of literals as blanks; places stay."""
    parts = []
    if language.block_comment:
        parts.append(f"(?P<block>{language.block_comment})")
    parts.append(f"(?P<line>(?:{language.line_comment})[^\n]*)")
    for q in language.quotes:
        parts.append(rf"{q}(?:[^{q}\\]|\\.)*{q}" if q == "`" else rf"{q}(?:[^{q}\\\n]|\\.)*{q}")

    def blank(m: re.Match) -> str:
        s = m.group()
        if m.lastgroup in ("block", "line"):
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]

    return re.sub("|".join(parts), blank, text, flags=re.S | re.M)


def block_end(code: str, start: int, head_end: int, language: Language) -> int:
    """Where the block of a definition ends that begins at `start` and whose head ends at `head_end`."""
    line = code.find("\n", head_end)
    line = len(code) if line < 0 else line
    if language.block == "brace":
        opened, stop = code.find("{", head_end - 1), code.find(";", head_end)
        if opened < 0 or (0 <= stop < opened) or opened > line + 200 or _NEXT.search(code, line, opened):
            return line
        return _matching(code, opened, "{", "}")
    if language.block == "paren":
        opened = code.rfind("(", 0, head_end)
        return _matching(code, opened, "(", ")") if opened >= 0 else line
    first = code.rfind("\n", 0, start) + 1
    if language.block == "end":
        depth, at = 0, first
        for m in re.finditer(r"[^\n]*(?:\n|\Z)", code[first:]):
            row = m.group()
            depth += len(re.findall(language.opens, row))
            depth -= len(re.findall(r"(?i)\bend(?:\w*)\b", row))
            at = first + m.end()
            if depth <= 0 or not row:
                break
        return max(line, min(at, len(code)))
    indent = len(code[first:start]) - len(code[first:start].lstrip()) if code[first:start].strip() else len(code[first:start])
    end = line
    for m in re.finditer(r"[^\n]*(?:\n|\Z)", code[line + 1 :]):
        row = m.group()
        if row.strip():
            if len(row) - len(row.lstrip()) <= indent:
                break
            end = line + 1 + m.start() + len(row.rstrip())
        if not row:
            break
    return end


#: A definition that begins on a later line, before any brace: the one before it has no block.
_NEXT = re.compile(r"\n[ \t]*(?:[a-z]+[ \t]+)*(?:fun|func|function|fn|def|class|interface|object|trait|struct|enum|protocol|val|var|let|const|type|import)\b")


def _matching(code: str, at: int, open_: str, close: str) -> int:
    depth = 0
    for m in re.compile(f"[{re.escape(open_ + close)}]").finditer(code, at):
        depth += 1 if m.group() == open_ else -1
        if depth == 0:
            return m.end()
    return len(code)
