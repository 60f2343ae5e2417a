"""Tables that other implementations of the same queries have too, spelled out in their natural order."""

from __future__ import annotations

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "auth": "authentication",
    "cfg": "configuration",
    "config": "configuration",
    "db": "database",
    "req": "request",
    "res": "response",
    "resp": "response",
    "msg": "message",
    "err": "error",
    "ctx": "context",
    "fn": "function",
    "func": "function",
    "impl": "implementation",
    "init": "initialize",
    "param": "parameter",
    "params": "parameters",
    "str": "string",
    "int": "integer",
    "btn": "button",
    "nav": "navigation",
    "doc": "document",
    "docs": "documents",
    "env": "environment",
    "util": "utility",
    "utils": "utilities",
    "src": "source",
    "dest": "destination",
    "dst": "destination",
    "dir": "directory",
    "tmp": "temporary",
    "temp": "temporary",
    "pkg": "package",
    "lib": "library",
    "obj": "object",
    "arg": "argument",
    "args": "arguments",
    "val": "value",
    "prev": "previous",
    "cur": "current",
    "idx": "index",
    "len": "length",
    "num": "number",
    "max": "maximum",
    "min": "minimum",
    "avg": "average",
    "calc": "calculate",
    "del": "delete",
    "fmt": "format",
    "gen": "generate",
    "info": "information",
    "opt": "option",
    "opts": "options",
    "ref": "reference",
    "refs": "references",
    "repo": "repository",
    "spec": "specification",
    "sync": "synchronize",
    "async": "asynchronous",
}

# Groups of words that stand for each other.
SYNONYMS = [
    ["remove", "delete", "destroy", "drop"],
    ["create", "new", "init", "make", "build"],
    ["error", "exception", "fault", "failure"],
    ["get", "fetch", "retrieve", "find", "lookup"],
    ["set", "update", "put", "assign"],
    ["send", "emit", "dispatch", "publish"],
    ["receive", "consume", "subscribe", "listen"],
    ["start", "begin", "launch", "run"],
    ["stop", "end", "halt", "terminate", "shutdown"],
    ["show", "display", "render", "present"],
    ["hide", "conceal", "collapse"],
    ["load", "read", "open", "parse"],
    ["save", "write", "store", "persist", "flush"],
    ["check", "validate", "verify", "test", "assert"],
    ["convert", "transform", "map", "translate"],
    ["list", "array", "collection", "vec"],
    ["handle", "process", "execute"],
    ["connect", "attach", "bind", "link"],
    ["disconnect", "detach", "unbind", "unlink"],
    ["enable", "activate", "on"],
    ["disable", "deactivate", "off"],
]

# Words of questions.
QUESTION_WORDS = [
    "the",
    "a",
    "an",
    "how",
    "what",
    "which",
    "where",
    "when",
    "why",
    "who",
    "find",
    "get",
    "all",
    "that",
    "this",
    "with",
    "from",
    "for",
    "into",
    "does",
    "show",
    "list",
    "is",
    "are",
    "can",
    "should",
    "function",
    "method",
    "class",
    "file",
    "functions",
    "methods",
    "classes",
    "files",
]

# Sources of input per language, as (language, kind, patterns).
SOURCES = [
    ("python", "user_input", ["request.args", "request.form", "request.data", "request.json", "request.values", "request.cookies", "request.headers", "request.GET", "request.POST", "request.COOKIES", "request.META"]),
    ("python", "command_args", ["input(", "sys.argv", "sys.stdin"]),
    ("python", "environment", ["os.environ", "os.getenv("]),
    ("python", "file_read", ["open(", ".read(", "read_to_string"]),
    ("javascript", "user_input", ["req.query", "req.body", "req.params", "req.cookies", "req.headers", "request.query", "request.body", "request.params"]),
    ("typescript", "user_input", ["req.query", "req.body", "req.params", "req.cookies", "req.headers"]),
    ("javascript", "environment", ["process.argv", "process.env"]),
    ("javascript", "file_read", ["fs.readFile", "fs.readFileSync", "readFile("]),
    ("go", "user_input", ["r.URL.Query", "r.FormValue(", "r.PostFormValue(", "r.Header.Get(", "r.Body"]),
    ("go", "environment", ["os.Getenv(", "os.Args"]),
    ("java", "user_input", ["getParameter(", "getParameterValues(", "getInputStream(", "getReader(", "getHeader(", "getCookies(", "getQueryString("]),
    ("kotlin", "user_input", ["getParameter(", "getParameterValues("]),
    ("php", "user_input", ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_SERVER", "$_FILES"]),
    ("php", "file_read", ["file_get_contents(", "fread(", "fgets("]),
    ("ruby", "user_input", ["params[", "request.params", "request.body"]),
    ("rust", "user_input", ["web::Query", "web::Form", "web::Json", "web::Path"]),
    ("rust", "environment", ["std::env::var(", "env::var("]),
    ("c", "user_input", ["scanf(", "gets(", "fgets(", "getenv("]),
    ("cpp", "user_input", ["std::cin", "getline(", "getenv("]),
]

# Sinks per language, as (language, kind, patterns).
SINKS = [
    ("python", "sql_query", ["cursor.execute(", ".execute(", "raw(", "extra("]),
    ("javascript", "sql_query", [".query(", ".execute(", "knex.raw("]),
    ("java", "sql_query", ["executeQuery(", "executeUpdate(", "execute(", "createQuery(", "createNativeQuery("]),
    ("php", "sql_query", ["mysql_query(", "mysqli_query(", "->query("]),
    ("go", "sql_query", ["db.Query(", "db.Exec(", "db.QueryRow("]),
    ("python", "command_exec", ["os.system(", "subprocess.call(", "subprocess.run(", "subprocess.Popen(", "os.popen("]),
    ("javascript", "command_exec", ["child_process.exec(", "child_process.execSync(", "execSync(", "exec("]),
    ("php", "command_exec", ["exec(", "system(", "passthru(", "shell_exec(", "popen("]),
    ("ruby", "command_exec", ["system(", "`", "exec(", "IO.popen("]),
    ("javascript", "html_output", ["innerHTML", "document.write(", "dangerouslySetInnerHTML"]),
    ("python", "html_output", ["Markup(", "render_template_string("]),
    ("python", "file_path", ["open(", "os.path.join("]),
    ("javascript", "file_path", ["fs.readFile(", "fs.writeFile(", "path.join("]),
    ("python", "code_eval", ["eval(", "exec("]),
    ("javascript", "code_eval", ["eval(", "Function("]),
    ("php", "code_eval", ["eval(", "assert("]),
    ("python", "deserialization", ["pickle.loads(", "pickle.load(", "yaml.load("]),
    ("java", "deserialization", ["readObject(", "ObjectInputStream("]),
    ("php", "deserialization", ["unserialize("]),
]

# What makes a value safe for a kind of sink.
SANITIZERS = {
    "sql_query": ["parameterized", "prepared", "sanitize", "escape", "quote", "bind", "placeholder", "%s", "?"],
    "command_exec": ["shlex.quote", "escapeshellarg", "shellescape"],
    "html_output": ["escape(", "html.escape", "cgi.escape", "bleach.clean", "DOMPurify.sanitize", "encodeURIComponent", "escapeHtml", "sanitize", "strip_tags"],
    "file_path": ["realpath", "abspath", "canonicalize", "normalize", "basename", "secure_filename"],
    "code_eval": ["ast.literal_eval", "json.loads", "JSON.parse"],
}
