"""Extractors of declarations and uses: text of one file in, staged rows out (see `code.STAGED`).

TypeScript is scanned on a copy of the text in which comments and the insides of strings are blanked, so that braces
can be matched and heads may span lines. Clojure is read into nested forms.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right


class Rows:
    """Collects staged rows of a file; offsets become 1-based lines and columns."""

    def __init__(self, file: str, text: str):
        self.file, self.text, self.rows = file, text, []
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.seen: set[tuple] = set()

    def place(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1

    def add(self, row, kind, name, start=None, end=None, src=None, dst=None, module=None, attrs=None) -> None:
        (a, b), (c, d) = (self.place(start), self.place(end)) if start is not None else ((0, 0), (0, 0))
        self.rows.append((self.file, len(self.rows), row, kind, name, a, b, c, d, src, dst, module, json.dumps(attrs or {}, separators=(",", ":"))))

    def elem(self, kind: str, name: str, start: int, end: int, **attrs) -> None:
        self.add("elem", kind, name, start, end, attrs=attrs)

    def arrow(self, kind: str, src: str, dst: str, module: str | None = None) -> None:
        if (kind, src, dst, module) not in self.seen:
            self.seen.add((kind, src, dst, module))
            self.add("arrow", kind, None, src=src, dst=dst, module=module)


# TypeScript ------------------------------------------------------------------------------------------------------

_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\*\s+as\s+(\w+)\s*)?(?:\{([^}]*)\}\s*)?from\s*['"]([^'"\n]+)['"]""")
_MODIFIERS = r"(?:(?:export|default|declare|abstract|async)\s+)*"
_DECLARATION = re.compile(rf"(?:^|(?<=[;{{}}\n]))[ \t]*{_MODIFIERS}(?:(function)\s*\*?\s*(\w+)|(class)\s+(\w+)|(interface)\s+(\w+)|(enum)\s+(\w+)|(type)\s+(\w+)(?=\s*(?:<[^=]*>)?\s*=)|(namespace)\s+(\w+))", re.M)
_BOUND = re.compile(rf"(?:^|(?<=[;{{}}\n]))[ \t]*{_MODIFIERS}(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+)?=>|\w+\s*=>)", re.M)
_CONSTANT = re.compile(rf"^{_MODIFIERS}const\s+(\w+)\s*(?::[^=;]+)?=(?!>)", re.M)
_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|override|async|readonly|get|set)\s+)*\*?#?(\w+)\s*(?:<[^>{]*>)?\(", re.M)
_ARROW_FIELD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*(\w+)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=;{\n]+)?=>", re.M)
_FIELD = re.compile(r"^[ \t]*((?:(?:public|private|protected|static|declare|override)\s+)*)(readonly\s+)?(\w+)\s*([?!])?\s*:\s*", re.M)
_PARAMETER = re.compile(r"(?:^|,)\s*(?=(?:public|private|protected|readonly)\b)(?:(?:public|private|protected)\s+)?(readonly\s+)?(\w+)(\?)?\s*:\s*([^,=]+)")
_CALL = re.compile(r"(?:(\bnew)\s+|(\bthis)\s*\??\.\s*|(\.)\s*)?([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*\(")
_SELF = re.compile(r"\bthis\.(\w+)(?!\s*(?:<[^<>()]*>)?\s*\()\b(?!\w)")
_THROW = re.compile(r"\bthrow\s+new\s+(\w+)")
_TYPE_NAME = re.compile(r"\b[A-Z]\w*")
_KEYWORDS = frozenset("async if for while switch catch return function typeof await super constructor import in of do else case with yield void delete throw as".split())


def blanked(text: str) -> str:
    """The text with comments and the insides of strings as blanks, of the same length and lines."""

    def blank(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        return inner if s[:2] in ("//", "/*") else s[0] + inner[1:-1] + s[-1]

    return _BLANKED.sub(blank, text)


def matching(code: str, at: int) -> int:
    """Offset behind the bracket that closes the one at `at`; the end of the text if none does."""
    depth, close = 0, {"{": "}", "(": ")", "[": "]"}[code[at]]
    for m in re.compile(rf"[{re.escape(code[at] + close)}]").finditer(code, at):
        depth += 1 if m[0] == code[at] else -1
        if not depth:
            return m.end()
    return len(code)


def _head_end(code: str, at: int) -> tuple[int, int | None]:
    """(end, body): where a declaration that begins at `at` ends and where its braces open, if it has any."""
    i = at
    while i < len(code):
        c = code[i]
        if c in "([":
            i = matching(code, i)
        elif c == "{":
            return matching(code, i), i
        elif c == ";" or c == "\n" and re.match(r"[ \t]*(?:\n|$|\}|export\b|import\b|function\b|class\b|const\b|type\b|interface\b)", code[i + 1 :]):
            return i + (c == ";"), None
        else:
            i += 1
    return len(code), None


def extract_typescript(file: str, text: str) -> list[tuple]:
    """Staged rows of one TypeScript file: 'elem', 'arrow' and 'prop'."""
    out, code = Rows(file, text), blanked(text)
    aliases: dict[str, str] = {}
    scopes: list[tuple[int, int, str, str]] = []  # (start, end, kind, name)
    classes: list[tuple[int, int, int, str, str]] = []  # (body, end, start, kind, name)

    for m in _IMPORT.finditer(text):
        if not code.startswith("import", m.start()):
            continue  # stands in a comment or string
        named = [(p.split(" as ")[-1].strip(), p.split(" as ")[0].strip()) for p in re.sub(r"\btype\s+", "", m[3] or "").split(",") if p.strip()]
        for local, taken in [(x, y) for x, y in ((m[1], "default"), (m[2], "*")) if x] + named:
            aliases[local] = m[4]
            at = m.start() + re.search(rf"(?<![\w$]){re.escape(local)}(?![\w$])", m[0]).start()
            out.elem("import", local, at, at + len(local), module=m[4], importedName=taken)
            out.arrow("importsFrom", local, m[4], m[4])

    for m in _DECLARATION.finditer(code):
        kind, name = next((m[k], m[k + 1]) for k in range(1, 13, 2) if m[k])
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        head = m.end()
        if kind == "type":
            head = code.index("=", head) + 1
        end, body = _head_end(code, head)
        if kind == "function" and body is None:
            end = max(end, head)
        if kind == "type" and body is not None and re.match(r"[ \t]*(?:[|&][^;\n]*)?;", code[end:]):
            end += re.match(r"[ \t]*(?:[|&][^;\n]*)?;", code[end:]).end()
        out.elem(kind, name, start, end)
        if kind in ("function", "class"):
            scopes.append((start, end, kind, name))
        if body is not None and kind in ("class", "interface", "type", "enum"):
            classes.append((body, end, start, kind, name))
        if kind in ("class", "interface"):
            line = re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", code[head : body if body is not None else end])
            for word, names in re.findall(r"\b(extends|implements)\s+([\w\s,.$]+?)(?=\bimplements\b|\bextends\b|$|\{)", line.strip()):
                for t in (x.strip().rsplit(".", 1)[-1] for x in names.split(",")):
                    if t:
                        out.arrow(word, name, t, aliases.get(t))

    bound: set[str] = set()
    for m in _BOUND.finditer(code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end, _ = _head_end(code, m.end())
        bound.add(m[1])
        out.elem("function", m[1], start, end)
        scopes.append((start, end, "function", m[1]))
    for m in _CONSTANT.finditer(code):
        if m[1] not in bound:
            out.elem("const", m[1], m.start(), _head_end(code, m.end())[0])

    for body, end, _, kind, name in classes:
        inside = _top_level(code, body + 1, end - 1)
        if kind == "class":
            for m in _METHOD.finditer(inside):
                if m[1] in _KEYWORDS - {"constructor"}:
                    continue
                at = body + 1 + m.start() + len(m[0]) - len(m[0].lstrip())
                opened = body + 1 + m.end() - 1
                stop, braces = _head_end(code, matching(code, opened))
                if m[1] == "constructor":
                    for p in _PARAMETER.finditer(code[opened + 1 : matching(code, opened) - 1]):
                        _property(out, name, p[2], opened + 1 + p.start(2), p[4], bool(p[3]), bool(p[1]), kind)
                if braces is not None or re.match(r"\s*abstract\b", inside[m.start() :]):
                    out.elem("method", m[1], at, stop)
                    out.arrow("memberOf", m[1], name)
                    scopes.append((at, stop, "method", m[1]))
            for m in _ARROW_FIELD.finditer(inside):
                at = body + 1 + m.start() + len(m[0]) - len(m[0].lstrip())
                stop = _head_end(code, body + 1 + m.end())[0]
                out.elem("method", m[1], at, stop)
                out.arrow("memberOf", m[1], name)
                scopes.append((at, stop, "method", m[1]))
        if kind in ("class", "interface", "type"):
            for m in _FIELD.finditer(inside):
                at = body + 1 + m.end()
                _property(out, name, m[3], body + 1 + m.start(3), text[at : _field_end(code, at)], m[4] == "?", bool(m[2]), kind)

    scopes.sort()

    def around(offset: int, kinds: tuple[str, ...]) -> str | None:
        best = None
        for start, end, kind, name in scopes:
            if start > offset:
                break
            if offset < end and kind in kinds:
                best = name
        return best

    declared = {m.end() for m in _METHOD.finditer(code)} | {m.end() for m in re.finditer(r"\bfunction\s*\*?\s*\w*\s*(?:<[^<>()]*>)?\(", code)}
    for m in _CALL.finditer(code):
        caller = around(m.start(4), ("function", "method"))
        if caller is None or m[4] in _KEYWORDS or m.end() in declared and code[matching(code, m.end() - 1) :].lstrip()[:1] in ("{", ":"):
            continue
        plain = not (m[2] or m[3])
        out.arrow("callerOf", caller, m[4], aliases.get(m[4]) if plain else None)
    for m in _SELF.finditer(code):
        caller, owner = around(m.start(), ("function", "method")), around(m.start(), ("class",))
        if caller and owner:
            out.arrow("references", caller, f"{owner}.{m[1]}")
    for m in _THROW.finditer(code):
        if caller := around(m.start(), ("function", "method")):
            out.arrow("throws", caller, m[1], aliases.get(m[1]))
    return out.rows


def _top_level(code: str, a: int, b: int) -> str:
    """code[a:b] with everything inside brackets blanked."""
    out, i = list(code[a:b]), a
    while i < b:
        if code[i] in "{([":
            j = min(matching(code, i), b)
            for k in range(i + 1, j - 1):
                if code[k] != "\n":
                    out[k - a] = " "
            i = j
        else:
            i += 1
    return "".join(out)


def _field_end(code: str, at: int) -> int:
    while at < len(code) and code[at] not in ";=,\n}":
        at = matching(code, at) if code[at] in "{([" else at + 1
    return at


def _property(out: Rows, owner: str, name: str, at: int, type_text: str, optional: bool, readonly: bool, kind: str) -> None:
    type_text = type_text.strip()
    refs = list(dict.fromkeys(_TYPE_NAME.findall(blanked(type_text))))
    out.add("prop", "property", f"{owner}.{name}", at, at + len(name), src=owner, attrs={"typeText": type_text, "optional": optional, "readonly": readonly, "typeRefs": refs, "parentKind": kind})


# Clojure ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""[\s,]+|;[^\n]*|(~@|\#_|\#\(|\#\{|\#'|\#\?@?|[()\[\]{}'`~^@]|\#"(?:\\.|[^"\\])*"|"(?:\\.|[^"\\])*"|\\\S+|[^\s,()\[\]{}"';]+)""")
_CLOSING = {"(": ")", "[": "]", "{": "}", "#(": ")", "#{": "}"}
_DEFINITIONS = {
    "defn": "function", "defn-": "function", "defmulti": "function", "defmacro": "function", "def": "const", "defonce": "const",
    "defprotocol": "interface", "defrecord": "class", "deftype": "class", "defmethod": "method",
}
_SPECIAL = frozenset("let if when fn do cond loop recur quote and or not if-let when-let for doseq case try catch finally -> ->> ns throw".split())
_REFRAME = {"reg-sub": "subscription", "reg-event-db": "event", "reg-event-fx": "event", "reg-fx": "fx", "reg-cofx": "cofx"}


class Form(list):
    """A bracketed form: its items, its opening bracket and its place."""

    def __init__(self, opening: str, start: int):
        super().__init__()
        self.opening, self.start, self.end = opening, start, start


class Atom(str):
    start: int
    end: int


def read_forms(text: str) -> list:
    """Top-level forms of a Clojure text; what is not closed ends with the text. Reader marks are left out, and so is
    the form behind a #_."""
    top = Form("", 0)
    stack, skip = [top], 0
    for m in _TOKEN.finditer(text):
        t = m[1]
        if t is None:
            continue
        if t in _CLOSING:
            f = Form(t, m.start())
            stack[-1].append(f)
            stack.append(f)
        elif t in (")", "]", "}"):
            if len(stack) > 1:
                stack.pop().end = m.end()
        elif t == "#_":
            skip += 1
            stack[-1].append(Atom("#_"))
            continue
        elif t in ("'", "`", "~", "~@", "^", "@", "#'", "#?", "#?@"):
            continue
        else:
            a = Atom(t)
            a.start, a.end = m.start(), m.end()
            stack[-1].append(a)
    for f in stack[1:]:
        f.end = len(text)

    def cleaned(f: Form) -> Form:
        kept, drop = [], 0
        for x in f:
            if isinstance(x, Atom) and x == "#_":
                drop += 1
            elif drop:
                drop -= 1
            else:
                kept.append(cleaned(x) if isinstance(x, Form) else x)
        f[:] = kept
        return f

    return cleaned(top) if skip else top


def ns_to_suffix(ns: str) -> str:
    """Path suffix of a namespace: dots are folders, dashes underscores."""
    return ns.replace(".", "/").replace("-", "_") + ".clj"


def extract_clojure(file: str, text: str) -> list[tuple]:
    """Staged rows of one Clojure file; calls go through aliases and referred names."""
    out = Rows(file, text)
    alias: dict[str, str] = {}
    refer: dict[str, str] = {}
    symbols: set[str] = set()

    def is_symbol(x) -> bool:
        return isinstance(x, Atom) and not re.match(r"""[:"\d\\#]|#"|[+-]\d""", x) and x not in ("nil", "true", "false", "&")

    def target(sym: str) -> tuple[str, str | None]:
        a, _, n = sym.rpartition("/")
        if a in alias:
            return n, ns_to_suffix(alias[a])
        return (n, ns_to_suffix(refer[sym])) if sym in refer else (sym, None)

    def require(spec) -> None:
        if isinstance(spec, Form) and spec.opening == "[" and spec and is_symbol(spec[0]):
            ns, options = str(spec[0]), dict(zip(map(str, spec[1::2]), spec[2::2]))
            name = str(options.get(":as", ns))
            alias[name] = ns
            out.elem("import", name, spec.start, spec.end, module=ns)
            out.arrow("importsFrom", name, ns_to_suffix(ns), ns_to_suffix(ns))
            for n in options.get(":refer", ()) if isinstance(options.get(":refer"), Form) else ():
                refer[str(n)] = ns
        elif is_symbol(spec):
            alias[str(spec)] = str(spec)
            out.elem("import", str(spec), spec.start, spec.end, module=str(spec))
            out.arrow("importsFrom", str(spec), ns_to_suffix(spec), ns_to_suffix(spec))

    def reframe(sym: str) -> str | None:
        head, _, name = sym.rpartition("/")
        return name if not head or head in ("rf", "re-frame", "re-frame.core") or alias.get(head) == "re-frame.core" else None

    def first_keyword(f) -> Atom | None:
        return next((x for x in f if isinstance(x, Atom) and x.startswith(":")), None) if isinstance(f, Form) else None

    def throws(f, owner: str) -> None:
        for x in f:
            if isinstance(x, Form):
                throws(x, owner)
            elif re.match(r"::?[\w.\-]+/[\w.\-]+$", x):
                if x not in symbols:
                    symbols.add(x)
                    out.elem("symbol", x, x.start, x.end)
                out.arrow("throws", owner, x)

    def uses(f, owner: str) -> None:
        """Calls, dispatches and throws within a body."""
        if not isinstance(f, Form):
            return
        if f.opening in ("(", "#(") and f and is_symbol(f[0]):
            sym = str(f[0])
            name = reframe(sym)
            if sym == "throw":
                throws(f, owner)
            elif name in ("subscribe", "dispatch", "dispatch-sync") and len(f) > 1 and (k := first_keyword(f[1])) is not None:
                out.arrow("callerOf", owner, k)
            elif sym not in _SPECIAL and sym not in _DEFINITIONS:
                out.arrow("callerOf", owner, *target(sym))
        for x in f[1:] if f.opening == "(" and f and is_symbol(f[0]) else f:
            uses(x, owner)

    def references(x, owner: str, head: bool = False) -> None:
        """Symbols in the value of a def that are not called there."""
        if isinstance(x, Form):
            for i, y in enumerate(x):
                references(y, owner, i == 0 and x.opening == "(")
        elif is_symbol(x) and not head and str(x) not in _SPECIAL:
            out.arrow("references", owner, *target(str(x)))

    def definition(f: Form) -> None:
        if len(f) < 2 or not is_symbol(f[0]):
            return
        sym = str(f[0])
        if sym == "ns" and is_symbol(f[1]):
            out.elem("namespace", f[1], f.start, f.end)
            for clause in f[2:]:
                if isinstance(clause, Form) and clause and clause[0] == ":require":
                    for spec in clause[1:]:
                        require(spec)
        elif sym in _DEFINITIONS:
            name = next((x for x in f[1:] if is_symbol(x) and not x.startswith("^")), None)
            if name is None:
                return
            out.elem(_DEFINITIONS[sym], name, f.start, f.end)
            for x in f[2:]:
                if sym in ("def", "defonce"):
                    references(x, name)
                uses(x, name)
        elif (how := _REFRAME.get(reframe(sym) or "")) and isinstance(f[1], Atom) and f[1].startswith(":"):
            out.elem("const", f[1], f.start, f.end, reframe=how)
            for i, x in enumerate(f[2:], 2):
                if f[i - 1] == ":<-" and (k := first_keyword(x)) is not None:
                    out.arrow("callerOf", f[1], k)
                uses(x, f[1])
        elif sym in ("do", "when", "comment"):
            for x in f[1:]:
                if isinstance(x, Form) and sym != "comment":
                    definition(x)

    for form in read_forms(text):
        if isinstance(form, Form):
            definition(form)
    return out.rows
