"""Symbols and imports of a TypeScript or JavaScript text, by a pushdown scan.

The scan reads a text once, token by token. Strings, comments, regular expressions, the texts of templates and those between tags are
single tokens of any length (patterns run without giving back, so their time is linear); brackets, `${` and tags push a frame, and
what closes them pops it. A declaration belongs to the frame that it begins in and ends with the bracket or statement that ends it, so its last line
is exact whatever its strings and templates hold. Bodies of functions, methods, interfaces and, in TypeScript, of constants are hidden: nothing
in them is a symbol. Those of blocks, namespaces and function expressions are not.
"""

from __future__ import annotations

import re
from bisect import bisect_left

_TOKEN = re.compile(
    r"""(?P<blank>[\s﻿]++)|(?P<comment>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)|(?P<string>"(?:[^"\\\n]++|\\[\s\S])*+"?|'(?:[^'\\\n]++|\\[\s\S])*+'?)"""
    r"""|(?P<word>[#]?[A-Za-z_$\u0080-\U0010ffff][\w$]*+)|(?P<number>[0-9][\w.]*+)|(?P<mark>=>|\.\.\.|\+\+|--|[^\w\s])"""
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+")
_TAG = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*+|(?=>))(?!\s*(?:,|extends\b))")
_IN_TAG = re.compile(r"""[^"'{}/>]++|"[^"]*+"?|'[^']*+'?|/>|.""", re.S)
_DECLARED = re.compile(r"(?:(?P<f>function)\s*\*?\s*|(?P<c>class|interface)\s+|(?P<t>type)\s+)(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$]*+)(?P<is>\s*[=<])?")
_REQUIRE = re.compile(r"""require\s*\(\s*(["'`])([^"'`\n]*+)\1""")
_FROM = re.compile(r"""import\b(?:\s+type\b(?!\s*(?:,|from\b)))?(?P<clause>[^"'`;()={}\n]*+(?:\{[^"'`;()={}]*+\}[^"'`;()={}\n]*+)?+)\s*+(?P<quote>["'])(?P<path>[^"'\n]*+)(?P=quote)""")
_ENUM = re.compile(r"\s+enum\b")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof yield await else do default export extends".split())
_GOES_ON = frozenset("in of instanceof as satisfies extends is implements from".split())
_BLOCK_WORDS = frozenset("else do try finally".split())
_TYPE_MARKS = frozenset(": | & => < , = extends keyof is ?".split())
_PREFIXES = frozenset("export default declare async abstract".split())
_MODIFIERS = frozenset("public private protected static async override readonly get set declare abstract accessor".split())


class _Frame:
    """What an open bracket encloses. ends: the declaration that ends with it; pending, since: the declaration under way in it, and how far it is."""

    __slots__ = ("open", "at", "hidden", "owner", "object", "ends", "pending", "state", "member", "word")

    def __init__(self, open_: str, at: int, hidden: bool = False, owner: str | None = None, is_object: bool = False, ends: dict | None = None, word: str = ""):
        self.open, self.at, self.hidden, self.owner, self.object, self.ends, self.word = open_, at, hidden, owner, is_object, ends, word
        self.pending: dict | None = None
        self.member: dict | None = None


class _Scan:
    def __init__(self, text: str, typed: bool, tags: bool):
        self.text, self.typed, self.tags = text, typed, tags
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.symbols: list[tuple] = []
        self.imports: list[tuple] = []
        self.stack = [_Frame("", 0)]
        self.curly = 0  # open braces and templates' values
        self.prev, self.value, self.last, self.newline = "", False, 0, False  # the token before, whether it ends a value, where it ended
        self.comment: str | None = None
        self.start: tuple[int, str | None, bool] | None = None  # of a statement with prefixes: place, comment, exported

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    # ---- symbols ----

    def emit(self, d: dict, end: int) -> None:
        kind, name = d["kind"], d["name"]
        signature = {"function": f"function {name}()", "constant": f"const {name} = () => ...", "method": f"{d.get('short')}()"}.get(kind, f"{kind} {name}")
        self.symbols.append((name, "function" if kind == "constant" else kind, self.line(d["at"]), self.line(end), signature, d["doc"], d["exported"]))

    def finish(self, frame: _Frame, end: int) -> None:
        """The declaration under way in a frame ends, with its statement, at `end`."""
        d, frame.pending = frame.pending, None
        if d and d["kind"] == "type":
            self.emit(d, end)
        elif d and d["kind"] == "constant":
            self.settle(d)
            for name in d["functions"]:
                self.emit({**d, "name": name}, end)

    @staticmethod
    def settle(d: dict) -> None:
        """A declarator ends: it counts if its value is a function and nothing else."""
        if d["state"] in ("body", "called") and d["called"] and d["name"]:
            d["functions"].append(d["name"])

    # ---- tokens ----

    def begins(self, frame: _Frame) -> bool:
        """Whether a statement can begin here."""
        if frame.open not in ("", "{") or frame.object or (frame.owner and frame.member):
            return False
        return self.prev in ("", ";", "{", "}", ")", "else", "do") or self.prev in _PREFIXES or (self.newline and self.value)

    def wants_value(self) -> bool:
        return not self.value

    def declared(self, frame: _Frame, word: str, at: int) -> bool:
        """Begins a declaration, if the word at this place does; says whether the scan goes on behind its name."""
        if word in _PREFIXES and self.prev not in (".", "?."):
            if self.start is None:
                self.start = at, self.comment, word == "export"
            return False
        begin = self.start or (at, self.comment, False)
        where = {"at": at if self.prev in _PREFIXES and begin[2] else begin[0], "doc": documented(begin[1]), "exported": begin[2]}
        if word in ("const", "let", "var"):
            if not _ENUM.match(self.text, at + len(word)):
                arrows = not (self.typed and word == "var")
                frame.pending = {"kind": "constant", **where, "functions": [], "state": "name", "name": None, "called": False, "from": at + len(word), "angle": 0, "arrows": arrows}
            return False
        m = _DECLARED.match(self.text, at)
        if not m or (m["t"] and not m["is"]) or ((m["t"] or m["c"] == "interface") and not self.typed) or (m["c"] and m["name"] in ("extends", "implements")):
            return False
        kind = "function" if m["f"] else m["c"] or "type"
        frame.pending = {"kind": kind, **where, "name": m["name"], "state": "head"}
        self.step(m.end("name"), m["name"], True)
        return True

    def step(self, end: int, token: str, value: bool) -> None:
        self.at, self.last, self.prev, self.value, self.newline, self.comment = end, end, token, value, False, None
        if token not in _PREFIXES:
            self.start = None

    def word(self, word: str, at: int, end: int) -> None:
        frame = self.stack[-1]
        self.ended(frame, word, True)
        property_ = self.prev in (".", "?.")
        if frame.owner is not None and not property_:
            self.in_member(frame, word, at)
        elif not frame.hidden and not property_:
            if self.begins(frame) and self.declared(frame, word, at):
                return
            if word == "class" and not self.begins(frame) and (m := _DECLARED.match(self.text, at)) and m["name"] not in ("extends", "implements"):
                self.step(m.end("name"), m["name"], True)  # a class in a place of a value
                self.stack[-1].word = ""
                self.held_class = {"kind": "class", "name": m["name"], "at": at, "doc": None, "exported": False}
                return
            if word == "import" and (m := _FROM.match(self.text, at)) and self.begins(frame):
                path = m["path"]
                for name in names_of(m["clause"]) or [path]:
                    self.imports.append((name, path, path.startswith(".")))
                return self.step(m.end(), "import", True)
        d = frame.pending
        if d and d["kind"] == "constant" and not property_:
            self.in_constant(d, word, at)
        self.step(end, word, word not in _BEFORE_VALUE)

    def in_constant(self, d: dict, token: str, at: int) -> None:
        """A token of a declaration of constants, at its own level."""
        state = d["state"]
        if state == "name" and token == "=":
            left = self.text[d["from"] : at].strip()
            d["name"] = left if re.fullmatch(r"[\w$\u0080-\U0010ffff]+", left) else None
            d["left"], d["state"] = left, "value"
        elif state == "name" and token == ":":
            left = self.text[d["from"] : at].strip()
            d["name"], d["left"], d["state"] = left if re.fullmatch(r"[\w$\u0080-\U0010ffff]+", left) else None, left, "type"
        elif state == "type" and token == "=":
            d["state"] = "value"
        elif token == "," and state != "angle":
            if state != "type":
                self.settle(d)
                d.update(state="name", name=None, called=False)
                d["from"] = at + 1
        elif state == "value":
            if not self.typed and token == "require" and (m := _REQUIRE.match(self.text, at)):
                for name in names_of(re.sub(r"=[^,}]*", "", d["left"])) or [d["left"]]:
                    self.imports.append((name, m[2], m[2].startswith(".")))
                d["state"] = "other"
            elif token == "async":
                pass
            elif token == "function":
                d["state"] = "expression"
            elif token == "(":
                d["state"] = "parameters"
            elif token == "<":
                d["state"], d["angle"] = "angle", 1
            elif re.match(r"[\w$\u0080-\U0010ffff]", token) and not token[0].isdigit():
                d["state"] = "single"
            else:
                d["state"] = "other"
        elif state == "angle":
            d["angle"] += (token == "<") - (token == ">")
            if not d["angle"]:
                d["state"] = "value"
        elif state in ("single", "parameters"):
            if token == "=>":
                d.update(state="body", called=d["arrows"])
            elif not (state == "parameters" and token in (")", ":")):
                d["state"] = "returns" if state == "parameters" and self.prev == ":" else "other"
        elif state == "returns" and token == "=>":
            d.update(state="body", called=d["arrows"])
        elif state == "called":  # behind a function expression
            d.update(state="other", called=False)

    def in_member(self, frame: _Frame, token: str, at: int) -> None:
        """A token of a class body, at its own level."""
        m = frame.member
        if m and m["state"] == "decorator":
            if token == "(" or token == "." or self.prev in ("@", "."):
                return
            m = None
        if m and self.newline and (self.value or self.prev == "void") and (token[0] in "[#*@\"'" or token[0].isalnum() or token[0] in "_$") and (m["state"] != "name" or self.prev not in _MODIFIERS):
            m = None
        if token == "@":
            frame.member = {"state": "decorator"}
            return
        if token in (";", ","):
            frame.member = None
            return
        if m is None:
            m = frame.member = {"state": "name", "kind": "method", "at": at, "doc": documented(self.comment), "exported": False, "name": None}
        if m["state"] == "name":
            if token == "(" and m["name"]:
                m["state"] = "parameters"
            elif token == "<":
                m["state"] = "generic"
            elif token in ("=", ":"):
                m["state"] = "field"
            elif token == "]":
                m["name"] = self.text[m["bracket"] : at + 1]
            elif token == "[":
                m["bracket"] = at
            elif token not in ("*", "?", "!", "{", "}", ")"):
                m["name"] = token
        elif m["state"] == "generic" and token == "(":
            m["state"] = "parameters"
        elif m["state"] == "parameters" and token == "=":
            m["state"] = "field"

    def ended(self, frame: _Frame, token: str, word: bool) -> None:
        """Ends the statement under way in a frame before this token, if a line's end does."""
        d = frame.pending
        if not d or not self.newline or not self.value or (word and token in _GOES_ON):
            return
        if not word and token not in ("{", "@", "}"):
            return
        if d["kind"] in ("constant", "type") and d["state"] not in ("name", "value") and not (token == "{" and d["kind"] == "type" and self.prev in _TYPE_MARKS):
            self.finish(frame, self.last - 1)
        elif d["kind"] == "constant" and d["state"] == "name" and word and self.prev not in ("const", "let", "var"):
            self.finish(frame, self.last - 1)
        elif d["kind"] == "function" and word and self.prev in (")", "}", ">", "]"):
            frame.pending = None  # a signature without a body

    # ---- brackets ----

    def push(self, mark: str, at: int) -> None:
        frame = self.stack[-1]
        d, m, new = frame.pending, frame.member if frame.owner is not None else None, _Frame(mark, at, frame.hidden, word=self.prev)
        if mark == "{":
            new.object = not self.value and self.prev not in ("", ";", "{", "}", "=>") and self.prev not in _BLOCK_WORDS
            typed_literal = self.prev in _TYPE_MARKS
            held = getattr(self, "held_class", None)
            if held and not typed_literal and not frame.hidden:
                new.ends, new.owner, new.object, self.held_class = held, held["name"], False, None
            elif d and d["kind"] in ("class", "interface") and not typed_literal:
                new.ends, new.object, frame.pending = d, False, None
                if d["kind"] == "class":
                    new.owner = d["name"]
                else:
                    new.hidden = True
            elif d and d["kind"] == "function" and d["state"] == "parameters" and not typed_literal:
                new.ends, new.hidden, new.object, frame.pending = d, True, False, None
            elif m and m["state"] == "parameters" and not typed_literal:
                new.ends, new.hidden, new.object = {**m, "name": f"{frame.owner}.{m['name']}", "short": m["name"]}, True, False
            elif m and m["state"] == "name":
                frame.member = None  # a static block
        if d and d["kind"] == "function" and mark == "(" and d["state"] == "head":
            d["state"] = "parameters"
        if d and (d["kind"] == "type" or (d["kind"] == "constant" and self.typed)):
            new.hidden = True
        self.stack.append(new)
        self.curly += mark == "{"

    def pop(self, mark: str, at: int) -> None:
        if mark == "}":  # whatever is open within a brace ends with it
            if not self.curly:
                return
            k = len(self.stack) - 1
            while self.stack[k].open not in ("{", "${"):
                k -= 1
            self.curly -= 1
        else:  # a round or square one may close over a few others that were left open, but not over a brace
            k, want = len(self.stack) - 1, "(" if mark == ")" else "["
            least = max(0, k - 8)
            while k > least and self.stack[k].open != want:
                if self.stack[k].open in ("{", "${"):
                    return
                k -= 1
            if k <= least:
                return
        for frame in reversed(self.stack[k:]):
            self.finish(frame, self.last - 1)
        frame = self.stack[k]
        del self.stack[k:]
        above = self.stack[-1]
        if frame.ends:
            self.emit(frame.ends, at)
            if frame.ends["kind"] == "method":
                above.member = None
        if above.pending and above.pending["kind"] == "constant" and above.pending["state"] == "expression" and mark == "}" and not frame.object:
            above.pending.update(state="called", called=True)
        self.closed = frame

    def run(self) -> tuple[list[tuple], list[tuple]]:
        text, end = self.text, len(self.text)
        self.at = 0
        while self.at < end:
            at, frame = self.at, self.stack[-1]
            if frame.open == "`":
                m = _TEMPLATE.match(text, at)
                at = m.end()
                if text.startswith("${", at):
                    self.stack.append(_Frame("${", at, frame.hidden))
                    self.curly += 1
                    self.step(at + 2, "${", False)
                else:
                    self.stack.pop()
                    self.step(min(at + 1, end), "`", True)
                continue
            if frame.open in ("<tag", "<>"):
                self.in_tag(frame, at)
                continue
            m = _TOKEN.match(text, at)
            kind, token = m.lastgroup, m[0]
            if kind == "blank":
                self.newline |= "\n" in token
                self.at = m.end()
            elif kind == "comment":
                self.comment, self.newline, self.at = token, self.newline or "\n" in token, m.end()
            elif kind == "word":
                self.word(token, at, m.end())
            elif kind in ("string", "number"):
                self.ended(frame, token, True)
                if frame.owner is not None:
                    self.in_member(frame, token[:200], at)
                if frame.pending and frame.pending["kind"] == "constant":
                    self.in_constant(frame.pending, token[:1], at)
                self.step(m.end(), "''", True)
            else:
                self.mark(frame, token, at, m.end())
        for frame in reversed(self.stack):
            self.finish(frame, max(0, self.last - 1))
            if frame.ends:
                self.emit(frame.ends, max(0, end - 1))
        return self.symbols, self.imports

    def mark(self, frame: _Frame, token: str, at: int, end: int) -> None:
        if token == "/" and self.wants_value() and (m := _REGEX.match(self.text, at)):
            return self.step(m.end(), "''", True)
        if token == "<" and self.tags and self.wants_value() and (m := _TAG.match(self.text, at)):
            self.stack.append(_Frame("<tag", at, frame.hidden))
            return self.step(m.end(), "<", False)
        if token == "`":
            self.stack.append(_Frame("`", at, frame.hidden))
            if frame.pending and frame.pending["kind"] == "constant":
                self.in_constant(frame.pending, token, at)
            return self.step(end, "`", False)
        self.ended(frame, token, False)
        if token in ")]}":
            self.pop(token, at)
            frame = self.stack[-1]
            if frame.owner is not None and token != "}":
                self.in_member(frame, token, at)
            closed, self.closed = getattr(self, "closed", None), None
            block = token == "}" and closed is not None and not closed.object and closed.open == "{"
            within = (frame.pending and frame.pending["kind"] in ("constant", "type")) or (frame.owner is not None and frame.member)
            return self.step(end, token, not block or bool(within))
        if frame.owner is not None:
            self.in_member(frame, token, at)
        if frame.pending and frame.pending["kind"] == "constant" and token != ";":
            self.in_constant(frame.pending, token, at)
        if token in "([{":
            self.push(token, at)
            return self.step(end, token, False)
        if token == ";" and frame.pending:
            self.finish(frame, at)
            frame.pending = None
        return self.step(end, token, token in ("++", "--") and self.value)

    def in_tag(self, frame: _Frame, at: int) -> None:
        text = self.text
        if frame.open == "<>":
            m = re.compile(r"[^<{]*+").match(text, at)
            at = m.end()
            if text.startswith("</", at):
                close = text.find(">", at)
                self.stack.pop()
                return self.step(close + 1 if close >= 0 else len(text), "''", True)
            if text.startswith("<", at):
                self.stack.append(_Frame("<tag", at, frame.hidden))
                return self.step(at + 1, "<", False)
        else:
            m = _IN_TAG.match(text, at)
            if m[0] == "/>":
                self.stack.pop()
                return self.step(m.end(), "''", True)
            if m[0] == ">":
                frame.open = "<>"
                return self.step(m.end(), ">", False)
            if m[0] != "{":
                return self.step(m.end(), "''", False)
        if text.startswith("{", at):
            self.stack.append(_Frame("{", at, frame.hidden, is_object=True))
            self.curly += 1
            return self.step(at + 1, "{", False)
        return self.step(max(at, self.at + 1), "''", False)


def documented(comment: str | None) -> str | None:
    """The text of a comment."""
    if comment is None:
        return None
    if comment.startswith("//"):
        return comment[2:].strip()
    return "\n".join(x.lstrip("* ").rstrip() for x in comment[2:].removesuffix("*/").strip().splitlines()) if comment.endswith("*/") else None


def names_of(clause: str) -> list[str]:
    """The names that an import's clause or a pattern binds; of a pair, the new one."""
    out = []
    for part in re.sub(r"\bfrom\s*$|[{}\[\]]", " ", clause).split(","):
        name = re.split(r"\bas\b|:", part)[-1].strip().removeprefix("...").removeprefix("type ").strip()
        if name and name != "*":
            out.append(name)
    return out


def parse_script(source: str, typed: bool = True, tags: bool = False) -> tuple[list[tuple], list[tuple], str | None]:
    """Symbols, imports and error of a TypeScript (typed) or JavaScript text; tags: whether elements can stand in place of values."""
    return *_Scan(source, typed, tags).run(), None
