"""A lexer of comments, strings and nesting for source files, driven by a table for each language.

``code_of`` gives a text of the same length and lines in which comments and what strings of several lines hold are blanks, so
that patterns of lines meet code only. Strings within a line stay, as imports name their paths in them. Within template
strings, code in ``${...}`` is code of the string: it is blanked with it, however deep templates nest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Lexis:
    """``quotes``: one-line strings with escapes; ``long``: (begin, end) of strings over lines without, ``escaped`` with escapes."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested: bool = False
    quotes: str = "\"'"
    long: tuple[tuple[str, str], ...] = ()
    escaped: tuple[tuple[str, str], ...] = ()
    templates: bool = False  # backticks with ${...}
    regexes: bool = False  # literals such as /['"]/
    chars: bool = False  # a single quote begins one character or none (a lifetime, a label)
    more: str | None = None  # a pattern of further strings, taken whole


# The lexical rules of the languages.
SCRIPT = Lexis(templates=True, regexes=True)
RULES = {
    "typescript": SCRIPT, "tsx": SCRIPT, "javascript": SCRIPT, "jsx": SCRIPT,
    "go": Lexis(long=(("`", "`"),)),
    "rust": Lexis(nested=True, quotes="", escaped=(('"', '"'),), chars=True, more=r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)'),
    "java": Lexis(long=(('"""', '"""'),)),
    "kotlin": Lexis(nested=True, long=(('"""', '"""'),)),
    "swift": Lexis(nested=True, quotes='"', long=(('"""', '"""'),)),
    "csharp": Lexis(long=(('"""', '"""'),), more=r'(?:\$@|@\$|@)"(?:[^"]|"")*"'),
    "ruby": Lexis(line=("#",), block=(("\n=begin", "\n=end"),), more=r"<<[~-]?(?P<q>['\"]?)(?P<t>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?^[ \t]*(?P=t)\b"),
    "php": Lexis(line=("//", "#"), escaped=(('"', '"'), ("'", "'")), quotes="", more=r"<<<[ \t]*(?P<q>['\"]?)(?P<t>\w+)(?P=q)\n[\s\S]*?^[ \t]*(?P=t)\b"),
    "c": Lexis(), "cpp": Lexis(more=r'R"(?P<t>[^\s()\\]{0,16})\([\s\S]*?\)(?P=t)"'),
    "elixir": Lexis(line=("#",), block=(), long=(('"""', '"""'), ("'''", "'''"))),
    "zig": Lexis(line=("//", "\\\\"), block=(), chars=True, quotes='"'),
}
OPERAND = re.compile(r"(?:[(,=:\[!&|?{};~+*%<>^-]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|await|yield))\s*\Z|\A\s*\Z")
REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/")
CHAR = re.compile(r"'(?:\\(?:u\{[^}']*\}|x..|.)|[^\\'\n])'")


def _openers(rules: Lexis) -> re.Pattern:
    kinds = {
        "more": rules.more, "block": "|".join(re.escape(a) for a, _ in rules.block), "line": "|".join(map(re.escape, rules.line)), "long": "|".join(re.escape(a) for a, _ in rules.long), "escaped": "|".join(re.escape(a) for a, _ in rules.escaped),
        "quote": f"[{rules.quotes}]" if rules.quotes else "", "template": "`" if rules.templates else "", "regex": "/" if rules.regexes else "", "char": "'" if rules.chars else "",
    }
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in kinds.items() if p), re.MULTILINE)


OPENERS = {language: _openers(rules) for language, rules in RULES.items()}


def _until(text: str, at: int, end: str, escapes: bool) -> int:
    """The place after ``end``, or the text's end."""
    found = re.compile((r"\\[\s\S]|" if escapes else "") + f"(?P<end>{re.escape(end)})")
    while m := found.search(text, at):
        if m["end"]:
            return m.end()
        at = m.end()
    return len(text)


def _nested(text: str, at: int, begin: str, end: str) -> int:
    depth = 1
    for m in re.compile(f"{re.escape(begin)}|{re.escape(end)}").finditer(text, at):
        depth += 1 if m.group() == begin else -1
        if not depth:
            return m.end()
    return len(text)


def _template(text: str, at: int, openers: re.Pattern) -> int:
    """The place after a template whose backtick is before ``at``: a stack of templates and of the braces of their code."""
    stack = [-1]  # -1 in a template, else the open braces of code in it
    inside, code = re.compile(r"\\[\s\S]|`|\$\{"), re.compile(r"[{}`]|//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
    while stack:
        m = (inside if stack[-1] < 0 else code).search(text, at)
        if m is None:
            return len(text)
        at, what = m.end(), m.group()
        if stack[-1] < 0:
            if what == "`":
                stack.pop()
            elif what == "${":
                stack.append(0)
        elif what == "`":
            stack.append(-1)
        elif what == "{":
            stack[-1] += 1
        elif what == "}":
            if stack[-1]:
                stack[-1] -= 1
            else:
                stack.pop()
    return at


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def code_of(language: str, text: str) -> str:
    """The text with comments, and strings of several lines, as blanks."""
    rules, openers = RULES[language], OPENERS[language]
    out, copied, at = [], 0, 0
    while m := openers.search(text, at):
        kind, start = m.lastgroup if m.lastgroup not in ("q", "t", "h") else "more", m.start()
        mark, comment = m.group(), False
        if kind == "line":
            end = text.find("\n", start)
            end, comment = len(text) if end < 0 else end, True
        elif kind == "block":
            close = dict(rules.block)[mark]
            end, comment = _nested(text, m.end(), mark, close) if rules.nested else _until(text, m.end(), close, False), True
        elif kind == "template":
            end = _template(text, m.end(), openers)
        elif kind in ("long", "escaped"):
            end = _until(text, m.end(), dict(rules.long if kind == "long" else rules.escaped)[mark], kind == "escaped")
        elif kind == "quote":
            whole = re.compile(rf"{mark}(?:\\.|[^{mark}\\\n])*{mark}?").match(text, start)
            end = whole.end()
        elif kind == "char":
            one = CHAR.match(text, start)
            end = one.end() if one else m.end()
        elif kind == "regex":
            one = REGEX.match(text, start) if OPERAND.search(text[max(0, start - 40) : start]) else None
            end = one.end() if one else m.end()
        else:
            end = m.end()
        if comment or "\n" in text[start:end]:
            keep = 0 if comment else 1
            out += [text[copied : start + keep], blank(text[start + keep : end - keep]), text[end - keep : end] if keep else ""]
            copied = end
        at = max(end, start + 1)
    return "".join([*out, text[copied:]])


NOT_DECLARED = r"(?!\s*(?:if|for|foreach|while|switch|catch|return|else|throw|new|await|yield|when|match|elsif|elif|unless|until|assert|do)\b|\s*(?:import|const|var|type)\s*\()"  # the last are groups of declarations
BEGINS = re.compile(NOT_DECLARED + r"^\s*(?:[^\s()=;\"'`#/][^()=;\"'`]*[\s*&>.:])?[\w$~?!]+\s*(?:<[^()]*>)?\((?:[^()\"'`]|\([^()]*\))*$|" + NOT_DECLARED + r"^\s*(?:export\s+)?(?:const|let|var)\s+[\w$]+\s*(?::[^=]+)?=\s*(?:async\s+)?\([^()]*$")
CALLBACK = re.compile(r"(?:=>|\bfunction\b[^()]*\([^()]*\)|\bdo\b(?:\s*\|[^|]*\|)?)\s*\{?\s*$")
STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")
LONGEST_HEAD = 60


def head_end(lines: list[str], at: int) -> int:
    """The last line of the declaration that begins at a line and whose parameters go on; the line itself for all else."""
    if not BEGINS.match(lines[at]):
        return at
    depth = 0
    for k in range(at, min(len(lines), at + LONGEST_HEAD)):
        bare = STRINGS.sub('""', lines[k])
        depth += bare.count("(") - bare.count(")")
        if depth <= 0:
            return k
        if CALLBACK.search(bare) or bare.rstrip().endswith(";"):
            return at
    return at
