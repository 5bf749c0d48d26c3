"""Operator 5: secret scans by assignment-aware lexing.

Two layers give spans (code points, end exclusive) in every whole text:

* base: fixed patterns for assigned secrets, access keys and long hexadecimal runs;
* lexed (kind ``literal``): a lexer passes over the text once and parses source and configuration syntax into name-literal
  pairs; constants are propagated (``password = key`` scores the literal that ``key`` was given), and a literal counts
  if its own score times the sensitivity of the names it reaches is at least ``THRESHOLD``.

The lexer knows, for what a name is given: ``name = "x"`` (also ``:=``, ``=>``, ``?=``, ``+=``, ``||=``, ``??=``, over line breaks), ``"name": "x"``,
``name: Type = "x"``, ``name Type = "x"``, ``name[] = "x"``, ``Name { get; set; } = "x"``, ``table["name"] = "x"``, ``$table{name} = "x"``,
``a, name = "y", "x"``, ``call("name", "x")``, ``setName("x")``, ``NAME=x``, ``ENV NAME x``, ``--name x``, ``name == "x"``, ``<name a="b">x</name>`` with
name spaces and CDATA, ``key="name" value="x"``, block scalars and lists of YAML, ``name=x`` within a literal (connection strings,
queries of addresses), and passwords in addresses. For the value: single, double, back and triple quotes with escapes and prefixes,
parts that are added or adjacent, calls (of one literal, nested or not; defaults of look-ups; what a format is filled with), lists, and
alternatives (``a || "x"``, ``c ? "x" : b``, ``a if c else "x"``). Nothing is capped; each character is read a bounded number of times. A value
that is a bare name counts as a constant if the text defines that name, as a literal if it doesn't and the name holds a digit, and as
nothing otherwise; names within a literal (``f"{name}"``, ``${name}``) are constants too. A constant means the last definition before it
within the open braces around it (local names end with their function), else the first one after it.

A literal is rated by its length, the entropy and kinds of its characters. It is a placeholder, and rated 0, if a word such as ``example`` or
``none`` stands in it alone and such words make up half of its letters, if one character makes up half of it, or if little of it is left
without its insertions (``${x}``); the rule is the same at every length. A literal with spaces is a passphrase if it has four words, or mostly
words with digits or signs, and none of the words that messages are made of.

Lexed spans never remove base spans; one that a base span covers whole is not added.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned alike; names that are
assigned in a circle are each followed once; other columns pass through, and on a clash the added column gets a
trailing underscore.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_text

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns and the least lengths of what they find.
BASE_NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(_any_case, BASE_NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: How strongly a part of a target name speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "auth": 0.7,
    "bearer": 0.8, "signingkey": 0.9, "encryptionkey": 0.9, "salt": 0.6,
}
# Words that stand for a value to come, words that go with them, and words of messages (no passphrase has them).
PLACEHOLDERS = {"example", "changeme", "placeholder", "your", "yours", "dummy", "todo", "tbd", "none", "null", "nil", "undefined", "true", "false", "redacted", "omitted"}
BESIDE = {"a", "an", "the", "my", "here", "goes", "insert", "enter", "replace", "with", "this", "value", "user", "name", "password", "passwd", "secret", "token", "key", "api", "access", "default", "sample", "test", "string"}
MESSAGES = BESIDE | {
    "and", "are", "be", "by", "can", "cannot", "create", "email", "error", "expired", "failed", "field", "for", "forgot", "has", "have", "if", "in", "invalid", "is", "it", "link", "login", "missing", "must",
    "new", "no", "not", "of", "old", "on", "or", "our", "please", "required", "reset", "should", "sign", "to", "use", "was", "will", "wrong", "you", "your",
}
INSERTED = re.compile(r"[$#]?\{\{?[^{}]*+\}\}?|%\([^()]*+\)s|%s|\$\([^()]*+\)|<[^<>]*+>")
LETTERS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Pieces of syntax, matched where the lexer stands; possessive repeats, so each is linear.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.\-][A-Za-z0-9_]++)*+"
_GAP = r"(?:[\x20\t\r\n]|\\\r?\n)*+"
_TYPE = r"(?:\[\w*+\]|[*&])*+(?:const[\x20\t]++)?(?:string|String|str|char|byte|bytes|Bytes|text|Text|TEXT|varchar|VARCHAR|NSString|wchar_t|SecureString)\b(?:[*&?!]|\[\w*+\])*+[\x20\t]*+"
_PROPERTY = rf"{_GAP}\{{[\x20\t]*+(?:[a-z]++[\x20\t;]++)++\}}{_GAP}"
_FOLLOWS = rf"""["'`]?{_GAP}(?:[=:?+|!]|&&=|//=)|["'`]{_GAP}[\],]|["']?\}}[\x20\t]*+(?:=|\|\|=)|\[\w*+\]{_GAP}=|[\x20\t]++{_TYPE}=|{_PROPERTY}=|\({_GAP}["'`]"""
EVENT = re.compile(
    rf"""(?<![A-Za-z0-9_])(?:(?<!,)(?<!,\x20)(?P<many>{_NAME}(?:,\x20?{_NAME})++)(?=[\x20\t]*+:?=(?![=~>]))"""
    rf"""|(?P<name>(?:def|func|function|fn|sub)(?=\x20)|{_NAME}(?={_FOLLOWS}))|(?:(?<=\nENV\x20)|(?<=\nARG\x20)|(?<=setenv\x20)|(?<=--))(?P<spaced>{_NAME})(?=[\x20\t]++[^\s=\-]))|[{{}}<]"""
)
NAME, PATH = re.compile(_NAME), re.compile(rf"{_NAME}(?:(?:::|->){_NAME})*+")
TAG, BODY = re.compile(rf"<(?P<tag>{_NAME}(?::{_NAME})?)(?:\s[^<>]*+)?>\s*+"), re.compile(r"[^<]++")
GAP, BLANKS = re.compile(_GAP), re.compile(r"[\x20\t]*+")
_GENERIC = r"(?:<[^<>=\n]*+(?:<[^<>=\n]*+>[^<>=\n]*+)*+>)?(?:\[[^\[\]\n]*+\])?[?!]?"
ANNOTATED = re.compile(rf":[\x20\t]*+(?:[&*?]|'[a-z]++[\x20\t])*+(?:mut[\x20\t]++)?[A-Za-z_][A-Za-z0-9_.:]*+{_GENERIC}[\x20\t]*+=(?![=>~])")
TYPED, PROPERTY, INDEXED = re.compile(rf"[\x20\t]++{_TYPE}=(?![=>~])"), re.compile(rf"{_PROPERTY}=(?![=>~])"), re.compile(rf"\[\w*+\]{_GAP}=(?![=>~])")
GIVES = re.compile(r"=>|:=|(?:\|\||\?\?|&&|//|[?+])=|!==?|={2,3}|=(?![=~>])|:(?![:/])")
COMPARED = {"==", "===", "!=", "!=="}
SETTER = re.compile(r"(?:set|with|use|put)_?(?=[A-Z_a-z])")
#: Calls whose first literal is a key or a form, and whose further ones are what they may give.
GETTERS = re.compile(r"(?i)(?:^|_)(?:get|getenv|env|getproperty|getordefault|getstring|fetch|lookup|setdefault|pop|default|coalesce|nvl|ifnull|format|sprintf|printf)$")
_SINGLE = "|".join(rf"""{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+{q}""" for q in "\"'")
_TRIPLE = "|".join(rf"""{q}{{3}}[^{q}\\]*+(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*+)*+{q}{{3}}""" for q in "\"'")
QUOTED = re.compile(rf"(?P<prefix>[rRbBfFuUlL@$]{{0,2}})(?:(?P<triple>{_TRIPLE})|{_SINGLE}|`[^`]*+`)")
BARE = re.compile(r"[A-Za-z0-9+/_.=\-!@#$%^&*]++")
BLOCK = re.compile(r"[|>][+\-0-9]*+[\x20\t]*+(?:\#[^\n]*+)?\r?\n")
LINE = re.compile(r"([\x20\t]*+)([^\n]*+)\n?")
NEXT_WITHIN, NEXT = re.compile(r"[\x20\t\r\n]*+(?:\\\r?\n[\x20\t\r\n]*+)*+"), re.compile(r"[\x20\t]*+(?:\\\r?\n[\x20\t]*+)*+")
ADDED = re.compile(r"\+(?![+=])|\.(?=[\x20\t]*+[\"'`])")
OTHERWISE = re.compile(r"\|\|(?!=)|\?\?(?!=)|&&(?!=)|%(?![=\w])|={2,3}|!==?|(?:or|and|not|new|await|in|is)\b")
CALLED, METHOD, MEMBER = re.compile(r"[\x20\t]*+!?\("), re.compile(r"\.([A-Za-z_]\w*+)\("), re.compile(r"\??\.[A-Za-z_]\w*+")
ITEMS, ITEM = re.compile(r"[\x20\t]*+(?:\#[^\n]*+)?\r?\n(?=[\x20\t]*+-[\x20\t])"), re.compile(r"[\x20\t]*+-[\x20\t]++")
LINE_ENDS = re.compile(r"[\x20\t]*+(?:\#[^\n]*+)?(?:\r?\n|$)")
WITHIN = re.compile(rf"""(?<![A-Za-z0-9_])(?P<name>{_NAME})\x20?=\x20?(?P<value>[^\s;&,"'`=]++)""")
NAMED_IN, NAMED_IN_FORM = re.compile(rf"[$#]\{{\x20?({_NAME})"), re.compile(rf"(?<!\{{)\{{\x20?({_NAME})")
#: A password in an address: what stands between the user and the host.
ADDRESS = re.compile(r"""://[^\s:/@"'`<>]*+:(?P<value>[^\s@/"'`<>]++)@""")
#: Words that open a function, and names whose literal names the ``value`` that follows.
FUNCTIONS, NAMING, VALUES = {"def", "func", "function", "fn", "sub"}, {"key", "name", "id"}, {"value", "val", "content", "default"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches: leftmost and non-overlapping for each kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """Sensitivity of a target name: the best of its parts (split at case changes and separators), singly and in pairs."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    both = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *both]), default=0.0)


def is_placeholder(value: str) -> bool:
    """Whether a literal only holds the place of a value: by its words, its commonest character, or what is left without insertions."""
    if len(INSERTED.sub("", value)) < 6:
        return True
    if max(Counter(value).values()) * 2 >= len(value):
        return True
    words = [w.lower() for run in re.findall("[A-Za-z]+", value) for w in ([run] if run.lower() in PLACEHOLDERS else LETTERS.findall(run))]
    alone = {run.lower() for run in re.findall("[A-Za-z]+", value)}
    return not PLACEHOLDERS.isdisjoint(alone) and 2 * sum(len(w) for w in words if w in PLACEHOLDERS or w in BESIDE) >= sum(map(len, words))


def is_message(value: str) -> bool:
    """Whether a literal with spaces is no passphrase."""
    words = value.split()
    odd = sum(not w.isalpha() for w in words)
    return any(w.lower().strip(".,:;!?") in MESSAGES for w in words) or (len(words) < 4 and 2 * odd < len(words))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, entropy and kinds of its characters, no placeholder and no message."""
    n = len(value)
    if n < 6 or is_placeholder(value) or (" " in value and is_message(value)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, n / 12) * min(1.0, entropy / 3) * (0.4 if classes == 1 else 1.0)


class _Lexer:
    """One pass over a text: literals, and definitions that hold literals and other definitions."""

    def __init__(self, text: str):
        self.text = text
        self.literals: list[tuple[int, int, str]] = []
        #: Each definition: target name, its literals, the definitions that it uses.
        self.made: list[tuple[str, list[int], list[int]]] = []
        #: The definitions of each name that are in sight, the last one last; by open brace, the names set there with their line's indent.
        self.sight: dict[str, list[int]] = {}
        self.scopes: list[list[tuple[str, int]]] = [[]]
        #: How far lines are known, and where the last one begins.
        self.known, self.line = 0, 0
        self.first: dict[str, list[int]] = {}
        #: Uses that no earlier definition answers: (definition, name, the literal it is otherwise).
        self.open: list[tuple[int, str, int | None]] = []
        #: Where the next CDATA section ends (None: none does).
        self.cdata: int | None = -1

    def run(self) -> None:
        text, at, named = self.text, 0, None
        while m := EVENT.search(text, at):
            name, at = m["name"] or m["spaced"], m.end()
            if m["many"]:
                at = self.several(m["many"], m.start(), at)
                continue
            if name is None:
                named = None
                if m[0] == "{":
                    self.scopes.append([])
                elif m[0] == "}":
                    self.close()
                else:
                    at = self.tag(m.start()) or at
                continue
            if name in FUNCTIONS:
                self.leave(m.start())
                continue
            value = self.given(name, m.start(), at, bool(m["spaced"]))
            if value is None:
                continue
            place, target, literals, uses, at = value
            if place == "==":
                self.define(target, literals, uses, m.start(), False)
                continue
            target = named if named and name.lower() in VALUES else target
            if name.lower() in NAMING and len(literals) + len(uses) == 1:
                named = self.literals[literals[0]][2] if literals else uses[0][0]
            if place == "+=":
                uses.append((target, None))
            self.define(target, literals, uses, m.start())

    def close(self) -> None:
        if len(self.scopes) > 1:
            for gone, _ in self.scopes.pop():
                self.sight[gone].pop()

    def several(self, many: str, start: int, at: int) -> int:
        """``a, b = x, y``: each name is given what stands at its place."""
        after = BLANKS.match(self.text, at).end()
        found, end = self.expression(after + (2 if self.text[after] == ":" else 1), True)
        values: list[list] = [[]]
        for entry in found:
            if entry is None:
                values.append([])
            else:
                values[-1].append(entry)
        names = NAME.findall(many)
        for name, value in zip(names, values) if len(names) == len(values) else ():
            self.define(name, *self.kept(value), start)
        return max(end, at)

    def tag(self, start: int) -> int | None:
        """An element with a body of text: where it ends."""
        text, m = self.text, TAG.match(self.text, start)
        if not m:
            return None
        at = m.end()
        if text.startswith("<![CDATA[", at):
            if self.cdata is not None and self.cdata < at:
                self.cdata = None if (k := text.find("]]>", at)) < 0 else k
            if self.cdata is None:
                return None
            a, b, at = at + 9, self.cdata, self.cdata + 3
            at = NEXT_WITHIN.match(text, at).end()
        elif body := BODY.match(text, at):
            a, b, at = body.start(), body.end(), body.end()
        else:
            return None
        if not text.startswith(f"</{m['tag']}>", at):
            return None
        body = text[a:b].strip()
        if body:
            a = text.index(body, a)
            self.define(m["tag"].rpartition(":")[2], [self.literal(a, a + len(body), "".join(x.strip() for x in body.splitlines()))], [], start)
        return at + len(m["tag"]) + 3

    def given(self, name: str, start: int, end: int, spaced: bool) -> tuple | None:
        """What the name at ``start`` is given: operator, target, literals, uses (name, literal it is otherwise), where to go on."""
        text = self.text
        quote = text[start - 1] if start and text[start - 1] in "\"'`" and text[end : end + 1] == text[start - 1] else ""
        option = text[max(0, start - 2) : start] == "--"
        if option and start > 2 and text[start - 3] in "\"'" and text[end : end + 1] == text[start - 3]:
            quote = text[end]  # "--name", "x"
        after = GAP.match(text, end + len(quote)).end()
        if quote and text[after : after + 1] == "]":
            after = GAP.match(text, after + 1).end()
        elif text[end + len(quote) : end + len(quote) + 1] == "}" and (m := GIVES.match(text, BLANKS.match(text, end + len(quote) + 1).end())):
            self.close()
            after = m.start()
        target = name
        if quote and text[after : after + 1] == "," and (option or text[max(0, start - 2) : start - 1] == "("):
            place, at = ",", after + 1
        elif m := TYPED.match(text, end) or PROPERTY.match(text, end) or INDEXED.match(text, end) or ANNOTATED.match(text, after):
            place, at = "=", m.end()
        elif (m := GIVES.match(text, after)) and (quote or m[0] != ":" or "\n" not in text[end:after]):
            place, at = m[0], m.end()
        elif text[end : end + 1] == "(" and not quote:
            last = name.rpartition(".")[2]
            if not (m := SETTER.match(last)):
                return None
            place, at, target = ",", end + 1, last[m.end() :]
        elif spaced:
            place, at = "=", BLANKS.match(text, end).end()
        else:
            return None
        if place in COMPARED:
            place = "=="
        if place == ":" and (block := BLOCK.match(text, BLANKS.match(text, at).end())):
            found = self.block(start, block.end())
            return found and (":", target, *found)
        if place == ":" and (items := ITEMS.match(text, at)):
            return self.items(target, items.end())
        blank = BLANKS.match(text, at).end()
        value = GAP.match(text, at).end()
        if QUOTED.match(text, value) or text[value : value + 1] in ("(", "["):
            return self.valued(place, target, value)
        if place in (",", "=="):
            return None
        m = BARE.match(text, blank)
        if not m:
            return None
        word = m[0].lstrip("$%@")
        if NAME.fullmatch(word):
            # A constant, a call, or the first of alternatives.
            found = self.valued(place, target, m.end() - len(word))
            alone = found is not None and not found[2] and found[3] == [(word, None)] and found[4] == m.end()
            otherwise = self.literal(m.start(), m.end(), m[0]) if alone and any(c.isdigit() for c in m[0]) else None
            return (place, target, [], [(word, otherwise)], m.end()) if alone else found
        return place, target, [self.literal(m.start(), m.end(), m[0])], [], m.end()

    def valued(self, place: str, target: str, at: int) -> tuple | None:
        found, end = self.expression(at)
        literals, uses = self.kept(found)
        return (place, target, literals, uses, end) if literals or uses or end > at else None

    def kept(self, found: list) -> tuple[list[int], list[tuple[str, int | None]]]:
        """Literals and uses of what an expression may give."""
        literals, uses = [], []
        found = [e for e in found if e != ","]
        for entry, last in zip(found, [None, *found]):
            if isinstance(entry, list) and isinstance(last, list) and (option := self.text[last[0][0] : last[-1][1]]).startswith("--") and NAME.fullmatch(option[2:]):
                self.define(option[2:], [self.literal(entry[0][0], entry[-1][1], self.text[entry[0][0] : entry[-1][1]])], [], last[0][0], False)
            if isinstance(entry, str):
                uses.append((entry, None))
            elif entry:
                value = "".join(self.text[a:b] for a, b, _ in entry)
                literals.append(self.literal(entry[0][0], entry[-1][1], value))
                forms = NAMED_IN_FORM if any(set(prefix) & set("fF$") for _, _, prefix in entry) else NAMED_IN
                if "{" in value:
                    uses += [(n, None) for n in forms.findall(value)]
        return literals, uses

    def expression(self, at: int, many: bool = False) -> tuple[list, int]:
        """What the expression at ``at`` may give, and where it ends: literals as lists of parts (start, end, prefix), names, and (with ``many``) None
        between the values of a list. Reading stops before a name that is itself given something, so that the lexer goes on there."""
        text, found, end = self.text, [], at
        #: Open brackets: kind (a call's name, a method's with a point, "[]" for an index), entries before.
        frames: list[tuple[str, int]] = []
        #: The kind of the last token ("" for an operator), the entry that an added part belongs to, open ``?`` and where an ``if`` began.
        last, adds, chain, choices, condition = "", False, None, 0, None
        while True:
            at = (NEXT_WITHIN if frames or adds else NEXT).match(text, at).end()
            if text[at : at + 1] in ("\n", "\r") and ADDED.match(text, after := NEXT_WITHIN.match(text, at).end()):
                at = after  # the next line goes on with a part that is added
            c = text[at : at + 1]
            if m := QUOTED.match(text, at):
                if last in ("name", "close") and not frames:
                    break
                k = 3 if m["triple"] else 1
                part = (m.end("prefix") + k, m.end() - k, m["prefix"])
                if chain is not None and (adds or last == "literal"):
                    found[chain].append(part)
                else:
                    found.append([part])
                    chain = len(found) - 1
                self.inside(part[0], part[1])
                at = end = m.end()
                last, adds = "literal", False
                while method := METHOD.match(text, at):
                    frames.append(("." + method[1], len(found)))
                    at, last, chain = method.end(), "", None
            elif c == "[" or (c == "(" and (frames or not last)):
                if last and not frames and c == "[" and last == "literal":
                    break
                frames.append(("[]" if last and c == "[" else c, len(found)))
                at, last, adds, chain = at + 1, "", False, None
            elif c in (")", "]"):
                if not frames:
                    break
                kind, before = frames.pop()
                if kind not in ("(", "["):
                    found[before:] = self.given_by(kind, found[before:])
                at = end = at + 1
                chain = len(found) - 1 if kind == "(" and len(found) > before and isinstance(found[-1], list) else None
                last, adds = "literal" if chain is not None else "close" if kind != "[" or len(found) > before else "", False
            elif last in ("name", "close") and (m := MEMBER.match(text, at)):
                at = m.end()
                if text[at : at + 1] == "(":
                    frames.append((m[0][m[0].index(".") :], len(found)))
                    at, last, chain = at + 1, "", None
            elif m := ADDED.match(text, at):
                at, last, adds = m.end(), "", True
            elif m := OTHERWISE.match(text, at):
                at, last, adds, chain = m.end(), "", False, None
            elif c == "?" and text[at + 1 : at + 2] != "=":
                del found[frames[-1][1] if frames else 0 :]  # the condition
                at, last, adds, chain, choices = at + 1, "", False, None, choices + 1
            elif c == ":" and choices:
                at, last, adds, chain, choices = at + 1, "", False, None, choices - 1
            elif c == "," and (frames or many):
                if not frames:
                    found.append(None)
                elif frames[-1][0] not in ("(", "["):
                    found.append(",")  # a call with more than one argument
                at, last, adds, chain = at + 1, "", False, None
            elif m := PATH.match(text, at):
                if m[0] in ("if", "unless") and last:
                    at, last, adds, chain, condition = m.end(), "", False, None, len(found)
                elif m[0] == "else" and condition is not None:
                    del found[condition:]
                    at, last, adds, chain, condition = m.end(), "", False, None, None
                elif last and not frames:
                    break
                elif call := CALLED.match(text, m.end()):
                    frames.append((m[0].rpartition(".")[2], len(found)))
                    at, last, adds, chain = call.end(), "", False, None
                elif (g := GIVES.match(text, GAP.match(text, m.end()).end())) and g[0] not in COMPARED and (g[0] != ":" or (frames and not choices)):
                    break  # a name that is given something of its own
                else:
                    found.append(m[0])
                    at, last, adds = m.end(), "name", False
                    end = end if frames else at
            elif frames and c and c not in "{};":
                at, last, adds, chain = at + 1, "", False, None
            else:
                break
        if condition is not None:
            del found[condition:]
        if unclosed := [before for kind, before in frames if kind not in ("(", "[")]:
            del found[unclosed[0] :]
        return found, max(end, at) if frames else end

    def given_by(self, kind: str, entries: list) -> list:
        """What a call (an index, a method) gives of the entries within its brackets."""
        literals = [e for e in entries if isinstance(e, list)]
        if kind == ".format":
            return literals
        if kind == "[]" or kind[0] == ".":
            return []
        if GETTERS.search(kind):
            return literals[1:]
        return literals if len(literals) == len(entries) == 1 else []

    def inside(self, start: int, end: int) -> None:
        """Names that are given values within a literal."""
        if self.text.find("=", start, end) >= 0:
            for m in WITHIN.finditer(self.text, start, end):
                if name_score(m["name"]):
                    self.define(m["name"], [self.literal(*m.span("value"), m["value"])], [], start, False)

    def items(self, target: str, at: int) -> tuple | None:
        """A list in lines: ``- x``."""
        text, literals = self.text, []
        while m := ITEM.match(text, at):
            value = QUOTED.match(text, m.end()) or BARE.match(text, m.end())
            if not value or not (ends := LINE_ENDS.match(text, value.end())):
                break
            if value.re is QUOTED:
                k = 3 if value["triple"] else 1
                literals.append(self.literal(value.end("prefix") + k, value.end() - k, text[value.end("prefix") + k : value.end() - k]))
            else:
                literals.append(self.literal(*value.span(), value[0]))
            if ends.end() == at:
                break
            at = ends.end()
        return (":", target, literals, [], at) if literals else None

    def block(self, start: int, at: int) -> tuple | None:
        """A block scalar: the lines that are indented more than the line of its name."""
        text, first = self.text, None
        depth = self.indent(start)
        lines, end = [], at
        while at < len(text):
            m = LINE.match(text, at)
            if m[2].strip():
                if len(m[1]) <= depth:
                    break
                first = m.start(2) if first is None else first
                lines.append(m[2].strip())
                end = m.start(2) + len(m[2].rstrip())
            at = m.end()
        return ([self.literal(first, end, "".join(lines))], [], end) if lines else None

    def indent(self, at: int) -> int:
        if at > self.known:
            self.line = max(self.line, self.text.rfind("\n", self.known, at) + 1)
            self.known = at
        return len(BLANKS.match(self.text, self.line)[0])

    def literal(self, start: int, end: int, value: str) -> int:
        self.literals.append((start, end, value))
        return len(self.literals) - 1

    def leave(self, at: int) -> None:
        """A function begins: what was set deeper than its line is out of sight."""
        depth, names = self.indent(at), self.scopes[-1]
        while names and names[-1][1] > depth:
            self.sight[names.pop()[0]].pop()

    def define(self, name: str, literals: list[int], uses: list[tuple[str, int | None]], at: int, seen_after: bool = True) -> None:
        me, seen = len(self.made), []
        self.made.append((name, literals, seen))
        for word, otherwise in uses:
            found = next((self.sight[k][-1] for k in (word, word.rpartition(".")[2]) if self.sight.get(k)), None)
            if found is None:
                self.open.append((me, word, otherwise))
            else:
                seen.append(found)
        if not seen_after:
            return
        self.sight.setdefault(name, []).append(me)
        self.scopes[-1].append((name, self.indent(at)))
        self.first.setdefault(name, []).append(me)

    def scores(self) -> list[float]:
        """For each literal the highest sensitivity of the names that it reaches."""
        for me, word, otherwise in self.open:
            after = [v[k] for v in (self.first.get(word, ()), self.first.get(word.rpartition(".")[2], ())) if (k := bisect_right(v, me)) < len(v)]
            if after:
                self.made[me][2].append(after[0])
            elif otherwise is not None:
                self.made[me][1].append(otherwise)
        best, done = [0.0] * len(self.literals), [False] * len(self.made)
        rated = sorted(((name_score(name), me) for me, (name, _, _) in enumerate(self.made)), key=lambda x: (-x[0], x[1]))
        for score, me in rated:
            if not score:
                break
            todo = [] if done[me] else [me]
            done[me] = True
            while todo:
                _, literals, uses = self.made[todo.pop()]
                for k in literals:
                    best[k] = max(best[k], score)
                for other in uses:
                    if not done[other]:
                        done[other] = True
                        todo.append(other)
        return best


def sensitive_names(text: str) -> bool:
    """Whether any name of the text can be sensitive: what joins a name's parts is left out, as ``name_score`` does."""
    flat = text.lower().encode("utf-8", "surrogatepass").translate(None, b"_.-")
    return any(word in flat for word in _FLAT)


_FLAT = sorted({w.encode() for w in SENSITIVE if not any(v != w and v in w for v in SENSITIVE)})


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that sensitive names reach, and of passwords in addresses."""
    found: dict[tuple[int, int], float] = {}
    if sensitive_names(text):
        lexer = _Lexer(text)
        lexer.run()
        found = {(s, e): b * literal_score(v) for (s, e, v), b in zip(lexer.literals, lexer.scores()) if b}
    if "://" in text:
        for m in ADDRESS.finditer(text):
            found[m.span("value")] = max(found.get(m.span("value"), 0.0), literal_score(m["value"]))
    return [(*span, round(score, 4)) for span, score in sorted(found.items()) if score >= THRESHOLD]


def scan(text: str | None) -> list[dict]:
    """All spans of a text, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "base": True, "score": 1.0} for s, e, k in base]
    if more := lexed(text):
        starts, reach = [s for s, _, _ in sorted(base)], list(accumulate((e for _, e, _ in sorted(base)), max))
        out += [{"kind": "literal", "start": s, "end": e, "base": False, "score": v} for s, e, v in more if not ((k := bisect_right(starts, s)) and reach[k - 1] >= e)]
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"])))


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]
    )
)


def scan_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans", keep: list[str] | None = None) -> DataFrame:
    """Add ``out_col``: array of (kind, start, end, base, score), by start, then kind."""
    return map_text(df, text_col, {free_name(df, out_col, keep): SPANS}, lambda: lambda texts: [[scan(t) for t in texts]], keep)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_columns(df: DataFrame, spans_col: str = "secret_spans", text_id: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans, and all spans."""
    base = F.filter(spans_col, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(text_id, *[count(k) for k in KINDS[:3]], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col(spans_col)).alias("spans"))


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every found span in ``text_col`` by ``mark`` (overlapping spans as one); all other columns stay."""

    def clean(text):
        if text is None:
            return None
        out, at = [], 0
        for x in scan(text):
            if x["start"] >= at:
                out += [text[at : x["start"]], mark]
            at = max(at, x["end"])
        return "".join([*out, text[at:]]) if out else text

    made = map_text(df, text_col, {(new := free_name(df, "redacted")): T.StringType()}, lambda: lambda texts: [[clean(t) for t in texts]], [c for c in df.columns if c != text_col])
    return made.select(*[F.col(f"`{new}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
