"""JSON and Variant functions: paths, text forms, builders and SQL/JSON path existence."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dotted(path: str) -> str:
    """'a.b[0]' as '$.a.b[0]'."""
    p = path.strip()
    return p if p.startswith("$") else f"${p}" if p.startswith("[") else f"$.{p}"


def step(key: str) -> str:
    """One step of a Variant path: an array index or a key."""
    if re.fullmatch(r"-?\d+", key):
        return f"[{key}]"
    return "." + key if re.fullmatch(r"[A-Za-z_]\w*", key) else "['" + key.replace("'", "\\'") + "']"


# --- SQL/JSON paths: $, .key, ."key", .*, [*], [n], [n to m], [last], ? (filter), lax unwrapping of arrays


class PathError(ValueError):
    pass


_TOKEN = re.compile(
    r'\s*(?:(?P<num>-?\d+(?:\.\d+)?)|"(?P<str>(?:[^"\\]|\\.)*)"|(?P<op>==|!=|<>|<=|>=|&&|\|\||[$@.*\[\]()?!<>,=])|(?P<word>[A-Za-z_][\w-]*))'
)


def tokenize(path: str) -> list[tuple[str, object]]:
    out, at, text = [], 0, path.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise PathError(f"bad path {path!r} at {at}")
        if m["num"] is not None:
            out.append(("num", float(m["num"]) if "." in m["num"] else int(m["num"])))
        elif m["str"] is not None:
            out.append(("str", json.loads(f'"{m["str"]}"')))
        elif m["op"]:
            out.append(("op", m["op"]))
        else:
            out.append(("word", m["word"]))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    return out


class _Parser:
    def __init__(self, path: str):
        self.t, self.i, self.path = tokenize(path), 0, path
        self.strict = False
        if self.t[:1] and self.t[0][0] == "word" and self.t[0][1] in ("strict", "lax"):
            self.strict = self.t[0][1] == "strict"
            self.i = 1

    def peek(self, *ops: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] == "op" and self.t[self.i][1] in ops

    def take(self, *ops: str):
        if not self.peek(*ops):
            raise PathError(f"bad path {self.path!r}")
        self.i += 1
        return self.t[self.i - 1][1]

    def next(self, kind: str):
        if self.i >= len(self.t) or self.t[self.i][0] != kind:
            raise PathError(f"bad path {self.path!r}")
        self.i += 1
        return self.t[self.i - 1][1]

    def steps(self) -> list[tuple]:
        out = []
        while self.peek(".", "[", "?"):
            op = self.take(".", "[", "?")
            if op == ".":
                if self.peek("*"):
                    self.take("*")
                    out.append(("values",))
                else:
                    out.append(("key", self.next(self.t[self.i][0]) if self.i < len(self.t) and self.t[self.i][0] in ("word", "str") else self.next("word")))
            elif op == "[":
                if self.peek("*"):
                    self.take("*")
                    out.append(("items",))
                else:
                    lo = self.index()
                    hi = lo
                    if self.i < len(self.t) and self.t[self.i] == ("word", "to"):
                        self.i += 1
                        hi = self.index()
                    out.append(("range", lo, hi))
                self.take("]")
            else:
                self.take("(")
                out.append(("filter", self.either()))
                self.take(")")
        return out

    def index(self):
        if self.i < len(self.t) and self.t[self.i] == ("word", "last"):
            self.i += 1
            return "last"
        return int(self.next("num"))

    def either(self):
        left = self.both()
        while self.peek("||"):
            self.take("||")
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.test()
        while self.peek("&&"):
            self.take("&&")
            left = ("and", left, self.test())
        return left

    def test(self):
        if self.peek("!"):
            self.take("!")
            return ("not", self.test())
        if self.peek("("):
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        if self.i < len(self.t) and self.t[self.i] == ("word", "exists"):
            self.i += 1
            self.take("(")
            p = self.operand()
            self.take(")")
            return ("exists", p)
        left = self.operand()
        if self.i < len(self.t) and self.t[self.i][0] == "word" and self.t[self.i][1] in ("like_regex", "starts"):
            word = self.next("word")
            if word == "starts":
                self.next("word")
                return ("starts", left, self.next("str"))
            pattern, flags = self.next("str"), ""
            if self.i < len(self.t) and self.t[self.i] == ("word", "flag"):
                self.i += 1
                flags = self.next("str")
            return ("regex", left, re.compile(pattern, re.IGNORECASE if "i" in flags else 0))
        return ("cmp", self.take("==", "!=", "<>", "<=", ">=", "<", ">", "="), left, self.operand())

    def operand(self):
        if self.peek("@", "$"):
            root = self.take("@", "$")
            return ("path", root, self.steps())
        kind, value = self.t[self.i] if self.i < len(self.t) else ("", None)
        if kind in ("num", "str"):
            self.i += 1
            return ("lit", value)
        if kind == "word" and value in ("true", "false", "null"):
            self.i += 1
            return ("lit", {"true": True, "false": False, "null": None}[value])
        raise PathError(f"bad path {self.path!r}")


def parse_path(path: str):
    p = _Parser(path)
    p.take("$")
    steps = p.steps()
    if p.i != len(p.t):
        raise PathError(f"bad path {path!r}")
    return p.strict, steps


class _StrictMiss(Exception):
    pass


def _walk(items: list, steps: list, root, strict: bool) -> list:
    for s in steps:
        found = []
        for x in items:
            if s[0] in ("key", "values"):
                inside = x if isinstance(x, list) and not strict else [x]
                for y in inside:
                    if isinstance(y, dict):
                        if s[0] == "values":
                            found += y.values()
                        elif s[1] in y:
                            found.append(y[s[1]])
                        elif strict:
                            raise _StrictMiss
                    elif strict:
                        raise _StrictMiss
            elif s[0] == "filter":
                inside = x if isinstance(x, list) and not strict else [x]
                found += [y for y in inside if _test(s[1], y, root, strict)]
            else:
                if not isinstance(x, list):
                    if strict:
                        raise _StrictMiss
                    x = [x]
                if s[0] == "items":
                    found += x
                else:
                    lo, hi = (len(x) - 1 if b == "last" else b for b in s[1:])
                    if strict and not (0 <= lo <= hi < len(x)):
                        raise _StrictMiss
                    found += x[max(lo, 0) : hi + 1]
        items = found
    return items


def _values(operand, here, root, strict):
    if operand[0] == "lit":
        return [operand[1]]
    out = []
    for v in _walk([here if operand[1] == "@" else root], operand[2], root, strict):
        out += v if isinstance(v, list) and not strict else [v]
    return out


def _compare(op: str, a, b) -> bool:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if a is None or b is None:
        return (a is b) if op in ("==", "=") else (a is not b) if op in ("!=", "<>") else False
    if not (number(a) and number(b)) and type(a) is not type(b):
        return False
    if isinstance(a, (dict, list)):
        return False
    return {"==": a == b, "=": a == b, "!=": a != b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _test(t, here, root, strict) -> bool:
    kind = t[0]
    if kind == "or":
        return _test(t[1], here, root, strict) or _test(t[2], here, root, strict)
    if kind == "and":
        return _test(t[1], here, root, strict) and _test(t[2], here, root, strict)
    if kind == "not":
        return not _test(t[1], here, root, strict)
    try:
        if kind == "exists":
            return bool(_walk([here if t[1][1] == "@" else root], t[1][2], root, strict))
        if kind == "cmp":
            return any(_compare(t[1], a, b) for a in _values(t[2], here, root, strict) for b in _values(t[3], here, root, strict))
        texts = [v for v in _values(t[1], here, root, strict) if isinstance(v, str)]
        return any(v.startswith(t[2]) if kind == "starts" else t[2].search(v) for v in texts)
    except _StrictMiss:
        return False


def path_exists(document: str | None, path: str) -> bool | None:
    """Whether the path selects anything; null for null, false for invalid JSON; a bad path is an error."""
    if document is None:
        return None
    strict, steps = parse_path(path)
    try:
        root = json.loads(document)
        return bool(_walk([root], steps, root, strict))
    except (ValueError, _StrictMiss):
        return False


@F.pandas_udf(T.BooleanType())
def jsonb_path_exists(document: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([path_exists(d, p) for d, p in zip(document, path)], dtype=object)


def register(spark) -> None:
    spark.udf.register("jsonb_path_exists", jsonb_path_exists)
