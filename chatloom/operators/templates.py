"""Chat templates as column expressions: the template is worked through once, over columns, and what it needs no row for is settled there.

The language is the part of it that chat templates use: output, if, for over messages, set; ``and or not == != < <= > >= in + - * % ~``,
literals, attributes, items and slices; filters ``trim``, ``length`` and ``join``; tests ``defined``, ``none``, ``string``, ``mapping`` and
``iterable``; ``raise_exception``, which makes the text null. White space is trimmed as chat templates have it: the line break after a
tag and the blanks before a tag go. Anything else is a :class:`TemplateError`, unless it stands in a branch that no conversation reaches.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import strip


class TemplateError(ValueError):
    pass


class _Missing:
    """A name or field that is not there."""


MISSING = _Missing()


@dataclass
class _Messages:
    """The turns from ``start`` on."""

    turns: Column
    start: Any = 0


@dataclass
class _Message:
    fields: dict[str, Column]


@dataclass
class _Raised:
    pass


_TAG = re.compile(r"\{%(-?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#(-?).*?(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<sign>==|!=|<=|>=|[-+*%~|.,:()\[\]<>=]))""", re.DOTALL)
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


def _pieces(source: str) -> list[tuple[str, str]]:
    """("text" | "tag" | "out", content) with white space trimmed."""
    source = source.removesuffix("\n")
    out, at, trimmed, newline = [], 0, False, False

    def text(end: int) -> str:
        t = source[at:end]
        return t.lstrip() if trimmed else t.removeprefix("\n") if newline else t

    for m in _TAG.finditer(source):
        kind = "tag" if m[2] is not None else "out" if m[5] is not None else "note"
        before, after = {"tag": (m[1], m[3]), "out": (m[4], m[6]), "note": (m[7], m[8])}[kind]
        line = source[: m.start()].rstrip(" \t")
        t = text(m.start())
        t = t.rstrip() if before else t.rstrip(" \t") if kind != "out" and (not line or line.endswith("\n")) else t
        out += [("text", t)] if t else []
        if kind != "note":
            out.append((kind, (m[2] if kind == "tag" else m[5]).strip()))
        at, trimmed, newline = m.end(), bool(after), kind != "out"
    t = text(len(source))
    return [*out, ("text", t)] if t else out


class _Parser:
    """An expression as nested tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] != "text" else None

    def take(self, *signs: str) -> str | None:
        if self.peek() in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> tuple:
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"can't read {self.tokens[self.at][1]!r}")
        return e

    def either(self) -> tuple:
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.negated()
        while self.take("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        e = self.added()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                e = (sign, e, self.added())
            elif self.peek() == "not" and self.peek(1) == "in":
                self.at += 2
                e = ("not", ("in", e, self.added()))
            else:
                return e

    def added(self) -> tuple:
        e = self.multiplied()
        while sign := self.take("+", "-", "~"):
            e = (sign, e, self.multiplied())
        return e

    def multiplied(self) -> tuple:
        e = self.filtered()
        while sign := self.take("*", "%"):
            e = (sign, e, self.filtered())
        return e

    def filtered(self) -> tuple:
        e = self.placed()
        while True:
            if self.take("|"):
                name, args = self.name(), []
                if self.take("("):
                    args = self.arguments()
                e = ("filter", name, e, args)
            elif self.take("is"):
                no = bool(self.take("not"))
                e = ("test", self.name(), e)
                e = ("not", e) if no else e
            else:
                return e

    def arguments(self) -> list[tuple]:
        args = []
        while not self.take(")"):
            if self.peek(1) == "=":  # a named argument
                self.at += 2
            args.append(self.either())
            if self.peek() != ")":
                self.need(",")
        return args

    def placed(self) -> tuple:
        e = self.plain()
        while True:
            if self.take("."):
                e = ("item", e, ("value", self.name()))
            elif self.take("["):
                low = None if self.peek() == ":" else self.either()
                if self.take(":"):
                    if not self.take("]"):
                        raise TemplateError("a slice with an end")
                    e = ("from", e, low or ("value", 0))
                else:
                    self.need("]")
                    e = ("item", e, low)
            elif self.take("("):
                e = ("call", e, self.arguments())
            else:
                return e

    def plain(self) -> tuple:
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.either())
                if self.peek() != "]":
                    self.need(",")
            return ("list", items)
        if self.take("-"):
            return ("-", ("value", 0), self.placed())
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("value", int(token))
        if kind == "text":
            return ("value", ast.literal_eval(token.replace("\n", "\\n")))
        if kind == "name":
            return ("value", _WORDS[token]) if token in _WORDS else ("name", token)
        raise TemplateError(f"can't read {token!r}")


def _tree(pieces: list[tuple[str, str]]) -> list[tuple]:
    """Texts, outputs and blocks; expressions are read when they are reached, so that dead branches may hold anything."""
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            word = content.split(None, 1)[0] if kind == "tag" and content else ""
            rest = content[len(word) :].strip()
            if kind != "tag":
                out.append((kind, content))
            elif word in ends:
                return out, content
            elif word == "set":
                out.append(("set", rest))
            elif word == "if":
                branches, now = [], rest
                while True:
                    body, end = block("elif", "else", "endif")
                    branches.append((now, body))
                    if end == "endif":
                        break
                    now = end[4:].strip() if end.startswith("elif") else None
                out.append(("if", branches))
            elif word == "for":
                body, end = block("endfor")
                out.append(("for", rest, body))
            else:
                raise TemplateError(f"unknown tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return block()[0]


def _same(a, b) -> bool:
    return a is b or (isinstance(a, str | int) and isinstance(b, str | int) and a == b)


def _is_column(*values) -> bool:
    return any(isinstance(v, Column) for v in values)


def _text(v) -> Any:
    if isinstance(v, Column | str):
        return v
    if v is MISSING:
        return ""
    if isinstance(v, bool | int) or v is None:
        return str(v)
    raise TemplateError("only texts and numbers can be shown")


def _joined(parts: list) -> Any:
    """Texts and columns in a row; a null column makes it null."""
    if not _is_column(*parts):
        return "".join(parts)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts if isinstance(p, Column) or p])


class _Run:
    """One pass through a template. Truths, texts and numbers are Python's where no row decides, columns else."""

    def __init__(self, kinds: dict[int, str]):
        self.kinds = kinds

    def truth(self, v) -> Any:
        if isinstance(v, Column):
            kind = self.kinds.get(id(v), "text")
            return F.coalesce(v if kind == "truth" else v != ("" if kind == "text" else 0), F.lit(False))
        if isinstance(v, _Messages):
            return self.truth(self.made(F.size(v.turns) > v.start, "truth"))
        return False if v is MISSING else True if isinstance(v, _Message) else bool(v)

    def made(self, c: Column, kind: str) -> Column:
        self.kinds[id(c)] = kind
        self.keep = [*getattr(self, "keep", []), c]  # an id stays that column's
        return c

    def value(self, e: tuple, env: dict) -> Any:
        what, *args = e
        if what == "value":
            return args[0]
        if what == "name":
            return env.get(args[0], MISSING)
        if what in ("and", "or"):
            a = self.value(args[0], env)
            t = self.truth(a)
            if not isinstance(t, Column):
                return self.value(args[1], env) if t == (what == "and") else a
            b = self.truth(self.value(args[1], env))
            b = F.lit(b) if isinstance(b, bool) else b
            return self.made(t & b if what == "and" else t | b, "truth")
        if what == "not":
            t = self.truth(self.value(args[0], env))
            return self.made(~t, "truth") if isinstance(t, Column) else not t
        if what == "test":
            return self.test(args[0], self.value(args[1], env))
        if what == "filter":
            return self.filter(args[0], self.value(args[1], env), [self.value(a, env) for a in args[2]])
        if what == "item":
            return self.item(self.value(args[0], env), self.value(args[1], env))
        if what == "list":
            return [self.value(a, env) for a in args[0]]
        if what == "from":
            base, low = (self.value(a, env) for a in args)
            if isinstance(base, _Messages) and isinstance(low, int) and low >= 0:
                return _Messages(base.turns, base.start + low)
            raise TemplateError("only messages can be cut, from their begin")
        if what == "call":
            if args[0] == ("name", "raise_exception"):
                return _Raised()
            raise TemplateError(f"unknown function {args[0][-1]!r}")
        return self.two(what, *(self.value(a, env) for a in args))

    def two(self, sign: str, a, b) -> Any:
        if sign == "in":
            if isinstance(b, _Message):
                return a in b.fields
            if isinstance(b, str | list) and isinstance(a, str):
                return a in b
            if isinstance(b, Column) or isinstance(a, Column):
                return self.made(F.contains(_lit(b), _lit(a)), "truth")
            raise TemplateError("can't look there")
        if isinstance(a, _Messages | _Message | _Raised) or isinstance(b, _Messages | _Message | _Raised):
            raise TemplateError(f"{sign} of messages")
        if sign == "~" or (sign == "+" and (isinstance(a, str) or isinstance(b, str) or self._texts(a, b))):
            if sign == "+" and (a is MISSING or b is MISSING or a is None or b is None):
                raise TemplateError("a text and nothing can't be added")
            return self.made(c, "text") if isinstance(c := _joined([_text(a), _text(b)]), Column) else c
        if not _is_column(a, b):
            ops = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}
            return ops[sign]()
        if a is MISSING or b is MISSING or a is None or b is None:
            return {"==": False, "!=": True}[sign]
        a, b = _lit(a), _lit(b)
        ops = {"==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: F.pmod(a, b)}
        return self.made(ops[sign](), "truth" if sign in ("==", "!=", "<", "<=", ">", ">=") else "number")

    def _texts(self, a, b) -> bool:
        return all(isinstance(v, Column) and self.kinds.get(id(v)) == "text" for v in (a, b))

    def test(self, name: str, v) -> bool:
        text = isinstance(v, str) or (isinstance(v, Column) and self.kinds.get(id(v)) == "text")
        known = {"defined": v is not MISSING, "undefined": v is MISSING, "none": v is None, "string": text, "mapping": isinstance(v, _Message), "iterable": text or isinstance(v, _Messages | _Message | list)}
        if name not in known:
            raise TemplateError(f"unknown test {name!r}")
        return known[name]

    def filter(self, name: str, v, args: list) -> Any:
        if name == "trim" and not args:
            v = _text(v)
            return self.made(strip(v), "text") if isinstance(v, Column) else v.strip()
        if name == "length":
            if isinstance(v, _Messages):
                return self.made(F.greatest(F.size(v.turns) - v.start, F.lit(0)), "number")
            if isinstance(v, Column):
                return self.made(F.length(v), "number")
            return 0 if v is MISSING else len(v)
        if name == "join" and isinstance(v, list):
            between, parts = (args or [""])[0], []
            for i, x in enumerate(v):
                parts += [between] * (i > 0) + [_text(x)]
            return self.made(c, "text") if isinstance(c := _joined(parts), Column) else c
        raise TemplateError(f"unknown filter {name!r}")

    def item(self, base, key) -> Any:
        if isinstance(base, _Message):
            return base.fields.get(key, MISSING)
        if isinstance(base, _Messages) and isinstance(key, int) and key >= 0:
            return self.message(F.get(base.turns, _lit(base.start + key)))
        if isinstance(base, dict):
            return base.get(key, MISSING)
        if isinstance(base, list) and isinstance(key, int):
            return base[key]
        raise TemplateError(f"nothing has an item {key!r}")

    def message(self, turn: Column) -> _Message:
        return _Message({n: self.made(F.coalesce(turn[f], F.lit("")), "text") for n, f in (("role", "role"), ("content", "text"))})

    def body(self, nodes: list[tuple], env: dict) -> Any:
        parts: list = []
        for kind, *args in nodes:
            if kind == "text":
                parts.append(args[0])
            elif kind == "out":
                v = self.value(_Parser(args[0]).whole(), env)
                parts.append(F.lit(None).cast("string") if isinstance(v, _Raised) else _text(v))
            elif kind == "set":
                name, _, what = args[0].partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or not what:
                    raise TemplateError(f"can't set {args[0]!r}")
                env[name.strip()] = self.value(_Parser(what).whole(), env)
            elif kind == "if":
                parts.append(self.branches(args[0], env))
            else:
                parts.append(self.loop(args[0], args[1], env))
        return _joined(parts)

    def branches(self, branches: list[tuple], env: dict) -> Any:
        """The text of the first true branch; names that branches set get their values under the same conditions."""
        met = []
        for cond, nodes in branches:
            t = True if cond is None else self.truth(self.value(_Parser(cond).whole(), env))
            if t is False:
                continue
            own = dict(env)
            met.append((t, self.body(nodes, own), own))
            if t is True:
                break
        else:
            met.append((True, "", dict(env)))
        if met[0][0] is True:
            env.update(met[0][2])
            return met[0][1]
        for name in {n for _, _, own in met for n in own}:
            values = [own.get(name, MISSING) for _, _, own in met]
            if not all(_same(v, values[0]) for v in values):
                env[name] = self.chosen([t for t, _, _ in met], values)
        return self.chosen([t for t, _, _ in met], [text for _, text, _ in met])

    def chosen(self, conds: list, values: list) -> Any:
        if all(isinstance(v, _Messages) for v in values):
            return _Messages(values[0].turns, self.chosen(conds, [v.start for v in values]))
        if any(v is MISSING or isinstance(v, _Messages | _Message | list | dict | _Raised) for v in values):
            return MISSING
        kind = "number" if all(isinstance(v, int) or self.kinds.get(id(v)) == "number" for v in values) else "text"
        out = _lit(values[-1])
        for t, v in reversed(list(zip(conds[:-1], values[:-1], strict=True))):
            out = F.when(t, _lit(v)).otherwise(out)
        return self.made(out, kind)

    def loop(self, head: str, nodes: list[tuple], env: dict) -> Any:
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", head, re.DOTALL)
        if not m:
            raise TemplateError(f"can't loop {head!r}")
        over = self.value(_Parser(m[2]).whole(), env)
        if not isinstance(over, _Messages):
            raise TemplateError("only messages can be looped over")
        n = F.size(over.turns) - over.start
        left = F.when(n > 0, F.slice(over.turns, _lit(over.start) + 1, F.greatest(n, F.lit(0)))).otherwise(F.slice(over.turns, 1, 0))

        def one(turn: Column, i: Column) -> Column:
            number = lambda c: self.made(c, "number")
            loop = {"index0": number(i + 0), "index": number(i + 1), "length": number(n), "first": self.made(i == 0, "truth"), "last": self.made(i == n - 1, "truth")}
            return _lit(self.body(nodes, {**env, m[1]: self.message(turn), "loop": loop}))

        said = F.transform(left, one)
        return self.made(F.when(F.forall(said, lambda x: x.isNotNull()), F.array_join(said, "")), "text")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def compiled(template: str, turns: Column, ask: bool = False, **names) -> Column:
    """The text of a conversation (an array of role and text) by a chat template; ``names`` are its other variables, such as ``bos_token``.

    Null where the template raises an exception, and for null turns; a null text counts as empty.
    """
    env = {"messages": _Messages(turns), "add_generation_prompt": ask, **names}
    return F.when(turns.isNotNull(), _lit(_Run({}).body(_tree(_pieces(template)), env)))


#: The family of each model's template.
MODELS = {
    "meta-llama/Meta-Llama-3-8B": "header",
    "meta-llama/Llama-3.2-3B": "dated",
    **{f"Qwen/Qwen2.5-{size}": "im" for size in ("1.5B", "3B", "7B", "14B", "32B")},
    **{f"Qwen/Qwen2.5-{size}-Instruct": "im" for size in ("1.5B", "3B", "7B", "14B", "32B")},
    "google/gemma-3-27b-pt": "turn",
}


_ASK_HEADER = "{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\\n\\n' }}{% endif %}"
#: Templates of the families, for conversations without tools. What they say is fixed by the models.
TEMPLATES = {
    "header": "{{ bos_token }}{% for m in messages %}{{ '<|start_header_id|>' ~ m.role ~ '<|end_header_id|>\\n\\n' ~ m.content | trim ~ '<|eot_id|>' }}{% endfor %}" + _ASK_HEADER,
    "dated": """{% if messages[0].role == 'system' %}
  {%- set system = messages[0].content | trim %}
  {%- set messages = messages[1:] %}
{% else %}
  {%- set system = '' %}
{% endif %}
{% if date_string is not defined %}
  {% set date_string = '26 Jul 2024' %}
{% endif %}
{{- bos_token ~ '<|start_header_id|>system<|end_header_id|>\\n\\n' -}}
{{ 'Cutting Knowledge Date: December 2023\\nToday Date: ' ~ date_string ~ '\\n\\n' ~ system ~ '<|eot_id|>' }}
{%- for m in messages %}
  {{- '<|start_header_id|>' + m.role + '<|end_header_id|>\\n\\n' + m.content | trim + '<|eot_id|>' }}
{%- endfor %}"""
    + _ASK_HEADER,
    "im": """{% if messages[0].role != 'system' %}
  {{- '<|im_start|>system\\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\\n' }}
{%- endif %}
{%- for m in messages %}
  {{- ['<|im_start|>', m.role, '\\n', m.content, '<|im_end|>\\n'] | join }}
{%- endfor %}
{%- if add_generation_prompt %}
  {{- '<|im_start|>assistant\\n' }}
{%- endif %}""",
    "turn": """{{ bos_token }}
{%- set before = '' %}
{%- if messages[0].role == 'system' %}
  {%- set before = messages[0].content + '\\n\\n' %}
  {%- set messages = messages[1:] %}
{%- endif %}
{%- for m in messages %}
  {%- if (m.role == 'user') != (loop.index0 % 2 == 0) %}
    {{- raise_exception('roles must alternate') }}
  {%- endif %}
  {%- if m.role == 'assistant' %}{% set role = 'model' %}{% else %}{% set role = m.role %}{% endif %}
  {{- '<start_of_turn>' ~ role ~ '\\n' }}
  {%- if loop.first %}{{ before }}{% endif %}
  {{- m.content | trim ~ '<end_of_turn>\\n' }}
{%- endfor %}
{%- if add_generation_prompt %}{{ '<start_of_turn>model\\n' }}{% endif %}""",
}
BOS = {"header": "<|begin_of_text|>", "dated": "<|begin_of_text|>", "im": "", "turn": "<bos>"}


def model_text(model: str, turns: Column, ask: bool = False) -> Column:
    """The text of a conversation for a model."""
    if model not in MODELS:
        raise TemplateError(f"no template for {model!r}")
    family = MODELS[model]
    return compiled(TEMPLATES[family], turns, ask, bos_token=BOS[family])


def from_config(spark: SparkSession, path: str) -> tuple[str, dict]:
    """The template of a tokenizer's configuration file, and the special tokens that it names."""
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(data.get("chat_template"), str):
        raise TemplateError(f"{path} has no chat template")
    tokens = {k: v["content"] if isinstance(v, dict) else v for k, v in data.items() if k in ("bos_token", "eos_token", "pad_token", "unk_token") and v is not None}
    return data["chat_template"], tokens
