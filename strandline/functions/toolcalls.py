"""Tool calls in completions: JSON bodies, function/parameter markup, and channel tokens."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Call = dict  # {"name": str, "arguments": dict}

_BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
_FUNCTION = re.compile(r"<function=([^>\n]+)>(.*?)</function>", re.DOTALL)
_PARAMETER = re.compile(r"<parameter=([^>\n]+)>(.*?)</parameter>", re.DOTALL)
_CHANNEL_THOUGHT = re.compile(r"(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", re.DOTALL)
_CHANNEL_CALL = re.compile(r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+?) ?<\|constrain\|>json<\|message\|>(.*?)<\|call\|>", re.DOTALL)
_LITERAL_LIMIT = 16_384


class _NotPlain(ValueError):
    """A literal with something that JSON has not."""


def _from_node(node: ast.expr):
    """The JSON value of a literal's syntax tree; sets are sorted by their text, inner tuples are lists, keys are text."""
    match node:
        case ast.Constant(value=None | bool() | int() | float() | str() as value):
            return value
        case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=ast.Constant(value=int() | float() as value)):
            return -value if isinstance(sign, ast.USub) else value
        case ast.List(elts=items) | ast.Tuple(elts=items):
            return [_from_node(x) for x in items]
        case ast.Set(elts=items):
            return sorted(map(_from_node, items), key=str)
        case ast.Dict(keys=keys, values=values) if None not in keys:
            return {str(_from_node(k)): _from_node(x) for k, x in zip(keys, values, strict=True)}
    raise _NotPlain(type(node).__name__)


def _literal_value(raw: str):
    """The value of a short literal; None for a bare tuple and for whatever is no literal."""
    if len(raw) > _LITERAL_LIMIT or "__" in raw:
        return None
    try:
        tree = ast.parse(raw, mode="eval").body
        return None if isinstance(tree, ast.Tuple) else _from_node(tree)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


def structured(text: str | None):
    """The value of a JSON text, or of a short literal of lists and mappings; None for anything else, and for bare tuples."""
    raw = (text or "").strip()
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return _literal_value(raw)


def _arguments(value) -> dict | None:
    for _ in range(2):
        if isinstance(value, str):
            value = structured(value)
    return value if isinstance(value, dict) else None


def _json_call(body: str, read: Callable) -> Call | None:
    payload = read(body)
    if not isinstance(payload, dict) or not isinstance(payload.get("name"), str) or not payload["name"].strip():
        return None
    arguments = _arguments(payload.get("arguments"))
    return None if arguments is None else {"name": payload["name"].strip(), "arguments": arguments}


def _parameter(raw: str):
    """A parameter's value: what is nested is read, a scalar stays the text that it is."""
    nested = structured(raw)
    return nested if isinstance(nested, (dict, list)) else raw.strip()


def _markup_calls(body: str) -> list[Call]:
    """Calls of function/parameter markup that have a name."""
    named = ((m[1].strip(), m[2]) for m in _FUNCTION.finditer(body))
    return [{"name": name, "arguments": {p[1].strip(): _parameter(p[2]) for p in _PARAMETER.finditer(inner)}} for name, inner in named if name]


def _strict_json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def json_blocks(text: str) -> list[Call]:
    """Calls whose block is a JSON object."""
    return [c for body in _BLOCK.findall(text) if (c := _json_call(body, _strict_json))]


def markup_blocks(text: str) -> list[Call]:
    """Calls whose block is function markup, or else a JSON object."""
    out = []
    for body in _BLOCK.findall(text):
        calls = _markup_calls(body) if _FUNCTION.fullmatch(body.strip()) else []
        out += calls[:1] or [c for c in [_json_call(body, _strict_json)] if c]
    return out


def channel_calls(text: str) -> list[Call]:
    """Calls on a tool channel, with reasoning blocks removed first; arguments that are no object count as none."""
    out = []
    for name, raw in _CHANNEL_CALL.findall(_CHANNEL_THOUGHT.sub("", text)):
        try:
            value = json.loads(raw)
        except ValueError:
            continue
        out.append({"name": name, "arguments": value if isinstance(value, dict) else {}})
    return out


#: Readers of a completion's calls, by format.
FORMATS: dict[str, Callable[[str], list[Call]]] = {"hermes": json_blocks, "qwen35": markup_blocks, "gpt-oss": channel_calls}


def _visible(text: str | None) -> str:
    """What follows the last </think>."""
    return re.split(r"(?i)</think>", text or "")[-1]


def tool_calls(text: str | None) -> list[Call]:
    """Calls of every block after the last </think>: JSON or literal bodies, else function markup."""
    out: list[Call] = []
    for body in _BLOCK.findall(_visible(text)):
        call = _json_call(body, structured)
        out += [call] if call else _markup_calls(body)
    return out


def _said(arguments: dict) -> str | None:
    answer = arguments.get("answer")
    return answer.strip() or None if isinstance(answer, str) else None


#: What a finish call's arguments must be, by the name of the error that they are not; names and fields are fixed values.
_FINISH: dict[str, Callable[[dict], bool]] = {
    "finish_argument_fields_invalid": lambda a: a.keys() == {"status", "answer", "reason_step"},
    "finish_status_invalid": lambda a: a.get("status") == "answer",
    "answer_not_nonempty_string": lambda a: _said(a) is not None,
}


def finish_call(text: str | None) -> dict:
    """The one finish call that a completion may be: valid, answer, errors."""
    shown = _visible(text).strip()
    alone = _BLOCK.fullmatch(shown) is not None and shown.count("<tool_call>") == 1
    calls = tool_calls(shown) if alone else []
    if [c["name"] for c in calls] != ["finish"]:
        return {"valid": False, "answer": None, "errors": ["finish_call_unparseable" if alone else "not_exactly_one_tool_call"]}
    arguments = calls[0]["arguments"]
    errors = [error for error, fits in _FINISH.items() if not fits(arguments)]
    return {"valid": not errors, "answer": _said(arguments), "errors": errors}


def only_call(text: str | None, *names: str) -> Call | None:
    """The call of a completion with exactly one, if it has one of the names (any, if none are given)."""
    calls = tool_calls(text)
    return calls[0] if len(calls) == 1 and (not names or calls[0]["name"] in names) else None


def _calls_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))


def _as_rows(calls: list[Call]) -> list[dict]:
    return [{"name": c["name"], "arguments": json.dumps(c["arguments"], ensure_ascii=False, sort_keys=True)} for c in calls]


@F.pandas_udf(_calls_type())
def tool_calls_column(texts: pd.Series) -> pd.Series:
    """Calls with their arguments as JSON."""
    return texts.map(lambda t: _as_rows(tool_calls(t)))


def format_column(name: str):
    """A column function that reads calls of one format."""
    read = FORMATS[name]

    @F.pandas_udf(_calls_type())
    def calls(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _as_rows(read(t or "")))

    return calls


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("answer", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))]))
def finish_call_column(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([finish_call(t) for t in texts], columns=["valid", "answer", "errors"])
