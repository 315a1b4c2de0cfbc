"""The expression strings of ``query`` and ``eval`` as Columns, through Python's own parser."""

from __future__ import annotations

import ast
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import nulls
from tessera.nulls import known, lit

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: nulls.divide, ast.FloorDiv: nulls.floordiv, ast.Mod: nulls.mod, ast.Pow: F.pow, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.BitXor: operator.ne}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_CALLS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "floor": F.floor, "ceil": F.ceil}


def _prepared(text: str) -> tuple[str, dict[str, str]]:
    quoted: dict[str, str] = {}

    def name(m: re.Match) -> str:
        key = f"__q{len(quoted)}"
        quoted[key] = m[1]
        return key

    text = re.sub(r"`([^`]+)`", name, text.strip())
    text = re.sub(r"@([A-Za-z_]\w*)", r"__local_\1", text)
    return re.sub(r"(?<![&|<>=!])&&?(?!=)", " & ", text).replace("||", "|"), quoted


def assignments(text: str) -> list[tuple[str, str]]:
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if m := re.match(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", line):
            out.append((m[1], m[2]))
    return out


def translate(text: str, local_dict: dict | None = None) -> Column:
    prepared, quoted = _prepared(text)

    def value(node: ast.AST):
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant):
            return lit(node.value)
        if isinstance(node, ast.Name):
            if node.id.startswith("__local_"):
                found = (local_dict or {})[node.id.removeprefix("__local_")]
                return found if isinstance(found, (list, tuple, set)) else lit(found)
            return F.col(f"`{quoted.get(node.id, node.id)}`")
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [value(x) for x in node.elts]
        if isinstance(node, ast.BoolOp):
            f = operator.and_ if isinstance(node.op, ast.And) else operator.or_
            out = value(node.values[0])
            for x in node.values[1:]:
                out = f(out, value(x))
            return out
        if isinstance(node, ast.UnaryOp):
            x = value(node.operand)
            return -x if isinstance(node.op, ast.USub) else ~known(x) if isinstance(node.op, (ast.Not, ast.Invert)) else x
        if isinstance(node, ast.BinOp):
            return _BINARY[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.Compare):
            out, left = None, value(node.left)
            for op, right in zip(node.ops, node.comparators, strict=True):
                r = value(right)
                if isinstance(op, (ast.In, ast.NotIn)) or isinstance(r, (list, tuple, set)):
                    test = left.isin([lit(x) if not isinstance(x, Column) else x for x in r])
                    test = ~known(test) if isinstance(op, (ast.NotIn, ast.NotEq)) else test
                elif isinstance(op, ast.NotEq):
                    test = F.coalesce(left != r, F.lit(True))
                else:
                    test = _COMPARE[type(op)](left, r)
                out, left = test if out is None else out & test, r
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return _CALLS[node.func.id](*map(value, node.args))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("isnull", "isna", "notnull", "notna"):
            c = value(node.func.value)
            return c.isNull() if node.func.attr in ("isnull", "isna") else c.isNotNull()
        raise NotImplementedError(ast.dump(node))

    # & and | bind tighter than comparisons in Python: group the comparisons first
    grouped = re.sub(r"\s&\s", " and ", re.sub(r"\s\|\s", " or ", prepared)) if re.search(r"[<>=]", prepared) else prepared
    return value(ast.parse(grouped, mode="eval"))
