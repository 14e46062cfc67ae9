"""Typed operations on rows: arithmetic, comparison, sorting, verification, code analysis. An operation that
fails gives a row with its error and no exception."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

MAX_NODES, MAX_EXPONENT, MAX_VALUE = 128, 12, 1e100
RESULT = StructType([StructField("ok", BooleanType()), StructField("value", DoubleType()), StructField("error", StringType())])


def evaluate(expression: str) -> float:
    """Value of an arithmetic expression; only numbers and + - * / // % ** and signs are allowed."""
    tree = ast.parse(expression.replace("^", "**"), mode="eval")
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise ValueError("expression too large")
    binary = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: a**b}

    def walk(node):
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            v = walk(node.operand)
            return v if isinstance(node.op, ast.UAdd) else -v
        if isinstance(node, ast.BinOp) and type(node.op) in binary:
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > MAX_EXPONENT:
                raise ValueError("exponent too large")
            v = binary[type(node.op)](a, b)
            if isinstance(v, complex) or abs(v) > MAX_VALUE:
                raise ValueError("value out of range")
            return v
        raise ValueError("expression not allowed")

    return walk(tree)


@F.pandas_udf(RESULT)
def arithmetic(expression: pd.Series) -> pd.DataFrame:
    rows = []
    for e in expression:
        try:
            rows.append((True, float(evaluate(e)), None))
        except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, AttributeError, RecursionError) as x:
            rows.append((False, None, type(x).__name__))
    return pd.DataFrame(rows, columns=["ok", "value", "error"])


def compare_values(a: Column, b: Column) -> Column:
    relation = F.when(a > b, "greater").when(a < b, "less").when(a == b, "equal")
    return F.struct((a.isNotNull() & b.isNotNull()).alias("ok"), relation.alias("relation"), F.abs(a - b).alias("difference"))


def sort_values(values: Column, descending: bool = False) -> Column:
    """Sorted numbers; null for an empty list or one with a missing number."""
    ok = (F.size(values) > 0) & ~F.exists(values, lambda v: v.isNull())
    return F.when(ok, F.sort_array(values, asc=not descending))


def verify(checks: Column) -> Column:
    """Whether expected and actual are equal in every check, and in each; checks are structs of both."""
    each = F.transform(checks, lambda c: c["expected"].eqNullSafe(c["actual"]))
    return F.struct(F.forall(each, lambda x: x).alias("ok"), each.alias("each"))


CODE = StructType(
    [
        StructField("symbols", ArrayType(StructType([StructField("name", StringType()), StructField("kind", StringType()), StructField("line", IntegerType())]))),
        StructField("calls", ArrayType(StructType([StructField("scope", StringType()), StructField("target", StringType())]))),
        StructField("imports", ArrayType(StringType())),
        StructField("diagnostics", ArrayType(StringType())),
    ]
)
#: Imports, type and function declarations by language, and words that are no calls.
_IMPORT = {"java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "cpp": r'^\s*#include\s*[<"]([\w./]+)[>"]', "csharp": r"^\s*using\s+([\w.]+)\s*;", "javascript": r"^\s*import\b.*?['\"]([^'\"]+)['\"]", "rust": r"^\s*use\s+([\w:]+)"}
_TYPE = r"\b(?:class|struct|interface|enum)\s+([A-Za-z_]\w*)"
_FUNCTION = (r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", r"\b(?:function|fn)\s+([A-Za-z_]\w*)\s*[(<]", r"^\s*(?:[A-Za-z_][\w:<>,\[\]*&]*\s+)+([A-Za-z_]\w*)\s*\([^;]*$")
_NO_CALL = frozenset("if for while switch catch return sizeof new throw else do func function fn".split())


def analyze(code: str, language: str) -> dict:
    """Symbols, calls with their scope, imports and diagnostics of a piece of code."""
    symbols, calls, imports, notes = {}, {}, {}, []
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError) as e:
            return {"symbols": [], "calls": [], "imports": [], "diagnostics": [f"SyntaxError line={getattr(e, 'lineno', None) or 0}"]}

        def walk(node, scope):
            for child in ast.iter_child_nodes(node):
                inner = scope
                if isinstance(child, ast.Import):
                    imports.update(dict.fromkeys(a.name for a in child.names))
                    continue
                if isinstance(child, ast.ImportFrom):
                    imports[child.module or ""] = None
                    continue
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    symbols[(child.name, "class" if isinstance(child, ast.ClassDef) else "function", child.lineno)] = None
                    inner = child.name
                elif isinstance(child, ast.Call):
                    f = child.func
                    name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                    if name:
                        calls[(scope, name)] = None
                walk(child, inner)

        walk(tree, "<module>")
    else:
        scope = "<module>"
        for n, line in enumerate(code.split("\n"), 1):
            if m := re.search(_IMPORT.get(language, r"(?!)"), line):
                imports[m[1]] = None
                continue
            if m := re.search(_TYPE, line):
                symbols[(m[1], "class", n)] = None
            declared = next((m[1] for p in _FUNCTION if (m := re.search(p, line)) and m[1] not in _NO_CALL), None)
            if declared:
                symbols[(declared, "function", n)] = None
                scope = declared
            for name in re.findall(r"\b([A-Za-z_]\w*)\s*\(", line):
                if name not in _NO_CALL and name != declared:
                    calls[(scope, name)] = None
        if delta := code.count("{") - code.count("}"):
            notes.append(f"UnbalancedBraces delta={delta}")
    return {"symbols": [dict(zip(("name", "kind", "line"), s)) for s in symbols], "calls": [dict(zip(("scope", "target"), c)) for c in calls], "imports": list(imports), "diagnostics": notes}


@F.pandas_udf(CODE)
def analyze_code(code: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([analyze(c or "", (x or "").lower()) for c, x in zip(code, language)], columns=[f.name for f in CODE])
