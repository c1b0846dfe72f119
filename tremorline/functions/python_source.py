"""Small per-text helpers that need Python, wrapped as Arrow UDFs."""
from __future__ import annotations

import ast
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers with the job, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _decision_points(function: ast.AST) -> int:
    """One path plus one for every branch, nested functions included (McCabe 1976).

    What counts as a branch beyond that are conventions of common analysers: the ``else`` of a loop or of ``try``,
    assertions, conditions in comprehensions, and no ``case`` that matches anything.
    """
    return 1 + sum(_branches(node) for node in ast.walk(function))


def _branches(node: ast.AST) -> int:
    if isinstance(node, (ast.If, ast.IfExp, ast.Assert)):
        return 1
    if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
        return 1 + bool(node.orelse)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    if isinstance(node, (ast.Try, ast.TryStar)):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.match_case):
        return int(not _is_wildcard(node))
    return 0


def _is_wildcard(case: ast.match_case) -> bool:
    return case.guard is None and isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None


def _functions_in(node: ast.AST) -> list[ast.AST]:
    """Outermost functions below a node, but for those of classes in it."""
    found, pending = [], [node]
    while pending:
        for child in ast.iter_child_nodes(pending.pop()):
            if isinstance(child, _FUNCTIONS):
                found.append(child)
            elif not isinstance(child, ast.ClassDef):
                pending.append(child)
    return found


def _class_blocks(definition: ast.ClassDef) -> list[int]:
    """A class counts as a block of its own, beside its methods; classes inside it do not.

    By convention its complexity is one plus the branches of its body and its methods' complexities, averaged over the methods,
    rounded down, plus one if there are several.
    """
    methods = _functions_in(definition)
    scores = [_decision_points(m) for m in methods]
    inside = {id(n) for m in methods for n in ast.walk(m)}
    inner = {id(n) for c in ast.walk(definition) if isinstance(c, ast.ClassDef) and c is not definition for n in ast.walk(c)}
    own = sum(_branches(n) for n in ast.walk(definition) if id(n) not in inside and id(n) not in inner)
    whole = 1 + own + sum(scores)
    return [whole // len(scores) + (len(scores) > 1) if scores else whole, *scores]


def mean_complexity(source: str | None) -> float | None:
    """Mean over the outermost functions, classes and their methods; 0.0 without any, None if unparseable."""
    if source is None:
        return None
    try:
        tree = ast.parse(source)
        scores, pending = [_decision_points(f) for f in _functions_in(tree)], [tree]
        while pending:
            for child in ast.iter_child_nodes(pending.pop()):
                if isinstance(child, ast.ClassDef):
                    scores += _class_blocks(child)
                elif not isinstance(child, _FUNCTIONS):
                    pending.append(child)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return sum(scores) / len(scores) if scores else 0.0


@F.pandas_udf(T.DoubleType())
def mean_complexity_udf(sources: pd.Series) -> pd.Series:
    return sources.map(mean_complexity).astype("float64")


@F.pandas_udf(T.StringType())
def decode_text(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: None if raw is None else bytes(raw).decode("utf-8", errors="ignore"))
