"""Formulas as data: parsed against a whitelist, compiled to columns, evaluated with a fixed error taxonomy."""

from __future__ import annotations

import ast
import operator
import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import ieee
from loam.plans.formula_table import FORMULAS

CODES = ("FORMULA_NOT_FOUND", "PARSE_FAILED", "VARIABLE_MISSING", "VARIABLE_TYPE_MISMATCH", "CONSTRAINT_VIOLATION", "EVALUATION_FAILED", "UNSAFE_EXPRESSION", "DIVISION_BY_ZERO")
MAX_LENGTH = 1024
RESULT = "struct<ok:boolean,value:double,code:string,message:string,details:array<string>,warnings:array<string>>"


class ParseFailed(ValueError):
    """The expression doesn't parse, or holds something outside the whitelist."""


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str = "n"  # n number, i integer, r ratio, p percentage
    low: float | None = None
    high: float | None = None
    required: bool = True


@dataclass(frozen=True)
class Constraint:
    variable: str
    rule: str  # positive, non_negative, integer, range
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Formula:
    id: str
    template: str
    variables: tuple[Variable, ...]
    constraints: tuple[Constraint, ...] = ()
    precision: int = 0
    names: frozenset[str] = field(init=False, default=frozenset())

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", frozenset(v.name for v in self.variables))


def _power(x: Column, y: Column) -> Column:
    return F.pow(x, y)


def _log(x: Column, base: Column | None = None) -> Column:
    own = F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(None).cast("double"))
    return own if base is None else ieee.div(own, F.ln(base))


#: The functions a formula may call.
FUNCTIONS = {
    "add": operator.add,
    "subtract": operator.sub,
    "multiply": operator.mul,
    "divide": ieee.div,
    "ceil": lambda x: ieee.whole(F.ceil, x),
    "floor": lambda x: ieee.whole(F.floor, x),
    "round": lambda x: ieee.round_away(x),
    "max": ieee.largest,
    "min": ieee.smallest,
    "abs": F.abs,
    "sqrt": lambda x: F.when(x < 0, F.lit(None).cast("double")).otherwise(F.sqrt(x)),
    "pow": _power,
    "log": _log,
    "mod": ieee.modulo,
    "unaryMinus": operator.neg,
    "unaryPlus": operator.pos,
}
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: ieee.div, ast.Pow: _power, ast.Mod: ieee.modulo}
#: Names that are never variables.
BLOCKED = {"import", "constructor", "prototype", "eval", "parse", "compile", "evaluate", "simplify", "derivative", "resolve", "help", "config", "create"}
SYMBOL = re.compile(r"[a-z][a-z0-9_]*\Z")


@lru_cache(maxsize=512)
def parse(text: str) -> ast.expr:
    """The syntax tree of ``text``, if nothing but numbers, names, arithmetic and the listed calls is in it."""
    if len(text) > MAX_LENGTH:
        raise ParseFailed(f"longer than {MAX_LENGTH} characters")
    try:
        tree = ast.parse(text.replace("^", "**").strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ParseFailed(str(e)) from None
    _check(tree)
    return tree


def _check(node: ast.expr) -> None:
    match node:
        case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
            return
        case ast.Name(id=name) if name not in BLOCKED and SYMBOL.match(name):
            return
        case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=x):
            return _check(x)
        case ast.BinOp(op=op, left=a, right=b) if type(op) in BINARY:
            _check(a)
            return _check(b)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and args:
            for a in args:
                _check(a)
            return None
    raise ParseFailed(f"not allowed: {ast.unparse(node)}")


def variables_of(text: str) -> list[str] | None:
    """The variables in order of first use, or None if ``text`` doesn't parse."""
    try:
        tree = parse(text)
    except ParseFailed:
        return None
    found: list[str] = []

    def visit(node: ast.expr) -> None:
        match node:
            case ast.Name(id=name) if name not in found:
                found.append(name)
            case ast.UnaryOp(operand=x):
                visit(x)
            case ast.BinOp(left=a, right=b):
                visit(a)
                visit(b)
            case ast.Call(args=args):
                for a in args:
                    visit(a)

    visit(tree)
    return found


def _may_fail(node: ast.expr) -> bool:
    """Whether a call in ``node`` gives null where there is no real number."""
    return any(isinstance(n, ast.Call) and n.func.id in ("sqrt", "log") for n in ast.walk(node))


def compile_expression(text: str, scope: dict[str, Column]) -> Column:
    """``text`` as a column over the columns of ``scope``; every step in double precision."""

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=v):
                return F.lit(float(v))
            case ast.Name(id=name):
                if name not in scope:
                    raise ParseFailed(f"unknown variable {name}")
                return scope[name]
            case ast.UnaryOp(op=op, operand=x):
                return -build(x) if isinstance(op, ast.USub) else build(x)
            case ast.BinOp(op=op, left=a, right=b):
                return BINARY[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id=name), args=args):
                columns = list(map(build, args))
                out = FUNCTIONS[name](*columns)
                if name in ("max", "min") and any(_may_fail(a) for a in args):  # these skip nulls
                    return F.when(reduce(or_, (c.isNull() for c in columns)), F.lit(None)).otherwise(out)
                return out
        raise ParseFailed("not an expression")

    return build(parse(text))


def read_catalogue(text: str = FORMULAS) -> dict[str, Formula]:
    """Formulas by id. A template must parse and use just the declared variables, required ones all; ids are unique."""
    found: dict[str, Formula] = {}
    for line in text.strip().splitlines():
        name, template, variables, constraints, places = (x.strip() for x in line.split("|"))
        declared = []
        for v in variables.split():
            own, kind, low = re.fullmatch(r"(\w+):([nirp])(?:>=(\d+))?", v).groups()
            declared.append(Variable(own, kind, None if low is None else float(low)))
        rules = []
        for c in filter(None, (x.strip() for x in constraints.split(";"))):
            own, how = c.split(" ", 1)
            if how == "> 0":
                rules.append(Constraint(own, "positive"))
            elif how == ">= 0":
                rules.append(Constraint(own, "non_negative"))
            else:
                low, high = re.fullmatch(r"in \[(\d+),(\d+)\]", how).groups()
                rules.append(Constraint(own, "range", float(low), float(high)))
        register(found, Formula(name, template, tuple(declared), tuple(rules), int(places)))
    return found


def register(catalogue: dict[str, Formula], formula: Formula) -> None:
    if formula.id in catalogue:
        raise ValueError(f"{formula.id} is registered twice")
    used = variables_of(formula.template)
    if used is None:
        raise ValueError(f"{formula.id} does not parse")
    if unknown := set(used) - formula.names:
        raise ValueError(f"{formula.id} uses undeclared {sorted(unknown)}")
    if unused := {v.name for v in formula.variables if v.required} - set(used):
        raise ValueError(f"{formula.id} never uses {sorted(unused)}")
    catalogue[formula.id] = formula


@lru_cache(maxsize=1)
def catalogue() -> dict[str, Formula]:
    return read_catalogue()


def _error(when: Column, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message")))


def _variable_error(v: Variable, x: Column) -> Column:
    """The first thing wrong with the input, or null."""
    missing = _error(x.isNull() & F.lit(v.required), "VARIABLE_MISSING", f"missing required variable {v.name}")
    mistyped = ~ieee.is_finite(x)
    if v.kind == "i":
        mistyped = mistyped | (x != ieee.whole(F.floor, x))
    checks = [missing, _error(x.isNotNull() & mistyped, "VARIABLE_TYPE_MISMATCH", f"{v.name} is not a valid {'integer' if v.kind == 'i' else 'number'}")]
    if v.low is not None:
        checks.append(_error(x < v.low, "CONSTRAINT_VIOLATION", f"{v.name} is below {v.low:g}"))
    if v.high is not None:
        checks.append(_error(x > v.high, "CONSTRAINT_VIOLATION", f"{v.name} is above {v.high:g}"))
    return F.coalesce(*checks)


def _broken(c: Constraint, x: Column) -> Column:
    if c.rule == "positive":
        return x <= 0
    if c.rule == "non_negative":
        return x < 0
    if c.rule == "integer":
        return x != ieee.whole(F.floor, x)
    out = F.lit(False)
    if c.low is not None:
        out = out | (x < c.low)
    if c.high is not None:
        out = out | (x > c.high)
    return out


def _present(items: list[Column], kind: str) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast(f"array<{kind}>")


def calculate(formula: Formula | str, inputs: dict[str, Column], known: dict[str, Formula] | None = None) -> Column:
    """The result struct (ok, value, code, message, details, warnings) of ``formula`` over columns ``inputs``.

    Inputs are numeric columns. All errors of the variables are found before constraints are looked at;
    the first is reported, and all are in details if there are several.
    """
    name = formula if isinstance(formula, str) else formula.id
    if isinstance(formula, str):
        formula = (known or catalogue()).get(formula)
    if formula is None:
        return _failed(F.lit("FORMULA_NOT_FOUND"), F.lit(f"no formula {name}"))
    scope = {v.name: inputs.get(v.name, F.lit(None)).cast("double") for v in formula.variables}
    try:
        raw = compile_expression(formula.template, scope)
    except ParseFailed as e:
        return F.when(F.size(_errors(formula, scope)) > 0, _first(_errors(formula, scope))).otherwise(_failed(F.lit("PARSE_FAILED"), F.lit(str(e))))
    surplus = [F.lit(f"unrecognised variable {k}") for k in inputs if k not in formula.names]
    return _result(formula, scope, _errors(formula, scope), raw, F.array(*surplus).cast("array<string>"))


def _errors(formula: Formula, scope: dict[str, Column]) -> Column:
    kind = "struct<code:string,message:string>"
    own = _present([_variable_error(v, scope[v.name]) for v in formula.variables], kind)
    rules = [_error(_broken(c, scope[c.variable]), "CONSTRAINT_VIOLATION", f"{c.variable} breaks {c.rule}") for c in formula.constraints]
    return F.when(F.size(own) > 0, own).otherwise(_present(rules, kind)) if rules else own


def _result(formula: Formula, scope: dict[str, Column], errors: Column, raw: Column, surplus: Column) -> Column:
    warnings = []
    for v in formula.variables:
        top = {"r": 1, "p": 100}.get(v.kind)
        if top:
            warnings.append(F.when((scope[v.name] < 0) | (scope[v.name] > top), F.lit(f"{v.name} is outside [0, {top}]")))
    value = ieee.round_to(raw, formula.precision)
    negative = F.when(value < 0, F.array(F.lit("the result is negative"))).otherwise(F.array().cast("array<string>"))
    good = F.struct(
        F.lit(True).alias("ok"), value.alias("value"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("array<string>").alias("details"), F.concat(_present(warnings, "string"), surplus, negative).alias("warnings"),
    )
    return (
        F.when(F.size(errors) > 0, _first(errors))
        .when(raw.isNull(), _failed(F.lit("EVALUATION_FAILED"), F.lit(f"{formula.id} gives no real number")))
        .when(~ieee.is_finite(raw), _failed(F.lit("DIVISION_BY_ZERO"), F.lit(f"{formula.id} divides by zero")))
        .otherwise(good)
    ).cast(RESULT)


def _failed(code: Column, message: Column, details: Column | None = None) -> Column:
    return F.struct(
        F.lit(False).alias("ok"), F.lit(None).cast("double").alias("value"), code.alias("code"), message.alias("message"),
        (F.lit(None) if details is None else details).cast("array<string>").alias("details"), F.array().cast("array<string>").alias("warnings"),
    ).cast(RESULT)


def _first(errors: Column) -> Column:
    several = F.when(F.size(errors) > 1, F.transform(errors, lambda e: e["message"]))
    return _failed(F.get(errors, 0)["code"], F.get(errors, 0)["message"], several)


def with_result(df: DataFrame, formula: Formula | str, inputs: dict[str, str | Column], name: str = "result", surplus: Column | None = None) -> DataFrame:
    """``df`` with the result of ``formula``; ``inputs`` maps variables to columns.

    Inputs, errors and the raw value are columns of their own on the way, so each is computed once.
    """
    inputs = {k: F.col(v) if isinstance(v, str) else v for k, v in inputs.items()}
    known = catalogue().get(formula) if isinstance(formula, str) else formula
    if known is None or variables_of(known.template) is None:
        return df.withColumn(name, calculate(formula, inputs))
    extra = [F.lit(f"unrecognised variable {k}") for k in inputs if k not in known.names]
    surplus = F.array(*extra).cast("array<string>") if surplus is None else surplus
    scope = {v.name: F.col(f"_in_{v.name}") for v in known.variables}
    staged = df.select("*", *[inputs.get(v, F.lit(None)).cast("double").alias(f"_in_{v}") for v in scope], surplus.alias("_surplus"))
    staged = staged.select("*", _errors(known, scope).alias("_errors"), compile_expression(known.template, scope).alias("_raw"))
    return staged.select(*[F.col(f"`{c}`") for c in df.columns if c != name], _result(known, scope, F.col("_errors"), F.col("_raw"), F.col("_surplus")).alias(name))


def evaluate_cases(cases: DataFrame, known: dict[str, Formula] | None = None) -> DataFrame:
    """``cases`` (formula_id, inputs map<string,double>) with result: each formula over its own rows.

    One branch for each formula, by formula_id, keeps every expression small. Ids outside the catalogue fail as not found.
    """
    known = known or catalogue()
    missing = cases.where(~F.col("formula_id").isin(*known) | F.col("formula_id").isNull())
    out = missing.withColumn("result", _failed(F.lit("FORMULA_NOT_FOUND"), F.concat(F.lit("no formula "), F.coalesce("formula_id", F.lit("")))))
    for name, formula in known.items():
        names = F.array(*[F.lit(v.name) for v in formula.variables])
        surplus = F.transform(F.array_except(F.map_keys("inputs"), names), lambda k: F.concat(F.lit("unrecognised variable "), k))
        inputs = {v.name: F.try_element_at("inputs", F.lit(v.name)) for v in formula.variables}
        out = out.union(with_result(cases.where(F.col("formula_id") == name), formula, inputs, surplus=surplus))
    return out
