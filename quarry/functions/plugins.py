"""What users plug in: scorers by name, from their own files, and the parse step of tool calls as a table function."""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.arrays import MISSING, NOT_AN_OBJECT, NOT_LISTED, WRONG_TYPE

ANSWER, CALL = re.compile(r"<answer>(.*?)</answer>", re.DOTALL), re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
SCORED = StructType().add("score", "double").add("failed", "boolean")


def load_function(path: str, name: str) -> Callable:
    """The function of a name in a Python file; it goes to executors by value."""
    spec = importlib.util.spec_from_file_location("quarry_plugin_" + re.sub(r"\W", "_", path), path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    import sys

    sys.modules[spec.name] = module
    cloudpickle.register_pickle_by_value(module)
    return getattr(module, name)


def scorer(score: Callable, batched: bool = False, **fixed):
    """A vectorised function of (data_source, reply, truth, extra) columns that returns (score, failed).

    score gets the values of one row, or with batched the lists of a batch, and what is
    fixed; it returns a number, a truth value or a dict with score (batched: a list of
    them). A row that fails has score 0; if a batch fails, its rows are scored one by one.
    """

    def number(x) -> float:
        return float(x["score"] if isinstance(x, dict) else x[0] if isinstance(x, (list, tuple)) else x)

    def one(row) -> tuple[float, bool]:
        try:
            return number(score(*([v] for v in row), **fixed)[0] if batched else score(*row, **fixed)), False
        except Exception:  # whatever a user's scorer raises
            return 0.0, True

    @F.pandas_udf(SCORED)
    def run(source: pd.Series, reply: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
        rows = list(zip(source, reply, truth, extra, strict=True))
        if batched:
            try:
                found = [(number(x), False) for x in score(*(list(c) for c in (source, reply, truth, extra)), **fixed)]
                if len(found) == len(rows):
                    return pd.DataFrame(found, columns=["score", "failed"])
            except Exception:  # noqa: S110  the rows are scored one by one
                pass
        return pd.DataFrame([one(r) for r in rows], columns=["score", "failed"])

    return run


def register_scorer(spark: SparkSession, name: str, score: Callable, batched: bool = False, **fixed):
    """The scorer under a name that SQL can call with (data_source, reply, truth, extra)."""
    return spark.udf.register(name, scorer(score, batched, **fixed))


def dispatched(source: Column, scorers: dict[str, Column], default: str | None = None) -> Column:
    """The score of the first entry whose name is the source, or a beginning of it where the name ends with *; an unknown source fails, or gets the default's score."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double") if default is None else scorers[default]
    for name, score in reversed(scorers.items()):
        out = F.when(source.startswith(name[:-1]) if name.endswith("*") else source == name, score).otherwise(out)
    return out


class ParseStep:
    """eval(action): a row for each box of the action's tool call, with its place; one with an error for a call that isn't right; none for an answer or without a call."""

    def eval(self, action: str, name: str = "focus", most: int = 3):
        if not action or any(x.strip() for x in ANSWER.findall(action)):
            return
        calls = CALL.findall(action)
        if not calls or not calls[-1].strip():
            return
        try:
            call = json.loads(calls[-1].strip())
        except ValueError:
            yield None, None, "not JSON"
            return
        arguments = call.get("arguments") if isinstance(call, dict) else None
        boxes = arguments.get("bboxes") if isinstance(arguments, dict) else None
        if not isinstance(call, dict) or call.get("name") != name:
            yield None, None, "unknown tool"
        elif not isinstance(boxes, list) or not 1 <= len(boxes) <= most:
            yield None, None, f"not 1 to {most} boxes"
        elif not all(isinstance(b, list) and len(b) == 4 and all(isinstance(v, (int, float)) for v in b) for b in boxes):
            yield None, None, "not four coordinates"
        else:
            for place, box in enumerate(boxes):
                yield place, [float(v) for v in box], None


def parse_step():
    """The table function of ParseStep."""
    return F.udtf(ParseStep, returnType="place int, box array<double>, error string", useArrow=False)


def register_parse_step(spark: SparkSession, name: str = "parse_step"):
    """Under a name that SQL can call: select ... from t, lateral parse_step(t.action)."""
    return spark.udtf.register(name, parse_step())


class Tool:
    """A tool that a model may call. Subclasses give a name, which registers them, a schema of arguments, and execute(arguments), which returns (observation, reward, done)."""

    registry: dict[str, type[Tool]] = {}
    name, description, schema = "", "", {"type": "object", "properties": {}, "required": []}

    def __init_subclass__(cls, **options):
        super().__init_subclass__(**options)
        if cls.name:
            Tool.registry[cls.name] = cls

    @classmethod
    def create(cls, name: str) -> Tool:
        if name not in Tool.registry:
            raise ValueError(f"no tool registered with name {name}")
        return Tool.registry[name]()

    def described(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.schema}}

    def execute(self, arguments: dict) -> tuple[str, float, bool]:
        raise NotImplementedError


KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}
STEPPED = StructType().add("observation", "string").add("reward", "double").add("done", "boolean").add("status", "string")


def fault_of(arguments: object, schema: dict) -> str | None:
    """The first thing wrong with arguments by a schema, as arrays.argument_fault finds it; None if nothing is."""
    if not isinstance(arguments, dict):
        return NOT_AN_OBJECT
    for name in schema.get("required", []):
        if name not in arguments:
            return MISSING.format(name)
    for name, value in arguments.items():
        rule = schema.get("properties", {}).get(name, {})
        if rule.get("type") in KINDS and not isinstance(value, KINDS[rule["type"]]):
            return WRONG_TYPE.format(name, rule["type"])
        if "enum" in rule and value not in rule["enum"]:
            return NOT_LISTED.format(name, ", ".join(map(str, rule["enum"])))
    return None


def tool_step(tools: list[type[Tool]]):
    """A vectorised function of an action column: (observation, reward, done, status) of its last tool call. An answer, or an action without a call, is done; a call that can't be read, of an unknown tool or with wrong arguments fails and goes on, and so does one whose tool raises."""
    held = {t.name: t for t in tools}

    def one(action: str | None) -> tuple[str, float, bool, str]:
        if not action or any(x.strip() for x in ANSWER.findall(action)):
            return "", 0.0, True, "answer" if action else "empty"
        calls = CALL.findall(action)
        if not calls or not calls[-1].strip():
            return "", 0.0, True, "no call"
        try:
            call = json.loads(calls[-1])
        except ValueError:
            return "ERROR: not JSON", 0.0, False, "failed"
        if not isinstance(call, dict) or call.get("name") not in held:
            return "ERROR: unknown tool", 0.0, False, "failed"
        tool = held[call["name"]]()
        if fault := fault_of(call.get("arguments", {}), tool.schema):
            return f"ERROR: {fault}", 0.0, False, "failed"
        try:
            observation, reward, done = tool.execute(call.get("arguments", {}))
        except Exception as error:  # whatever a user's tool raises
            return f"ERROR: {error}", 0.0, False, "failed"
        return str(observation), float(reward), bool(done), "success"

    @F.pandas_udf(STEPPED)
    def run(action: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in action], columns=STEPPED.names)

    return run


#: Reductions by name; users add their own.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop, "median": F.median, "count": F.count}


def reduced(df, group: list[str], wanted: dict[str, list[str]]):
    """One row a group, a column <metric>/<reduction> for each metric and name of a reduction."""
    unknown = {n for names in wanted.values() for n in names} - set(REDUCTIONS)
    if unknown:
        raise ValueError(f"no reductions named {', '.join(sorted(unknown))}")
    return df.groupBy(*group).agg(*(REDUCTIONS[n](F.col(c)).alias(f"{c}/{n}") for c, names in wanted.items() for n in names))
