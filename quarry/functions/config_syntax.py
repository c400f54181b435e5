"""Whether a configuration file parses: JSON (with // comments), TOML and INI; other kinds are not checked."""

import configparser
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def error_of(path: str, text: str) -> str:
    """The parser's complaint, or ""."""
    try:
        if path.endswith(".json"):
            json.loads(re.sub(r"^\s*//.*$", "", text, flags=re.M))
        elif path.endswith(".toml"):
            tomllib.loads(text)
        elif path.endswith((".ini", ".cfg", ".conf")):
            parser = configparser.ConfigParser(interpolation=None, allow_no_value=True)
            parser.read_string(text if re.match(r"\s*\[", text) else f"[default]\n{text}")
    except (ValueError, configparser.Error, RecursionError) as e:
        return (str(e) or type(e).__name__)[:200]
    return ""


def _errors(path: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([error_of(p, t or "") for p, t in zip(path, text, strict=True)], dtype=object)


def syntax_error(path: str, text: str) -> Column:
    return F.pandas_udf(_errors, "string")(path, text)
