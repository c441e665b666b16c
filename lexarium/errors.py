"""Errors on the driver, and the error struct of rows that failed on a worker."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from enum import IntEnum
from functools import wraps
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Category(IntEnum):
    """Kinds of errors; a code is a hundred times the kind, and a number. The names and numbers are fixed values."""

    CONFIGURATION = 1
    DATA_ACCESS = 2
    EXTERNAL_SERVICE = 3
    INPUT_VALIDATION = 4
    INTERNAL = 5
    MODEL = 6
    PIPELINE = 7
    VECTORSTORE = 8
    DOCUMENT_PROCESSING = 9


#: What a foreign exception is taken for.
KNOWN = ((FileNotFoundError, Category.DATA_ACCESS, 1), (PermissionError, Category.DATA_ACCESS, 2), (NotImplementedError, Category.INTERNAL, 2), (KeyError, Category.INPUT_VALIDATION, 2), (ValueError, Category.INPUT_VALIDATION, 1), (ConnectionError, Category.EXTERNAL_SERVICE, 1))


class LexariumError(Exception):
    """An error with a code such as 701, details, and what caused it."""

    def __init__(self, message: str, category: Category = Category.INTERNAL, number: int = 1, **details: Any):
        super().__init__(message)
        self.category, self.code, self.details = category, 100 * category + number, details

    def as_dict(self) -> dict[str, Any]:
        cause = self.__cause__
        return {"code": self.code, "category": self.category.name, "message": str(self), "details": self.details} | ({"cause": f"{type(cause).__name__}: {cause}"} if cause else {})


def converted(error: Exception) -> LexariumError:
    """A foreign exception as one of ours; ours as it is."""
    if isinstance(error, LexariumError):
        return error
    category, number = next(((c, n) for kind, c, n in KNOWN if isinstance(error, kind)), (Category.INTERNAL, 1))
    out = LexariumError(str(error), category, number)
    out.__cause__ = error
    return out


def guarded(default: Any = None, reraise: bool = True) -> Callable[[Callable], Callable]:
    """Log and convert what a function raises; without reraise it gives the default instead."""

    def wrap(function: Callable) -> Callable:
        @wraps(function)
        def run(*args: Any, **kwargs: Any) -> Any:
            try:
                return function(*args, **kwargs)
            except Exception as e:  # noqa: BLE001
                error = converted(e)
                logging.getLogger(__name__).error("%s", json.dumps(error.as_dict(), default=str))
                if reraise:
                    raise error from e
                return default

        return run

    return wrap


def error_column(condition: Column, category: Category, number: int, message: str) -> Column:
    """STRUCT<code, message> where the condition holds, else null: failed rows stay in their table."""
    return F.when(condition, F.struct(F.lit(100 * category + number).alias("code"), F.lit(message).alias("message")))


class JsonFormatter(logging.Formatter):
    """Log records as one JSON object a line, with what is in their `context`."""

    def format(self, record: logging.LogRecord) -> str:
        row = {"level": record.levelname, "logger": record.name, "message": record.getMessage()} | getattr(record, "context", {})
        return json.dumps(row | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}), default=str)
