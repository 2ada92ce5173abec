"""Typed failures of the engine; each carries the name of its condition.

Principle: fail closed.  An operator that can't keep its promise raises; it never turns an error
into a value that looks like success.
"""

from __future__ import annotations

import re


class MillraceError(Exception):
    condition = "ENGINE_ERROR"

    def __init__(self, message: str, **details):
        super().__init__(f"[{self.condition}] {message}")
        self.details = details


def _kind(name: str, condition: str, doc: str) -> type[MillraceError]:
    return type(name, (MillraceError,), {"condition": condition, "__doc__": doc, "__module__": __name__})


MultipleSourceRowsMatched = _kind("MultipleSourceRowsMatched", "MULTIPLE_SOURCE_ROW_MATCHING_TARGET_ROW_IN_MERGE", "Two source rows of a merge would update one target row.")
DuplicateColumns = _kind("DuplicateColumns", "DUPLICATE_COLUMNS_FOUND", "Two columns of a write share a name.")
UnsupportedOutputMode = _kind("UnsupportedOutputMode", "UNSUPPORTED_OUTPUT_MODE", "A stream's output mode can't be written to this sink.")
NotNullViolated = _kind("NotNullViolated", "NOT_NULL_CONSTRAINT_VIOLATED", "A NULL in a column declared NOT NULL.")
CheckViolated = _kind("CheckViolated", "VIOLATE_CONSTRAINT_WITH_VALUES", "A row for which a CHECK isn't true.")
MissingNotNullColumn = _kind("MissingNotNullColumn", "MISSING_NOT_NULL_COLUMN_VALUE", "A write lacks a column declared NOT NULL.")
SchemaMismatch = _kind("SchemaMismatch", "SCHEMA_MISMATCH", "A write's columns don't fit the table and evolution isn't allowed.")
TableNotFound = _kind("TableNotFound", "TABLE_OR_VIEW_NOT_FOUND", "No table at this place.")
VersionNotFound = _kind("VersionNotFound", "VERSION_NOT_FOUND", "The table has no such version.")
ConcurrentWrite = _kind("ConcurrentWrite", "CONCURRENT_WRITE", "Another writer committed this version first.")
NotAppendOnly = _kind("NotAppendOnly", "STREAM_SOURCE_NOT_APPEND_ONLY", "A stream would read rewritten rows again.")
FanOut = _kind("FanOut", "JOIN_FAN_OUT", "A join changed the number of rows that it must keep.")
DuplicateKeys = _kind("DuplicateKeys", "DUPLICATE_DIMENSION_KEYS", "The unique side of a join has repeated keys.")
UnknownKey = _kind("UnknownKey", "UNKNOWN_LOOKUP_KEY", "A lookup meets a key that its map lacks.")
QualityGateFailed = _kind("QualityGateFailed", "QUALITY_GATE_FAILED", "A measured rate is beyond its threshold.")
AmbiguousRule = _kind("AmbiguousRule", "AMBIGUOUS_RULE", "A rule is NULL on a row of NULLs.")
ContractViolated = _kind("ContractViolated", "CONTRACT_VIOLATED", "A schema differs from its contract.")
NondeterministicPlan = _kind("NondeterministicPlan", "NONDETERMINISTIC_PLAN", "A plan picks an arbitrary row.")
UnknownColumn = _kind("UnknownColumn", "UNRESOLVED_COLUMN", "A column that isn't there; no other is put in its place.")
InvalidSpec = _kind("InvalidSpec", "INVALID_SPEC", "A pipeline or metric specification is not valid.")
MissingWatermark = _kind("MissingWatermark", "MISSING_WATERMARK", "A stateful stream without a bound on its state.")


def error_class(error: BaseException) -> str:
    """The condition of an engine or Spark error; its type's name if it carries none."""
    if isinstance(error, MillraceError):
        return error.condition
    for name in ("getCondition", "getErrorClass"):
        if callable(get := getattr(error, name, None)):
            try:
                if found := get():
                    return found
            except Exception:  # some errors have the method, but no JVM object to ask
                break
    found = re.search(r"\[([A-Z][A-Z0-9_]+(?:\.[A-Z0-9_]+)*)\]", str(error))
    return found[1] if found else type(error).__name__


def attempt(action) -> tuple[bool, object]:
    """(True, result), or (False, condition); for tests and reports, never to go on as if all were well."""
    try:
        return True, action()
    except Exception as error:
        return False, error_class(error)
