"""Errors by the stage in which they arise; each has a code of its series (P, C, T, F, S, E)."""

from __future__ import annotations


class LakevecError(Exception):
    """Any error of this package. location is (line, column) where the query text is to blame."""

    code = "E999"

    def __init__(self, message: str, location: tuple[int, int] | None = None):
        self.message, self.location = message, location
        at = f" at line {location[0]}, column {location[1]}" if location else ""
        super().__init__(f"[{self.code}] {message}{at}")


class ParseError(LakevecError):
    code = "P001"


class UnexpectedToken(ParseError):
    code = "P002"


class UnterminatedString(ParseError):
    code = "P003"


class NestedTooDeep(ParseError):
    code = "P004"


class CatalogError(LakevecError):
    code = "C999"


class TableNotFound(CatalogError):
    code = "C001"


class TableExists(CatalogError):
    code = "C002"


class ColumnNotFound(CatalogError):
    code = "C003"


class AmbiguousColumn(CatalogError):
    code = "C004"


class IndexExists(CatalogError):
    code = "C005"


class IndexNotFound(CatalogError):
    code = "C006"


class NamespaceError(CatalogError):
    code = "C007"


class WriteTargetNotFound(CatalogError):
    code = "C008"


class TypeMismatch(LakevecError):
    code = "T001"


class InvalidOperator(TypeMismatch):
    code = "T002"


class NullViolation(LakevecError):
    code = "T003"


class DimensionMismatch(TypeMismatch):
    code = "T004"


class InvalidMetric(TypeMismatch):
    code = "T005"


class ColumnCountMismatch(TypeMismatch):
    code = "T006"


class Unsupported(LakevecError):
    code = "F001"


class SchemaMismatch(LakevecError):
    code = "S001"


class InvalidOption(LakevecError):
    code = "S002"


class PathNotAllowed(LakevecError):
    code = "S003"


class ConstraintViolation(LakevecError):
    code = "E003"


class TxnConflict(LakevecError):
    code = "E001"


class ReadOnly(LakevecError):
    code = "E002"
