"""Errors with the codes that clients know."""

from __future__ import annotations


class EngineError(Exception):
    code = 9999

    def __str__(self) -> str:
        return f"{type(self).__name__} ({self.code}): {super().__str__()}"


# fixed values: clients compare these numbers
CODES = {
    "InvalidError": 2,
    "NoResourceError": 3,
    "BusyError": 4,
    "TooBigError": 5,
    "LockError": 6,
    "UnlockError": 7,
    "EofError": 8,
    "NotSupportedError": 9,
    "BadPathError": 10,
    "BadNameError": 11,
    "CatalogError": 21,
    "TimeFormatError": 22,
    "NoSuchScopeError": 23,
    "NoSuchTableError": 24,
    "NoSuchIndexError": 25,
    "KeyNotFoundError": 26,
    "DuplicateKeyError": 27,
    "DuplicateNameError": 28,
    "TimeoutError_": 36,
    "LoaderError": 54,
    "FunctionError": 58,
    "NotFoundError": 59,
    "ParserError": 60,
    "ProcedureError": 71,
    "UnknownSymbolError": 73,
    "UserError": 74,
    "SelfLockError": 75,
    "DeadlockError": 76,
    "NotHolderError": 77,
    "InvalidEscapeError": 78,
}

for _name, _code in CODES.items():
    globals()[_name] = type(_name, (EngineError,), {"code": _code, "__doc__": f"Error code {_code}."})


class TypeMismatchError(EngineError):
    """Operands or values of the wrong type."""

    code = 2
