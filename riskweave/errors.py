"""Errors of the engine. Loading collects problems as rows of a violations table; strict loading raises the first one."""

from __future__ import annotations


class RiskError(Exception):
    """Any problem of the engine; ``code`` is the name that a violations row carries."""

    @property
    def code(self) -> str:
        return type(self).__name__


class IOError_(RiskError):
    """A file is missing, given twice, or not readable."""

    code = "IOError"


class DLError(RiskError):
    """A function of an external library is not there."""


class LogicError(RiskError):
    """The interface is used in a way that it does not allow."""


class IllegalOperation(RiskError):
    """An operation that the settings forbid."""


class SettingsError(RiskError):
    """A setting is out of its range or contradicts another."""


class VersionError(RiskError):
    """An input format that is not supported."""


class ValidityError(RiskError):
    """A model is not valid."""


class DuplicateElementError(ValidityError):
    """Two elements share an identifier."""


class UndefinedElement(ValidityError):
    """A reference to an element that is not there."""


class CycleError(ValidityError):
    """Elements refer to each other in a circle."""


class DomainError(ValidityError):
    """A value or its range is outside what its place allows."""


#: Kinds of XML errors and their keywords. Text that is not well-formed, a wrong use of the reader, a file
#: that cannot be opened, an inclusion that fails, and a document that a validator turns down.
XML_KINDS = {
    "unknown": "UnknownError",
    "parse": "ParseError",
    "logic": "LogicError",
    "io": "IOError",
    "xinclude": "XIncludeError",
    "validity": "ValidityError",
}


class XmlError(ValidityError):
    """A file cannot be read as XML; ``kind`` is one of ``XML_KINDS``, anything else counts as unknown."""

    def __init__(self, message: str, kind: str = "unknown"):
        super().__init__(message)
        self.kind = kind if kind in XML_KINDS else "unknown"

    @property
    def keyword(self) -> str:
        return XML_KINDS[self.kind]


BY_CODE = {
    c.__name__ if c is not IOError_ else "IOError": c
    for c in (IOError_, DLError, LogicError, IllegalOperation, SettingsError, VersionError, ValidityError, DuplicateElementError, UndefinedElement, CycleError, DomainError, XmlError)
}


def of_violation(code: str, entity: str, detail: str, place: str) -> RiskError:
    """A row of a violations table as an error; the detail of an XML error begins with its keyword."""
    message = f"{entity}: {detail} ({place})"
    if code == "XmlError":
        kinds = {keyword: kind for kind, keyword in XML_KINDS.items()}
        return XmlError(message, kinds.get((detail or "").split(":")[0], "unknown"))
    return BY_CODE.get(code, RiskError)(message)
