"""Errors that reach the caller as text."""


class WeftlineError(Exception):
    """Base of all errors raised here."""


class OntologyError(WeftlineError):
    """An ontology can't be read."""


class PlanError(WeftlineError):
    """A schema plan, build or override is wrong."""


class MappingError(WeftlineError):
    """A mapping names something that doesn't exist."""


class CompileError(WeftlineError):
    """An operation can't be turned into a DataFrame plan."""


class ConstraintViolation(WeftlineError):
    """A write would break a constraint."""


class StoreError(WeftlineError):
    """A store can't be read or written."""
