"""Errors of data and of sampling, which flows tell apart from faults of code."""


class DataQualityError(Exception):
    """A column as a whole is unfit: missing, or null too often."""


class SamplingError(Exception):
    """The pool can't give the sample that is asked for."""
