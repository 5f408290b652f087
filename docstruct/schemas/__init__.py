"""Record schemas and their rules."""

from .records import FORM, VEHICLE, Record, record

__all__ = ["FORM", "VEHICLE", "Record", "record"]
