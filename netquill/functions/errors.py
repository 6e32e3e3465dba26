"""Errors that the library raises on the driver."""

from __future__ import annotations


class NetquillError(Exception):
    """Base of all."""


class CaptureError(NetquillError):
    """A capture could not be read."""


class FilterSyntaxError(NetquillError):
    """A filter text could not be parsed; pos is the place in the text or atom."""

    def __init__(self, pos: int, msg: str):
        super().__init__(f"filter syntax error at {pos}: {msg}")
        self.pos, self.msg = pos, msg


class DissectionError(NetquillError):
    """A frame could not be decoded."""


class GeoLookupError(NetquillError):
    """A geo table could not be used."""


class InvalidInterfaceError(NetquillError):
    """No such interface."""
