"""Columns over ``host:port`` addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORT = 27017  # fixed value


def is_member_address(address: Column) -> Column:
    """Exactly one colon, a host before it and digits after it; null is not valid."""
    return F.coalesce(address.rlike(r"^[^:]+:[0-9]+$"), F.lit(False))


def host_of(address: Column) -> Column:
    return F.get(F.split(address, ":"), F.lit(0))


def port_of(address: Column) -> Column:
    """Text after the first colon; ports are compared as text."""
    return F.get(F.split(address, ":"), F.lit(1))


def full_address(address: Column, port: Column | None = None) -> Column:
    """The address with a port: its own, else the configured one, else the default."""
    own = F.coalesce(port.cast("string") if port is not None else F.lit(None), F.lit(str(DEFAULT_PORT)))
    return F.when(F.instr(address, ":") > 1, address).otherwise(F.concat(address, F.lit(":"), own))


def display_address(address: Column, port: Column | None = None) -> Column:
    """As full_address, but a server without an address shows as the local one."""
    return full_address(F.coalesce(address, F.lit("localhost")), port)
