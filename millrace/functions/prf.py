"""Keyed pseudo-random functions as Column expressions, with the same text for DuckDB, and the seeds of clients.

All randomness of the package is a hash of (seed, domain, epoch, id), so results
depend on the data and the seed, never on how Spark lays the rows out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "v1"
HEX_OF_UNIT = 13
HEX_OF_MOD = 12


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def prf_key(seed: int, domain: str, epoch, *ids) -> Column:
    parts = [F.lit(VERSION), F.lit(str(seed)), F.lit(domain), _column(epoch).cast("string"), *(F.coalesce(_column(i).cast("string"), F.lit("")) for i in ids)]
    return F.concat_ws("|", *parts)


def prf_hex(seed: int, domain: str, epoch, *ids) -> Column:
    """64 hexadecimal digits; their order is the order of a uniform permutation."""
    return F.sha2(prf_key(seed, domain, epoch, *ids), 256)


def prf_unit(seed: int, domain: str, epoch, *ids) -> Column:
    """A double in [0, 1)."""
    digits = F.substring(F.md5(prf_key(seed, domain, epoch, *ids)), 1, HEX_OF_UNIT)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HEX_OF_UNIT))


def prf_mod(seed: int, domain: str, epoch, modulus, *ids) -> Column:
    """An integer in [0, modulus)."""
    digits = F.substring(prf_hex(seed, domain, epoch, *ids), 1, HEX_OF_MOD)
    return F.conv(digits, 16, 10).cast("long") % _column(modulus)


def client_seed(seed: int, client: str) -> int:
    """The seed of one client of many: its streams differ from the others', and whoever knows it can run them again."""
    digits = hashlib.sha256("|".join((VERSION, str(seed), "client", "0", client)).encode()).hexdigest()[:HEX_OF_MOD]
    return int(digits, 16)


def sql_key(seed: int, domain: str, epoch, *ids: str) -> str:
    return "concat_ws('|', " + ", ".join([f"'{VERSION}'", f"'{seed}'", f"'{domain}'", f"CAST({epoch} AS VARCHAR)", *(f"coalesce(CAST({i} AS VARCHAR), '')" for i in ids)]) + ")"


def sql_hex(seed: int, domain: str, epoch, *ids: str) -> str:
    return f"sha256({sql_key(seed, domain, epoch, *ids)})"


def sql_unit(seed: int, domain: str, epoch, *ids: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({sql_key(seed, domain, epoch, *ids)}), 1, {HEX_OF_UNIT}) AS BIGINT) AS DOUBLE) / {16**HEX_OF_UNIT}.0)"


def sql_mod(seed: int, domain: str, epoch, modulus, *ids: str) -> str:
    return f"(CAST('0x' || substr({sql_hex(seed, domain, epoch, *ids)}, 1, {HEX_OF_MOD}) AS BIGINT) % ({modulus}))"
