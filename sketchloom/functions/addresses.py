"""IP addresses, networks and PROXY protocol headers as columns.

IPv4 addresses are longs.  IPv6 goes through Arrow-batched functions, since no built-in
type holds 128 bits.
"""

from __future__ import annotations

import ipaddress
import socket
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a long, or null."""
    part = lambda k: F.regexp_extract(text, IPV4, k).try_cast("long")
    return part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)


def ipv4_text(number: Column) -> Column:
    byte = lambda k: F.shiftright(number, 8 * k).bitwiseAND(F.lit(255))
    return F.concat_ws(".", *(byte(k) for k in (3, 2, 1, 0)))


def ipv4_network(text: Column) -> Column:
    """Struct (lo, hi, prefix) of ``a.b.c.d/n``, or null; host bits are masked."""
    ip = ipv4_number(F.substring_index(text, "/", 1))
    bits = F.regexp_extract(text, r"/(3[0-2]|[12]?[0-9])\z", 1).try_cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - bits)
    lo = ip - F.pmod(ip, size)
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"), bits.alias("prefix")))


def strip_ipv4(number: Column, prefix: int) -> Column:
    """The address masked to its first ``prefix`` bits."""
    return number - F.pmod(number, F.lit(1 << (32 - prefix)))


def masked(text: str | None, v4: int, v6: int) -> str | None:
    """One address of either family masked to the prefix of its family."""
    try:
        x = ipaddress.ip_address(text)
    except ValueError:
        return None
    if not v4 and not v6:
        return None
    if x.version == 6 and x.ipv4_mapped:
        x = x.ipv4_mapped
    bits = v4 if x.version == 4 and v4 else max(0, v6 - 96) if x.version == 4 else v6  # without v4, the mapped address is masked
    return str(ipaddress.ip_network(f"{x}/{bits}", strict=False).network_address)


def strip_address(ip: Column, v4: int, v6: int) -> Column:
    """An address of either family masked to a prefix; null if both prefixes are 0 or it is no address."""

    @F.pandas_udf("string")
    def run(ips: pd.Series) -> pd.Series:
        return pd.Series([masked(x, v4, v6) for x in ips], dtype=object)

    return run(ip)


def proxy_v1(line: Column) -> Column:
    """Struct (family, src, dst, src_port, dst_port) of a PROXY v1 line; UNKNOWN has only its family; else null."""
    port = r"(6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[1-9][0-9]{0,3}|0)"
    whole = rf"\APROXY (TCP4|TCP6) ([0-9a-fA-F.:]+) ([0-9a-fA-F.:]+) {port} {port}\r\n\z"
    part = lambda k: F.regexp_extract(line, whole, k)
    v4 = part(2).rlike(IPV4) & part(3).rlike(IPV4)
    v6 = part(2).contains(":") & part(3).contains(":")
    fits = (F.octet_length(line) <= 107) & (((part(1) == "TCP4") & v4) | ((part(1) == "TCP6") & v6))
    none = F.lit(None)
    fields = lambda f, a, b, c, d: F.struct(f.alias("family"), a.cast("string").alias("src"), b.cast("string").alias("dst"), c.cast("int").alias("src_port"), d.cast("int").alias("dst_port"))
    known = F.when(fits, fields(part(1), part(2), part(3), F.nullif(part(4), F.lit("")), F.nullif(part(5), F.lit(""))))
    return F.when(line.rlike(r"\APROXY UNKNOWN[^\n]*\r\n\z") & (F.octet_length(line) <= 107), fields(F.lit("UNKNOWN"), none, none, none, none)).otherwise(known)


_SIGNATURE = b"\r\n\r\n\x00\r\nQUIT\n"


def parse_proxy_v2(data: bytes | None) -> dict | None:
    """One PROXY v2 header; null if it is malformed."""
    if not data or len(data) < 16 or data[:12] != _SIGNATURE or data[12] not in (0x20, 0x21):
        return None
    size = struct.unpack(">H", data[14:16])[0]
    body = data[16 : 16 + size]
    if len(body) < size:
        return None
    out = {"command": "LOCAL" if data[12] == 0x20 else "PROXY", "family": None, "src": None, "dst": None, "src_port": None, "dst_port": None}
    names = {0x11: ("TCP4", socket.AF_INET, 4), 0x12: ("UDP4", socket.AF_INET, 4), 0x21: ("TCP6", socket.AF_INET6, 16), 0x22: ("UDP6", socket.AF_INET6, 16)}
    if data[13] in names and data[12] == 0x21:
        name, family, n = names[data[13]]
        if size < 2 * n + 4:
            return None
        a, b = (socket.inet_ntop(family, body[k : k + n]) for k in (0, n))
        ports = struct.unpack(">HH", body[2 * n : 2 * n + 4])
        out |= {"family": name, "src": a, "dst": b, "src_port": ports[0], "dst_port": ports[1]}
    elif data[13] not in (0x00, 0x31, 0x32, *names):
        return None
    return out


def proxy_v2(data: Column) -> Column:
    """Struct of a PROXY v2 header; all fields null if malformed, no addresses for local and unix ones."""

    @F.pandas_udf("command string, family string, src string, dst string, src_port int, dst_port int")
    def run(values: pd.Series) -> pd.DataFrame:
        names = ["command", "family", "src", "dst", "src_port", "dst_port"]
        rows = [parse_proxy_v2(x) or dict.fromkeys(names) for x in values]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for c in ("src_port", "dst_port"):
            out[c] = out[c].astype("Int32")
        return out

    return run(data)
