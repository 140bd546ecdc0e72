"""HTTP status and error classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorlake.fixed_values import REACHABLE


def status_verdict(code: Column) -> Column:
    return (
        F.when(code.isNull(), "ERROR")
        .when(code.between(200, 299) | code.isin(300, 304), "LIVE")
        .when(code.isin(301, 308), "REDIRECT_PERM")
        .when(code.isin(302, 303, 307), "REDIRECT_TEMP")
        .when(code.isin(401, 403), "BLOCKED")
        .when(code == 410, "GONE")
        .when(code == 429, "RATE_LIMITED")
        .when(code.between(400, 499), "DEAD")
        .when(code.between(500, 599), "SERVER_ERROR")
        .otherwise("ERROR")
    )


def error_verdict(message: Column) -> Column:
    """Tell a vanished name and a broken certificate apart from other failures."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.contains("dns") | low.contains("does not resolve"), "DNS_ERROR")
        .when(low.contains("ssl") | low.contains("certificate"), "SSL_ERROR")
        .otherwise("ERROR")
    )


def short_error(kind: Column, message: Column) -> Column:
    """Normalise a raw client exception (its class and text) to one short phrase."""
    low = F.lower(message)
    detail = F.trim(F.substring_index(message, "(", 1))
    return (
        F.when(message.contains("Name or service not known")
               | message.contains("nodename nor servname"), "DNS: domain does not resolve")
        .when(message.contains("certificate verify failed")
              | kind.contains("SSLError"), "SSL certificate error")
        .when(message.contains("Connection refused"), "connection refused")
        .when(low.contains("timed out") | kind.contains("Timeout"), "timeout")
        .when(message.contains("Exceeded") & low.contains("redirect"),
              "too many redirects (redirect loop)")
        .when(message.contains("Connection aborted")
              | message.contains("RemoteDisconnected"), "connection aborted by server")
        .otherwise(F.concat(kind, F.lit(": "), detail))
    )


def status_group(verdict: Column) -> Column:
    return (
        F.when(verdict == "LIVE", "200")
        .when(verdict.startswith("REDIRECT"), "3xx")
        .when(verdict.isin("DEAD", "GONE"), "404")
        .when(verdict == "SERVER_ERROR", "5xx")
        .when(verdict.isin("BLOCKED", "RATE_LIMITED"), "blocked")
        .when(verdict == "DNS_ERROR", "dns")
        .when(verdict == "SSL_ERROR", "tls")
        .otherwise("error")
    )


def is_reachable(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(REACHABLE), F.lit(False))
