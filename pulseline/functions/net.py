"""IP address helpers."""

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

V4_PATTERN = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def is_ipv4(c) -> Column:
    return F.col(c).rlike(V4_PATTERN)


def ipv6_network64(address) -> Column:
    """The /64 network of an IPv6 address column; null when the text is not one."""

    def network(text: str) -> str | None:
        try:
            whole = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        return str(ipaddress.IPv6Network((whole >> 64 << 64, 64)))

    # Defined inside, so workers get the code itself and need no copy of this package.
    @F.pandas_udf(T.StringType())
    def networks(addresses: pd.Series) -> pd.Series:
        return addresses.map(network, na_action="ignore")

    return networks(address)
