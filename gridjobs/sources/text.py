"""Text columns: masking secrets in URLs and free text: what follows the ``=`` of a secret parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of parameters whose values are secret, in URLs and in free text.
SECRET_URL_PARAMS = ("api_key", "apikey", "token", "subscription-key", "access_token", "password", "secret")
SECRET_TEXT_PARAMS = ("api_key", "apikey", "token", "subscription-key", "access_token", "password")


def _lower(c: Column) -> Column:
    """ASCII lower case, so that places in the result are places in the text."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def redact_url(url: Column) -> Column:
    """Values of secret parameters in the query part of a URL become REDACTED."""
    names = F.array(*map(F.lit, SECRET_URL_PARAMS))

    def mask(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        return F.when((name != pair) & F.array_contains(names, _lower(name)), F.concat(name, F.lit("=REDACTED"))).otherwise(pair)

    address = F.substring_index(url, "#", 1)
    fragment = F.substr(url, F.length(address) + 1)
    page = F.substring_index(address, "?", 1)
    query = F.substr(address, F.length(page) + 2)
    clean = F.concat_ws("&", F.transform(F.split(query, "&"), mask))
    return F.when(page == address, url).otherwise(F.concat(page, F.lit("?"), clean, fragment))


def redact_text(text: Column) -> Column:
    """name=value of secret names in free text becomes name=REDACTED; a value ends at white space, & or a quote."""
    # Starts at the rare "=" and looks back for the name: no place of a long text is tried with every name.
    names = "|".join(re.escape(name) for name in SECRET_TEXT_PARAMS)
    return F.regexp_replace(text, rf"""=(?<=(?i:{names})=)[^\s&"']+""", "=REDACTED")
