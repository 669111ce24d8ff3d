"""URL keys, hosts and HTTP outcomes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# HTTP statuses by meaning.
DEAD_STATUSES = (404, 410, 451)
BLOCKED_STATUSES = (401, 403)
RETRYABLE_STATUSES = (408, 425, 429)
# A URL that is its own key: nothing to lower, drop or add.
PLAIN_URL = r"^https?://[a-z0-9.-]+/[^?#]*(\?[^#]+)?\z"


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"(?i)^https?://([^/?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """One key per page: scheme and host in lower case, no default port, no fragment, ``/``
    for an empty path; query and user part kept. Anything but http(s) and any bad port
    gives an empty key. Most URLs are their own key, which one match tells; only others are taken apart."""
    return F.when(F.trim(url).rlike(PLAIN_URL), F.trim(url)).otherwise(_rebuilt(url))


def _rebuilt(url: Column) -> Column:
    """The key of any URL from its parts."""
    raw = F.trim(url)
    scheme = F.lower(F.regexp_extract(raw, r"(?i)^(https?)://", 1))
    whole = authority(url)
    place = F.regexp_extract(whole, r"([^@]*)$", 1)
    user_part = F.regexp_extract(whole, r"^(.*)@", 1)
    user = F.substring_index(user_part, ":", 1)
    password = F.regexp_extract(user_part, r"^[^:]*:(.*)$", 1)
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[\]]*)", 1))
    rest = F.substring(place, F.length(host) + 1, F.length(place))
    port = F.regexp_extract(rest, r"^:([0-9]*)$", 1)
    port_number = F.nullif(port, F.lit("")).try_cast("bigint")
    bad = (
        (scheme == "") | (F.regexp_replace(host, r"[\[\]]", "") == "")
        | ((rest != "") & ~rest.rlike(r"^:[0-9]*$")) | F.coalesce(port_number > 65535, F.lit(False))
        | ((port != "") & port_number.isNull())
    )
    default = ((scheme == "http") & (port_number == 80)) | ((scheme == "https") & (port_number == 443))
    shown_port = F.when(
        port_number.isNotNull() & ~F.coalesce(default, F.lit(False)),
        F.concat(F.lit(":"), port_number.cast("string"))).otherwise("")
    shown_user = F.when(user != "", F.concat(
        user, F.when(password != "", F.concat(F.lit(":"), password)).otherwise(""), F.lit("@"),
    )).otherwise("")
    path = F.regexp_extract(raw, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(raw, r"^[^?#]*(\?[^#]+)", 1)
    return F.when(bad, "").otherwise(F.concat(
        scheme, F.lit("://"), shown_user, host, shown_port,
        F.when(path == "", "/").otherwise(path), query))


def hostname(url: Column) -> Column:
    """The lower-case host without user, port or brackets."""
    place = F.regexp_extract(authority(url), r"([^@]*)$", 1)
    return F.lower(F.regexp_extract(place, r"^\[?([^\]:]*)", 1))


def outlet(url: Column) -> Column:
    """The host without a leading ``www.``: one outlet, however addressed."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def slug_words(url: Column) -> Column:
    """What follows the host, with word separators as blanks."""
    return F.regexp_replace(F.regexp_replace(url, r"^[^/]*/[^/]*/[^/]*/", ""), r"[-_/]", " ")


def is_alive(status: Column) -> Column:
    return status.isNotNull() & ~status.isin(*DEAD_STATUSES)


def outcome_class(status: Column) -> Column:
    """What a fetch status means for the article store."""
    return (
        F.when(status.isNull(), "retryable_error")
        .when(status.isin(*DEAD_STATUSES), "dead")
        .when(status.isin(*BLOCKED_STATUSES), "blocked")
        .when(status.isin(*RETRYABLE_STATUSES) | (status >= 500), "retryable_error")
        .when((status < 200) | (status >= 400), "http_error")
        .otherwise("fetched")
    )
