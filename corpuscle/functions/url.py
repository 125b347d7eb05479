"""Repository URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts taken for repositories even without a .git suffix.
GIT_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]

# Fixed value: the characters a repository id may have.
_REPO_ID = r"^[a-zA-Z0-9._-]+$"

_HTTP_URL = (
    r"(?i)^https?://(?:[^\s/@:]+(?::[^\s/@]*)?@)?"
    r"(?:(?:[\p{L}\p{N}](?:[\p{L}\p{N}_-]*[\p{L}\p{N}])?\.)+\p{L}{2,}|\d{1,3}(?:\.\d{1,3}){3})"
    r"(?::\d{1,5})?(?:[/?#][^\s<>]*)?$"
)
_HTTP_HOST = r"(?i)^https?://(?:[^/?#@\s]*@)?([^\s/?#:@<>\[\]\\^|%]+|\[[0-9a-f:.]+\])(?=[/?#:]|$)"


def repo_id(url: Column) -> Column:
    """Last path segment without ``.git``; null where it holds unusual characters."""
    trimmed = F.rtrim(url, F.lit("/"))
    last = F.substring_index(trimmed, "/", -1)
    bare = F.length(last) - F.length(F.lit(".git"))
    segment = F.when(last.endswith(".git") & (bare > 0), F.substring(last, F.lit(1), bare)).otherwise(last)
    return F.when(trimmed.contains("/") & segment.rlike(_REPO_ID), segment)


def is_git_url(url: Column) -> Column:
    """http(s) URL that ends in ``.git`` or whose host names a known code host."""
    host = F.lower(F.regexp_extract(url, _HTTP_HOST, 1))
    known = F.lit(False)
    for name in GIT_HOSTS:
        known = known | host.contains(name)
    return F.coalesce((host != "") & (url.endswith(".git") | known), F.lit(False))


def is_http_url(url: Column) -> Column:
    """http(s) URL with a host that has a top-level domain, or an IPv4 host."""
    return F.coalesce(url.rlike(_HTTP_URL) & (F.length(url) <= 2083), F.lit(False))
