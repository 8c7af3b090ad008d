"""Repository URLs, citation links and mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the host.
HOST = "github.com"
#: Fixed value: what an owner or repository may be called.
SEGMENT = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,99}\z"
#: Fixed value: white space as it is stripped.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def parsed_url(raw: Column) -> Column:
    """(provider, owner_name, repo_name, clone_url, reason): all but the reason are null where it is not."""
    url = stripped(raw)
    whole = r"(?is)\Ahttps://@?github\.com(?::0*)?(?:(/[^?#]*))?(?:[?#].*)?\z"
    parts = F.filter(F.split(F.regexp_extract(url, whole, 1), "/"), lambda s: s != "")
    owner, repo = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git\z", "")
    reason = (
        F.when(raw.isNull() | (url == ""), "empty")
        .when(url.rlike(r"[\x00-\x1F]"), "control_character")
        .when(~url.rlike(whole), "not_github_https")
        .when(F.size(parts) != 2, "not_owner_and_repository")
        .when(~owner.rlike(SEGMENT) | ~repo.rlike(SEGMENT), "invalid_name")
    )
    ok = lambda x: F.when(reason.isNull(), x)
    clone = F.concat(F.lit(f"https://{HOST}/"), owner, F.lit("/"), repo, F.lit(".git"))
    return F.struct(ok(F.lit("github")).alias("provider"), ok(owner).alias("owner_name"), ok(repo).alias("repo_name"), ok(clone).alias("clone_url"), reason.alias("reason"))


def encoded(part: Column) -> Column:
    """Percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) alone."""
    out = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def citation(owner: Column, repo: Column, sha: Column, branch: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to the lines of a file at the indexed commit, else the default branch, else main."""
    ref = F.coalesce(F.nullif(sha, F.lit("")), F.nullif(branch, F.lit("")), F.lit("main"))
    places = F.array_join(F.transform(F.split(path, "/"), encoded), "/")
    return F.concat(F.lit(f"https://{HOST}/"), encoded(owner), F.lit("/"), encoded(repo), F.lit("/blob/"), encoded(ref), F.lit("/"), places, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def normal_email(email: Column) -> Column:
    return F.lower(stripped(email))
