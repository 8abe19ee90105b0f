"""URL guards and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import first_capture

#: Where job pages are.
HOST = "www.linkedin.com"
ROOT = "/jobs"
ID_PARAMETER = "currentJobId"
ID_PATH = r"/jobs/view/([0-9]+)"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def guard(url: Column, at: str = HOST, root: str = ROOT) -> Column:
    """Whether the URL is valid, on that very host, and at or under the path; never null."""
    p = path(url)
    return F.coalesce((host(url) == at) & ((p == root) | p.startswith(root + "/")), F.lit(False))


def identity(url: Column, parameter: str = ID_PARAMETER, pattern: str = ID_PATH) -> Column:
    """(job_id, source): the query's parameter if it is all digits, else the digits in the path, else empty."""
    query = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter)))
    digits = F.when(query.rlike(r"\A[0-9]+\z"), query)
    found = F.coalesce(digits, first_capture(path(url), pattern), F.lit(""))
    return F.struct(found.alias("job_id"), F.when(digits.isNotNull(), parameter).otherwise("path").alias("source"))
