"""URL filter: pattern rules are indexed by their rarest literal token; a URL's tokens fetch the few rules that are tried.

A rule is (action, host, path).  It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's.  Each rule becomes a
regular expression over `host path`, and stands in the index under that one of
its literal tokens (labels of the host, whole segments of the path) which the
fewest URLs of the table have.  A URL's own tokens look the index up, only the
rules found run their expressions, and the longest fitting rule (host and path
together, then the longer host, then the text) gives the verdict; without one,
the verdict is `default`.

A URL's host is what lies between the first `://` and the next `/`, `?`, `#` or
the end, A-Z lower-cased; its path follows, up to `?`, `#` or the end.  Null
URLs and those without `://` have an empty host and path and fit no rule.
Repeated rows and null ids each give a row; an empty table or rule list is
fine.  All is done by DataFrame functions in one narrow pass after the
counting of the rules' tokens.  The index is one literal: an array of buckets
by the crc32 of the token, so that a token looks at the few entries of one
bucket however many rules there are.  It grows with the list of rules, which
the caller holds, by some 200 bytes a rule, and not with the table.
"""

from __future__ import annotations

import json
import re
import string
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry of the index.
RULE = "struct<token:string,size:int,host_size:int,rule:string,action:string,pattern:string>"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Labels of the host as `.label`, segments of the path that end with a slash as `/segment`."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    parts = F.split(path, "/")
    closed = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_distinct(F.concat(labels, F.transform(closed, lambda x: F.concat(F.lit("/"), x))))


def rule_tokens(host: str, path: str) -> list[str]:
    """The literal tokens that every URL which fits the rule has."""
    return [f".{x}" for x in host.split(".")] + [f"/{x}" for x in path.split("/")[:-1]]


def buckets_of(entries: list[tuple[str, object]], kind: str) -> tuple[Column, int]:
    """Entries dealt to buckets by the crc32 of their tokens, as a literal array of arrays of kind, and how many buckets."""
    n = max(len(entries), 1)
    dealt: list[list] = [[] for _ in range(n)]
    for token, entry in entries:
        dealt[zlib.crc32(token.encode()) % n].append(entry)
    return F.from_json(F.lit(json.dumps(dealt)), f"array<array<{kind}>>"), n


def bucket(buckets: tuple[Column, int], token: Column) -> Column:
    """The entries of the bucket in which a token would stand."""
    table, n = buckets
    return F.get(table, (F.crc32(token.cast("binary")) % n).cast("int"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: the id, host, path, rule (host and path as one string; null if none fits), verdict."""
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not rules:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tokens = tokens_of(F.col("host"), F.col("path"))
    wanted = buckets_of([(t, t) for t in sorted({t for _, host, path in rules for t in rule_tokens(host, path)})], "string")
    counted = urls.select(F.explode(F.filter(tokens, lambda t: F.array_contains(bucket(wanted, t), t))).alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.toLocalIterator()}  # at most as many as the rules have tokens
    entries = []
    for action, host, path in rules:
        rarest = min(rule_tokens(host, path), key=lambda t: (seen.get(t, 0), t))
        pattern = rf"(?s)^(?:[^ ]*\.)?{re.escape(host)} {re.escape(path)}"
        entries.append((rarest, {"token": rarest, "size": len(host) + len(path), "host_size": len(host), "rule": host + path, "action": action, "pattern": pattern}))
    index = buckets_of(entries, RULE)
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(bucket(index, t), lambda r: r["token"] == t)))
    subject = F.concat_ws(" ", "host", "path")
    fitting = F.filter(fetched, lambda r: F.regexp_like(subject, r["pattern"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    judged = urls.withColumn("best", best)
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
