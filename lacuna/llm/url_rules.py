"""URL filter rules indexed by their rarest literal token.

A rule is a regular expression with the whole tokens that any URL it fits must contain; host rules and lines of the usual
filter-list syntax are compiled to that form. The index is a table that keeps a rule under that one of its tokens which the
fewest URLs contain; a URL's tokens fetch candidate rules by a join, and only those run their expressions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import materialise

#: The characters of a token.
TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules up to which the index is broadcast; a larger one is joined by shuffle.
INDEX_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """name; verdict; expression; whole tokens in each match, lower-cased; length, by which host rules are ranked (0: a
    pattern); on_url: the expression runs on the URL, else on host and path."""

    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]
    length: int = 0
    on_url: bool = False


def host_rule(text: str, verdict: str) -> Rule:
    """A rule such as `example.org/es/`: it fits the host and its subdomains if the path starts with the rule's path."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = re.findall(TOKEN, path)
    if whole and re.search("[A-Za-z0-9]$", path):  # the URL's token may go on
        whole.pop()
    return Rule(text, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(t.lower() for t in (*re.findall(TOKEN, host), *whole)), len(text))


def filter_rule(line: str) -> Rule:
    """A line of a filter list: `||` begins at a label of the host, `|` at an end of the URL, `^` stands for a separator or the end,
    `*` for anything; `@@` before it allows what it fits; `$match-case` after it keeps the case of letters."""
    body, _, options = line.partition("$")
    if options not in ("", "match-case"):
        raise ValueError(f"unknown option in {line}")
    verdict, body = ("allow", body[2:]) if body.startswith("@@") else ("block", body)
    parts, rest = [], body
    if rest.startswith("||"):
        parts, rest = [r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"], rest[2:]
    elif rest.startswith("|"):
        parts, rest = ["^"], rest[1:]
    end = rest.endswith("|")
    rest = rest[:-1] if end else rest
    for c in rest:
        parts.append({"*": ".*", "^": r"([^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)))
    if not rest.strip("*"):
        raise ValueError(f"nothing to look for in {line}")
    # A run of letters and digits is a whole token of the URL unless the rule leaves open what stands beside it.
    closed = lambda at: at in range(len(rest)) and rest[at] != "*"
    tokens = [m.group().lower() for m in re.finditer(TOKEN, rest) if (closed(m.start() - 1) or not m.start() and parts[0][:1] == "^") and (closed(m.end()) or end and m.end() == len(rest))]
    return Rule(line, verdict, ("" if options else "(?i)") + "".join(parts) + "$" * end, tuple(tokens), on_url=True)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """i (from 1, in order), name, verdict, expression, tokens, length, on_url: what judge_urls() takes, from a list or a stored table."""
    kind = "i int, name string, verdict string, expression string, tokens array<string>, length int, on_url boolean"
    rows = [{"i": i, "name": r.name, "verdict": r.verdict, "expression": r.expression, "tokens": r.tokens, "length": r.length, "on_url": r.on_url} for i, r in enumerate(rules, 1)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with `token`, the one of their tokens that the fewest rows of urls (tokens) have; of equals the least, none: ''."""
    each = rules.select("i", F.explode_outer("tokens").alias("token")).select("i", F.coalesce("token", F.lit("")).alias("token"))
    wanted = each.select("token").distinct()
    # Counted before anything is joined, so that a token of all URLs is one row of each task.
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token", "left_semi")
    rarest = each.join(seen, "token", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.drop("tokens").join(rarest, "i")


def judge_urls(pages: DataFrame, rules: DataFrame | list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (the longest fitting host rule or null), pattern (of the fitting patterns the first that allows,
    else the first that blocks; or null), verdict.

    The verdict is the host rule's; else that of the pattern; else `default`. A null URL or one without `://` has an empty
    host and path, and no rule fits it. Equal lengths go to the earlier rule. Distinct URLs are judged once each, so a URL on a
    third of all pages costs one join row. Repeated rows come out each; other columns are not read; an empty table gives no
    rows, an empty rule list the default. The index is broadcast up to INDEX_BYTES of rules, and joined by shuffle beyond.
    """
    rules = rule_table(pages.sparkSession, rules) if isinstance(rules, list) else rules
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("url"), F.lit(TOKEN), 0)))
    host, path = split_url(F.col("url"))
    urls = materialise(base.select("url").where(F.instr("url", "://") > 0).distinct().select("url", F.concat(host, path).alias("target"), tokens.alias("tokens")), "urls")
    index = materialise(rule_index(rules, urls), "rules")
    size = index.agg(F.sum(F.octet_length("expression") + F.octet_length("name") + 64)).first()[0] or 0
    fetched = urls.select("url", "target", F.explode("tokens").alias("token")).join(F.broadcast(index) if size <= INDEX_BYTES else index, "token")
    fits = fetched.where(F.regexp_like(F.when(F.col("on_url"), F.col("url")).otherwise(F.col("target")), F.col("expression")))
    best = lambda order: F.min(F.struct(*order, "i", "name", "verdict"))
    judged = fits.groupBy("url").agg(
        best([F.when(F.col("length") == 0, 1).otherwise(0).alias("o"), (-F.col("length")).alias("n")]).alias("h"),
        best([F.when(F.col("length") > 0, 1).otherwise(0).alias("o"), F.when(F.col("verdict") == "allow", 0).otherwise(1).alias("n")]).alias("p"),
    )
    judged = judged.select("url", F.when(F.col("h.o") == 0, F.col("h")).alias("h"), F.when(F.col("p.o") == 0, F.struct("p.name", "p.verdict")).alias("p"))
    return base.join(judged, "url", "left").select(
        F.col("id").alias(id_col),
        host.alias("host"),
        path.alias("path"),
        F.col("h.name").alias("rule"),
        F.col("p.name").alias("pattern"),
        F.coalesce("h.verdict", "p.verdict", F.lit(default)).alias("verdict"),
    )
