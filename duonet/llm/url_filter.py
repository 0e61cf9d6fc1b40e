"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path``. From its pattern come the literal tokens that every match must
hold as whole tokens; the token that is rarest over the table's own urls indexes the rule. A url's tokens fetch candidate
rules, and only those run their expression. Rules without such a token are candidates for every url; none of the registered
query's is one.

Defined results: a null url, or one without ``://``, has an empty host and path; it meets only rules that match the empty
string. Host letters A-Z are lower-cased, nothing else is. Among matching rules the largest ``(priority, name)`` wins;
without one the verdict is the default. Every input row gives one output row, repeated rows included; an empty table gives
none. Only the id and url columns are read, so other columns can have any names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duonet.llm._common import ascii_lower, table

#: Up to so many rules travel inside the plan as a literal map; larger sets are joined as a table.
MAX_INLINE_RULES = 500


@dataclass(frozen=True)
class UrlRule:
    name: str
    action: str
    pattern: str
    priority: int = 0


def domain_rule(action: str, rule: str) -> UrlRule:
    """``host/path``: fits the host and all its subdomains where the url's path starts with the rule's; the longest wins."""
    host, _, path = rule.partition("/")
    quoted = re.sub(r"([^A-Za-z0-9])", r"\\\1", f"{host}/{path}")
    return UrlRule(rule, action, rf"\A(?:[^/]*\.)?{quoted}", 1000 + len(rule))


#: What a parsed pattern consists of: a literal character; a place that only stands between tokens (an anchor); a group of
#: alternatives, each a list of such items; and anything else, which may match any text.
ANCHOR, ANYTHING = "anchor", "anything"


@dataclass(frozen=True)
class Group:
    alternatives: tuple[tuple, ...]
    optional: bool


def _parse(pattern: str, i: int = 0) -> tuple[tuple[tuple, ...], int]:
    """The alternatives from place i up to the closing bracket or the end, and where that is."""
    done: list[tuple] = []
    items: list = []
    while i < len(pattern) and pattern[i] != ")":
        c, i = pattern[i], i + 1
        if c == "|":
            done.append(tuple(items))
            items = []
            continue
        if c == "\\":
            c, i = pattern[i : i + 1], i + 1
            if c.isdigit() or c in ("Q", "k"):
                raise ValueError("back references and quoted parts are not read")
            item = ANCHOR if c in ("A", "z", "b") else ANYTHING if c.isalnum() else c
        elif c == "[":
            i += pattern[i : i + 1] == "^"
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
            i, item = i + 1, ANYTHING
        elif c == "(":
            named = re.match(r"\?(:|<[A-Za-z]\w*>)?", pattern[i:])
            plain = named is None or named.group(1)
            if re.match(r"\?[a-zA-Z]", pattern[i:]):
                raise ValueError("inline flags are not read")
            inside, i = _parse(pattern, i + (named.end() if named and named.group(1) else 0))
            i, item = i + 1, Group(inside, False) if plain else ANYTHING
        else:
            item = ANCHOR if c in "^$" else ANYTHING if c == "." else c
        times = re.match(r"(?:[*?+]|\{\d+(?:,\d*)?\})[?+]?", pattern[i:])
        if times:
            i += times.end()
            least = 0 if times.group()[0] in "*?" else 1 if times.group()[0] == "+" else int(re.match(r"\{(\d+)", times.group()).group(1))
            item = Group(item.alternatives, not least) if isinstance(item, Group) else item if item == ANCHOR else ANYTHING
        elif isinstance(item, Group) and len(item.alternatives) == 1:
            items += item.alternatives[0]
            continue
        items.append(item)
    return (*done, tuple(items)), i


def _in_token(item: object) -> bool:
    return isinstance(item, str) and len(item) == 1 and item.isascii() and item.isalnum()


def _bounded(items: Sequence, outside: bool) -> bool:
    """Whether whatever the items match, read from their inner end, surely begins outside a token; outside: whether what lies
    beyond them does."""
    if not items:
        return outside
    item, beyond = items[0], items[1:]
    if isinstance(item, Group):
        ways = [_bounded(way, _bounded(beyond, outside)) for way in item.alternatives]
        return all(ways) and (not item.optional or _bounded(beyond, outside))
    return item == ANCHOR or (item != ANYTHING and not _in_token(item))


def _mirrored(items: Sequence) -> tuple:
    return tuple(Group(tuple(_mirrored(way) for way in x.alternatives), x.optional) if isinstance(x, Group) else x for x in reversed(items))


def literal_tokens(pattern: str) -> list[str]:
    r"""Whole lower-case tokens ``[a-z0-9]+`` that any match of the pattern must hold, as far as a simple reading shows.

    A run of literal letters and digits is a whole token where an anchor, another character, or a group all of whose
    alternatives end (or begin) with one stands on either side; so the label behind an optional ``(?:[^/]*\.)?`` counts, since
    it follows either that group's dot or the anchor before. Alternatives of the whole pattern, back references and inline
    flags give up; so does a pattern that has no such token.
    """
    try:
        (items, *others), _ = _parse(pattern)
    except ValueError:
        return []
    if others:
        return []
    found, k = [], 0
    while k < len(items):
        end = k
        while end < len(items) and _in_token(items[end]):
            end += 1
        if end > k and _bounded(_mirrored(items[:k]), False) and _bounded(items[end:], False):
            found.append("".join(items[k:end]).lower())
        k = end + 1
    return list(dict.fromkeys(found))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(subject), "[^a-z0-9]+"), lambda t: t != ""))


def index_rules(pages: DataFrame, rules: Sequence[UrlRule], subject: Column) -> tuple[dict[str, list[UrlRule]], list[UrlRule]]:
    """Rules by the literal token that the fewest urls hold, and the rules that have none.

    The counts come from all urls, summed in Spark; what returns is bounded by the tokens of the rules.
    """
    tokens = {r: literal_tokens(r.pattern) for r in rules}
    wanted = sorted({t for found in tokens.values() for t in found})
    known = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counted = pages.select(F.explode(url_tokens(subject)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = {r["token"]: r["n"] for r in counted.join(known, "token", "left_semi").collect()} if wanted else {}
    index: dict[str, list[UrlRule]] = {}
    for rule, found in tokens.items():
        if found:
            index.setdefault(min(found, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index, [r for r, found in tokens.items() if not found]


def url_filter(pages: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits), verdict."""
    host, path = host_and_path(F.col(url_col))
    pages = pages.select(id_col, host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    rules = list(dict.fromkeys(rules))
    index, rest = index_rules(pages, rules, subject)
    if len(rules) <= max_inline:
        best = F.array_max(_matches(index, rest, subject))
        out = pages.withColumn("best", best)
    else:
        out = _joined(pages, index, rest)
    return out.select(id_col, "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _literal(rule: UrlRule) -> Column:
    return F.struct(F.lit(rule.priority).cast("long").alias("priority"), F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"), F.lit(rule.pattern).alias("pattern"))


def _matches(index: dict[str, list[UrlRule]], rest: list[UrlRule], subject: Column) -> Column:
    kind = "array<struct<priority:bigint,name:string,action:string,pattern:string>>"
    candidates = F.array(*map(_literal, rest)).cast(kind) if rest else F.array().cast(kind)
    if index:
        by_token = F.create_map(*[x for t, rules in sorted(index.items()) for x in (F.lit(t), F.array(*map(_literal, rules)))])
        fetched = F.flatten(F.transform(url_tokens(subject), lambda t: F.coalesce(F.try_element_at(by_token, t), F.array().cast(kind))))
        candidates = F.concat(fetched, candidates)
    return F.filter(candidates, lambda r: F.regexp_like(subject, r["pattern"]))


def _joined(pages: DataFrame, index: dict[str, list[UrlRule]], rest: list[UrlRule]) -> DataFrame:
    """The same for rule sets of any size: distinct subjects' tokens join the rule table, and the winners join back."""
    spark = pages.sparkSession
    rows = [(t, r.priority, r.name, r.action, r.pattern) for t, rules in index.items() for r in rules] + [("", r.priority, r.name, r.action, r.pattern) for r in rest]
    table_ = spark.createDataFrame(rows, "token string, priority long, name string, action string, pattern string")
    subjects = pages.select("host", "path").distinct()
    subject = F.concat("host", "path")
    held = subjects.select("host", "path", F.explode(F.concat(F.array(F.lit("")), url_tokens(subject))).alias("token"))
    hits = held.join(table_, "token").where(F.regexp_like(subject, F.col("pattern")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("priority", "name", "action", "pattern")).alias("best"))
    return pages.join(best, ["host", "path"], "left")


#: The rules of the registered query, in order.
DOMAIN_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: What decides where no domain rule fits: words that stand alone in host or path, and the endings of archives and programs.
BAD_WORDS = ("casino", "poker", "porn", "torrent", "viagra", "warez", "xxx")
BAD_ENDINGS = ("apk", "exe", "iso", "msi", "rar", "zip")
PATTERN_RULES = (*(UrlRule(w, "block", rf"\b{w}\b") for w in BAD_WORDS), *(UrlRule(f"archive_{x}", "block", rf"\.{x}\z") for x in BAD_ENDINGS))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain rules decide; a page that only a pattern rule fits shows that rule's verdict but no rule."""
    domain = [domain_rule(*x) for x in DOMAIN_RULES]
    out = url_filter(table(spark, sf_dir, "pages"), [*domain, *PATTERN_RULES])
    named = F.col("rule").isin([r.name for r in domain])
    return out.select("page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict")


OP1_SQL = rf"""
WITH a AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(rule, act) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
s AS (SELECT rule, act, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM r),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act FROM b JOIN s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT b.page_id, b.host, b.path, m.rule AS rule, coalesce(m.act, CASE WHEN regexp_matches(host || path, '\b({'|'.join(BAD_WORDS)})\b|\.({'|'.join(BAD_ENDINGS)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN m USING (page_id)
"""

QUERIES = {"op1_url_filter": op1_url_filter}
SQL = {"op1_url_filter": OP1_SQL}
