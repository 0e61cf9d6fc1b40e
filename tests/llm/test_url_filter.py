import re

from hypothesis import given, settings
from hypothesis import strategies as st

from duonet.llm import url_filter as u


def brute(url):
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(raw):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    best = None
    for action, rule in u.DOMAIN_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/1?x#y", "https://www.example.com/en/2", "http://www.example.com/de/", "ftp://a.net/es/x", "http://net/fr/", "http://internet/fr/", "http://a.net/EN/", "http://x.com", "http://x.com/", "http://x.com?y=/", "http://x.com:80/", "a://b.com/en/http://www.example.com/en/", "http://ÄÖ.com/é", "http://b.net/esx", "http://casino.net/", "http://b.org/a-casino-b", "http://b.org/casinos", "http://b.org/f.exe", "://a.com/en\n/x", "http://notexample.com/en/1"]


def test_domain_rules_match_brute_force(spark):
    df = spark.createDataFrame([(i, x, "h", "r") for i, x in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    rules = [u.domain_rule(*x) for x in u.DOMAIN_RULES] + list(u.PATTERN_RULES)
    for most in (500, 0):  # the inline plan and the joined one
        out = {r["page_id"]: r for r in u.url_filter(df, rules, max_inline=most).collect()}
        assert len(out) == len(URLS) * 2
        for i, x in enumerate(URLS * 2):
            host, path, best = brute(x)
            assert (out[i]["host"], out[i]["path"]) == (host, path), x
            if best:
                assert (out[i]["rule"], out[i]["verdict"]) == (best[1], best[0]), x
            else:
                hit = re.search(rf"\b({'|'.join(u.BAD_WORDS)})\b|\.({'|'.join(u.BAD_ENDINGS)})\Z", host + path)
                assert out[i]["verdict"] == ("block" if hit else "allow"), x


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.url_filter(df, list(u.PATTERN_RULES)).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert u.url_filter(one, []).first()["verdict"] == "allow"


def test_literal_tokens():
    assert u.literal_tokens(r"\A(?:[^/]*\.)?example\.com\/en\/") == ["example", "com", "en"]
    assert u.literal_tokens(u.domain_rule("allow", "com/").pattern) == ["com"]
    assert u.literal_tokens(r"\A(?:x|[^/]*)?com\/") == []
    assert u.literal_tokens(r"(?:a\.|b-)?com\/") == []
    assert u.literal_tokens(r"/(?:a\.|b-)?com(?:\/|\z)") == ["com"]
    assert u.literal_tokens(r"/(?:a\.|b)com\/") == []
    assert u.literal_tokens(r"/(?:foo)/(?:ab)+/(bar/)?") == ["foo"]
    assert u.literal_tokens(r"(?i)/x/") == u.literal_tokens(r"/(a)\1/x/") == []
    assert u.literal_tokens(r"\bcasino\b") == ["casino"]
    assert u.literal_tokens(r"casino") == []
    assert u.literal_tokens(r"/ab+c/") == []
    assert u.literal_tokens(r"/x/|/y/") == []
    assert u.literal_tokens(r"/Foo-bar/[a-z]+/baz\z") == ["foo", "bar", "baz"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab./-", max_size=12), st.sampled_from([r"/ab/", r"\bab\b", r"\Aab\.", r"-ab?/", r"(a|b)/ab\z", r"[ab]/a", r"\A(?:[^/]*\.)?ab/", r"/(?:a\.)*b(?:-|/a)", r"(?:a|b-)?ab\.", r"-(?:ab)b?\.", r"(?:/a|-)+b/"]))
def test_tokens_are_necessary(text, pattern):
    if re.search(pattern.replace(r"\z", r"\Z"), text):
        tokens = set(re.split("[^a-z0-9]+", text.lower()))
        assert set(u.literal_tokens(pattern)) <= tokens


def test_every_registered_rule_is_indexed(spark):
    rules = [u.domain_rule(*x) for x in u.DOMAIN_RULES] + list(u.PATTERN_RULES)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "page_id long, url string")
    host, path = u.host_and_path(u.F.col("url"))
    index, rest = u.index_rules(df.select(host.alias("host"), path.alias("path")), rules, u.F.concat("host", "path"))
    assert rest == [] and sum(map(len, index.values())) == len(rules)
