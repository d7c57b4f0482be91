import random
import re

import pytest
from pyspark.sql import functions as F

from markscale.llm.url_filters import GlobAutomaton, Rule, judge_urls

PATTERNS = ["com/**", "*.com/**", "a?c/*x", "**", "", "*", "a*b**c", "?" * 70 + "z", "x" * 130 + "*"]


def as_regex(glob):
    parts = re.split(r"(\*+|\?)", glob)
    turned = {"*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(turned.get(p, ".*") if p and p[0] in "*?" else re.escape(p) for p in parts), re.S)


def test_automaton_matches_regular_expressions():
    rng = random.Random(5)
    texts = ["", "com/", "a.com/b", "evil.org/x.com/", "abc/zx", "abc/z/x", "x" * 131, "y" * 70 + "z", "é/漢"]
    texts += ["".join(rng.choice("abcx./zm") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = GlobAutomaton(PATTERNS).match(texts)
    for i, text in enumerate(texts):
        for j, pattern in enumerate(PATTERNS):
            assert got[i, j] == bool(as_regex(pattern).fullmatch(text)), (pattern, text)


RULES = [Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/")]

CASES = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme.com/": ("", "", None, "allow"),
    "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
    "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://example.com?/en/": ("example.com", "", None, "allow"),
    "http://evil.org/example.com/en/": ("evil.org", "/example.com/en/", None, "allow"),
    "x://y://example.com/en/": ("y:", "//example.com/en/", None, "allow"),
    "http://é.example.com/en/é": ("é.example.com", "/en/é", "example.com/en/", "block"),
    "http://example.com/en/" + "a" * 50_000: ("example.com", "/en/" + "a" * 50_000, "example.com/en/", "block"),
}


def test_urls_are_judged(spark):
    rows = spark.createDataFrame([(u,) for u in CASES] * 2, "url string").withColumn("host", F.lit(1))
    got = judge_urls(rows, RULES).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == CASES[r.url]


@pytest.mark.parametrize("rules", [[], RULES])
def test_empty_tables_and_rules(spark, rules):
    none = spark.createDataFrame([], "url string")
    assert judge_urls(none, rules).count() == 0
    one = spark.createDataFrame([("http://x.net/",)], "url string")
    assert judge_urls(one, rules).first().verdict == "allow"
