"""URL verdicts against a plain tree, and the odd cases."""

import random
from collections import defaultdict

import pytest

from seqloom.llm import url_filter
from seqloom.llm.queries import URL_RULES
from seqloom.llm.url_filter import Limits, judge

SCHEMA = "page_id long, url string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest.split("?")[0].split("#")[0]


def rule_for(host, path, rules):
    fit = []
    for what, text in rules:
        name, start = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fit.append((-len(text), what != "block", text, what))
    return (min(fit)[2], min(fit)[3]) if fit else (None, None)


def marked(path):
    return "".join(c for i, c in enumerate("".join("#" if "0" <= c <= "9" else c for c in path)) if not (c == "#" and i and path[i - 1].isascii() and path[i - 1].isdigit()))


def tree(urls, rules, limits):
    """Verdicts of urls by a recursive tree over plain lists."""
    rows = [(*parse(u), *rule_for(*parse(u), rules)) for u in urls]
    b, a = sum(r[3] == "block" for r in rows), sum(r[3] == "allow" for r in rows)
    overall, purity, template = (b + 1) / (a + b + 2), {}, {}
    hosts = defaultdict(list)
    for k, r in enumerate(rows):
        hosts[r[0]].append(k)

    segments = [marked(r[1])[1:].split("/") if r[1] else [] for r in rows]

    def share(members, parent):
        b, m = sum(rows[k][3] == "block" for k in members), sum(rows[k][3] is not None for k in members)
        return (b + limits.smooth * parent) / (m + limits.smooth)

    def descend(members, depth, node, p):
        for k in members:
            purity[k], template[k] = p, node
        live = [k for k in members if len(segments[k]) > depth]
        if not live or depth == limits.depth:
            return
        groups = defaultdict(list)
        for k in live:
            groups[segments[k][depth]].append(k)
        branches = defaultdict(list)
        for seg, mine in groups.items():
            branches[seg if len(mine) * limits.share >= len(live) and len(mine) >= limits.least else "*"] += mine
        stats = []
        for name, mine in branches.items():
            n, b, m = len(mine), sum(rows[k][3] == "block" for k in mine), sum(rows[k][3] is not None for k in mine)
            ended, numbered = sum(len(segments[k]) <= depth + 1 for k in mine) / n, sum(len(segments[k]) > depth + 1 and "#" in segments[k][depth + 1] for k in mine) / n
            stats.append((m > 0, 0 if ended >= 0.5 else 1 if numbered >= 0.5 else 2, b / m if m else 0.0, name.encode(), ended, numbered, b, m))
        merged, last = [], None
        for s in sorted(stats):
            alike = last is not None and abs(s[4] - last[4]) <= limits.shape and abs(s[5] - last[5]) <= limits.shape and s[0] == last[0]
            if alike and s[0]:
                r = (s[6] + last[6]) / (s[7] + last[7])
                alike = (s[2] - last[2]) ** 2 <= limits.z * limits.z * r * (1 - r) * (1 / s[7] + 1 / last[7])
            if alike:
                merged[-1].append(s[3].decode())
            else:
                merged.append([s[3].decode()])
            last = s
        for names in merged:
            mine = [k for x in names for k in branches[x]]
            descend(mine, depth + 1, node + "/" + "|".join(sorted(names)), share(mine, p))

    for members in hosts.values():
        descend(members, 0, "", share(members, overall))
    return {k: (*r[:3], template[k], r[3] or ("block" if purity[k] > limits.reject else "allow")) for k, r in enumerate(rows)}


ODD = [None, "", "no scheme", "http://", "HTTP://EX.ORG", "http://a.org?x=://b.com/de/", "http://É.Com/fr/1", "x://a.com//b//", "x://a.com/*/1", "x://org/", "x://xorg/", "x://example.org/es/", "x://example.org/en/1/2", "x://a\nb.com/de/\n", "x://long.com/" + "1a/" * 3000, "x://long.net/" + "é" * 100_000]


def some_urls(n, seed):
    draw = random.Random(seed)
    hosts = ["hot.example.com"] * 6 + ["a.com", "b.com", "spam.com", "example.org", "c.net"]
    found = []
    for _ in range(n):
        host = draw.choice(hosts)
        kind = draw.choice(["de", "fr", "en", "es", "news", "tag"])
        tail = {"news": f"{draw.choice('abc')}-{draw.randrange(40)}-{draw.choice(['x', 'y'])}/{draw.choice(['', 'print', 'p1'])}", "tag": "".join(draw.choice("abcdef") for _ in range(5))}.get(kind, f"{draw.randrange(999)}{draw.choice(['', '/', '.html'])}")
        kind = "de" if host == "spam.com" and draw.random() < 0.9 else kind
        found.append(f"http://{host}/{kind}/{tail}{draw.choice(['', '?q=1', '#x'])}")
    return found


@pytest.mark.parametrize("seed,limits,hot", [(1, Limits(), 1000), (2, Limits(share=5, least=2, reject=0.4, depth=2), 4), (3, Limits(reject=0.3, smooth=1.0), 10)])
def test_verdicts_equal_a_plain_tree(spark, monkeypatch, seed, limits, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)
    urls = some_urls(900, seed) + ODD + ODD[:4]
    found = judge(spark.createDataFrame(list(enumerate(urls)), SCHEMA), URL_RULES, limits=limits)
    got = {r.page_id: (r.host, r.path, r.rule, r.template, r.verdict) for r in found.collect()}
    want = tree(urls, URL_RULES, limits)
    assert got == want
    assert {v[4] for v in want.values() if v[2] is None} == {"allow", "block"} or seed == 1


def test_a_blocked_section_takes_its_new_pages_along(spark):
    rules = [("block", f"h.com/shop/{x}") for x in "abcd"] + [("allow", "h.com/blog/a")]
    urls = [f"http://h.com/shop/{x}{k}" for x in "abcd" for k in range(20)] + [f"http://h.com/blog/a{k}" for k in range(40)] + ["http://h.com/shop/e7", "http://h.com/blog/e7", "http://other.net/e7"]
    found = {r.url: r.verdict for r in judge(spark.createDataFrame(list(enumerate(urls)), SCHEMA), rules).collect()}
    assert found["http://h.com/shop/e7"] == "block" and found["http://h.com/blog/e7"] == found["http://other.net/e7"] == "allow"


def test_other_columns_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/1", "mine", 5), (1, "http://a.com/de/1", "mine", 5), (None, None, None, None)], "page_id long, url string, doc string, host int")
    found = judge(pages, URL_RULES)
    assert sorted(found.columns) == sorted(["page_id", "url", "doc", "host", "path", "rule", "template", "purity", "verdict"])
    assert [(r.page_id, r.doc, r.host, r.rule) for r in found.orderBy("page_id").collect()] == [(None, None, "", None), (1, "mine", "a.com", "com/de/"), (1, "mine", "a.com", "com/de/")]
    assert judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge(pages, []).collect()} == {"allow"}


def test_one_length_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/y")], SCHEMA)
    assert judge(pages, [("allow", "a.com/"), ("block", "com/x/")]).first().rule == "com/x/"


def test_no_python_in_the_plan(spark, sf_dir):
    from seqloom.llm.queries import op11_url_filter

    plan = op11_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
