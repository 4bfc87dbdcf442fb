import re

from lexstrata.llm import url_filter as uf


def expected(url):
    m = re.search(r"://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = re.sub("[A-Z]", lambda x: x.group(0).lower(), host)
    fits = [r for _, r in uf.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "x", "http://", "HTTP://A.Example.COM/en/7x?y#z", "http://com/en/", "https://xcom/en/1", "http://a.net/de/8", "http://example.net/de/81", "http://b.example.org/es/?q=/a", "http://h#/en/", "http://É.com/en/É", "a://b://c/d"]
    urls += [f"http://hot.example.com/{lang}/{n}.html" for lang in ("en", "fr") for n in range(60)] + ["http://hot.example.com/en/1.html"] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in uf.judge(pages).collect()}
    what = {r: v for v, r in uf.RULES}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = expected(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict in (("block", "allow") if rule is None else (what[rule],))


def test_template_purity_decides_where_no_rule_does(spark):
    rules = (("block", "bad.com/p/1"), ("allow", "good.com/p/1"))
    urls = [f"http://bad.com/p/{n}" for n in [1, *range(10, 30)]] + [f"http://bad.com/q/{n}" for n in range(20)] + [f"http://good.com/p/{n}" for n in range(10, 30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = uf.judge(pages, rules).collect()
    of = lambda host, path: {r.verdict for r in rows if r.host == host and r.path.startswith(path)}
    assert of("bad.com", "/p/") == {"block"} and of("bad.com", "/q/") == {"allow"} and of("good.com", "/p/") == {"allow"}


def test_many_rare_children_become_a_wildcard(spark):
    urls = [f"http://a.com/{chr(97 + n % 26)}{chr(97 + n // 26)}/x" for n in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.template for r in uf.judge(pages).collect()} == {"a.com/*/x"}
    assert uf.judge(pages.limit(0)).collect() == []


def brute(rows, rules):
    """The tree by plain loops: rows (page_id, host, path, ruled) to (page_id, template, purity, verdict)."""
    import math
    from collections import defaultdict

    def form(x):
        for pattern, mark in ((r"^[0-9]+(\.[a-z]{2,5})?$", "{n}"), (r"^[0-9a-f]{8}[0-9a-f-]{8,}(\.[a-z]{2,5})?$", "{h}"), (r"^(?=[^.]*[0-9])(?=[^.]*[A-Za-z])[A-Za-z0-9_-]{10,}(\.[a-z]{2,5})?$", "{id}")):
            if m := re.match(pattern, x):
                return mark + (m.group(1) or "")
        return x

    paths = defaultdict(lambda: [0, 0, 0])
    key_of = {}
    for i, host, path, ruled in rows:
        parts = [form(x) for x in path.split("/") if x]
        key = (host, *[(parts[k : k + 1] or [""])[0] for k in range(uf.DEPTH)], "/".join(parts[uf.DEPTH :]))
        key_of[i] = key
        n = paths[key]
        n[0] += 1
        n[1] += ruled == "block"
        n[2] += ruled == "allow"
    named = {k: (k[0],) for k in paths}
    for level in range(uf.DEPTH):
        kids = defaultdict(lambda: [0, 0, 0])
        for k, n in paths.items():
            for j in range(3):
                kids[named[k], k[1 + level]][j] += n[j]
        nodes = defaultdict(list)
        for (node, s), n in kids.items():
            nodes[node].append((s, n))
        branch = {}
        for node, own in nodes.items():
            total = [sum(n[j] for _, n in own) for j in range(3)]
            for s, (n, bad, good) in own:
                seen, others = bad + good, total[1] + total[2] - bad - good
                share = total[1] / max(total[1] + total[2], 1)
                spread = math.sqrt(share * (1 - share) * (1 / max(seen, 1) + 1 / max(others, 1)))
                apart = abs(bad / max(seen, 1) - (total[1] - bad) / max(others, 1))
                if s == "":
                    branch[node, s] = ""
                elif len(own) >= uf.KIDS and total[0] < len(own) * uf.SUPPORT:
                    branch[node, s] = "*"
                elif seen and others and apart <= uf.Z * spread:
                    branch[node, s] = "+"
                else:
                    branch[node, s] = s
        named = {k: (*named[k], branch[named[k], k[1 + level]]) for k in paths}
    of = defaultdict(lambda: [0, 0])
    for k, n in paths.items():
        of[named[k]][0] += n[1]
        of[named[k]][1] += n[2]
    out = {}
    for i, _, _, ruled in rows:
        t = named[key_of[i]]
        bad, good = of[t]
        purity = (bad + uf.ALPHA / 2) / (bad + good + uf.ALPHA)
        out[i] = (t[0] + "".join("/" + x for x in t[1:] if x), purity, ruled or ("block" if purity >= uf.PURITY else "allow"))
    return out


def test_tree_equals_brute_force(spark):
    import random

    rng = random.Random(14)
    rules = (("block", "bad.com/a"), ("allow", "bad.com/b"), ("block", "mixed.org/x/1"), ("allow", "mixed.org/x/2"), ("block", "mixed.org/y"), ("block", "s.net/"), ("allow", "s.net/ok"))
    names = ["a", "b", "x", "y", "ok", "1", "2", "17", "deadbeef00112233", "ab12cd34ef56", "item-9f8e7d6c5b", "p.html", "20.html"]
    urls = ["/".join([f"http://{rng.choice(['bad.com', 'w.bad.com', 'mixed.org', 's.net', 'free.com'])}", *rng.choices(names, k=rng.randint(0, 6))]) + rng.choice(["", "/", "?q=1"]) for _ in range(1500)]
    urls += [f"http://free.com/many/{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(120)] + [None, "", "http://long.com/" + "/".join(["seg"] * 20_000)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    odd = table.withColumns({c: table["url"] for c in ("host", "rule", "s0", "t0", "n", "template")})
    got = {r.page_id: r for r in uf.judge(odd, rules).collect()}
    want = brute([(i, r.host, r.path, None if r.rule is None else r.verdict) for i, r in got.items()], rules)
    assert {r.template for r in got.values()} > {"free.com/many/*"} and any(r.rule is None and r.verdict == "block" for r in got.values())
    for i, r in got.items():
        template, purity, verdict = want[i]
        assert (r.template, r.verdict) == (template, verdict) and abs(r.purity - purity) < 1e-12
