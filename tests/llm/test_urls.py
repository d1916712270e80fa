import re

import pytest

from dualview.llm import urls
from dualview.llm.registry import ORACLES, RULES
from oracle import connect

A = '<a href="{}">'


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7, "x", None) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, rule int, says string, host string").repartition(3)


def plain(rows, rules=RULES, damping=urls.DAMPING, rounds=urls.ROUNDS, threshold=urls.THRESHOLD):
    """Dictionaries and loops over the same definition."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    out, links, by = [], {}, {}
    for i, (url, html) in enumerate(rows):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        m = re.match(r"([^/?#]*)([^?#]*)", rest) if rest is not None else None
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        _, rule, says = max(fit, default=(0, None, None))
        out.append([i, host, path, rule, says])
        if host:
            by.setdefault(host, []).append(says)
            for d in {low(x) for x in re.findall(urls.LINK, html or "")} - {host}:
                links[host, d] = links.get((host, d), 0) + 1
    total = {}
    for (s, _), n in links.items():
        total[s] = total.get(s, 0) + n
    score = {}
    for kind, says in (("t", "allow"), ("d", "block")):
        seed = {h: sum(x == says for x in v) / len(v) for h, v in by.items()}
        now = dict(seed)
        for _ in range(rounds):
            new = dict(seed)
            for (s, d), n in links.items():
                a, b = (s, d) if kind == "t" else (d, s)
                new[b] = new.get(b, 0) + now.get(a, 0) * n / total[s] * damping
            now = new
        score[kind] = now
    for row in out:
        bad = round(score["d"].get(row[1], 0), 9) > max(threshold, round(score["t"].get(row[1], 0), 9))
        row[4] = row[4] or ("block" if row[1] and bad else "allow")
    return [tuple(r) for r in out]


ODD = [
    ("http://a.net/x", None), ("http://b.net/y", ""), ("HTTP://A.Example.NET/en/1", A.format("https://good.com/")), ("no scheme", A.format("//a.net")), (None, A.format("http://b.net")), ("", None), ("http://", None), ("http:///p", None),
    ("ftp://bad.com/1", A.format("//A.NET/q") + A.format("http://b.net?x") + A.format("/own")), ("http://bad.com/2", "<a  HREF = 'http://B.net'>"), ("http://worse.com?q=http://good.com/", A.format("http://bad.com/")),
    ("http://good.com/#://a.net/", A.format("http://x.org/fr/") + A.format("//a.net")), ("http://x.org/fr/1", A.format("http://y.org/fr/2")), ("http://y.org/fr/2", None), ("http://x.org/de/1", None), ("https://www.example.com/de/1", None), ("https://example.com/DE/1", None),
    ("http://net/", None), ("http://net", None), ("http://planet/", None), ("http://u@a.net:80/x", None), ("http://a.net/x", None), ("http://far.com/", "z" * 300_000 + A.format("http://a.net") * 2000),
]


def judged(df):
    return sorted(tuple(r) for r in df.collect())


def test_verdicts_equal_plain_version(spark):
    want = plain(ODD)
    got = judged(urls.judge(pages(spark, ODD), RULES))
    assert got == want
    verdict = {i: v for i, *_, v in got}
    assert verdict[8] == verdict[9] == verdict[22] == "block" and verdict[11] == "allow" and verdict[18] == "allow"


def test_distrust_runs_against_links_and_trust_along_them(spark):
    rows = [("http://s.net/1", A.format("http://innocent.com")), ("http://innocent.com/", A.format("http://x.org/fr/")), ("http://a.com/", A.format("http://s.net")), ("http://b.com/", A.format("http://a.com")), ("http://x.org/fr/1", A.format("http://a.com"))]
    got = {h: v for _, h, _, _, v in judged(urls.judge(pages(spark, rows), RULES))}
    assert got["innocent.com"] == "allow" and got["a.com"] == "allow"  # distrust 0.6 and trust 0.6
    assert {h: v for _, h, _, _, v in judged(urls.judge(pages(spark, rows[:4]), RULES))}["a.com"] == "block"
    assert judged(urls.judge(pages(spark, rows), RULES)) == plain(rows)


def test_many_hosts_and_a_hub(spark, monkeypatch):
    rows = [(f"http://h{i}.{'net' if i % 9 == 0 else 'org' if i % 9 == 1 else 'com'}/fr/{i}", A.format("http://hub.com") + "".join(A.format(f"http://h{j}.{'net' if j % 9 == 0 else 'com'}/") for j in range(i % 7, 90, 1 + i * i % 31))) for i in range(90)]
    rows += [("http://hub.com/", A.format("http://h1.org/"))] * 60
    want = plain(rows)
    assert {v for *_, rule, v in want if rule is None} == {"allow", "block"}
    assert judged(urls.judge(pages(spark, rows), RULES)) == want
    monkeypatch.setattr(urls, "SENT", 0)
    assert judged(urls.judge(pages(spark, rows), RULES)) == want


def test_equally_long_rules_go_by_place_and_empty_tables_give_nothing(spark):
    df = pages(spark, [("http://a.b.com/xy/z", None)])
    for says in ("block", "allow"):
        other = {"block": "allow", "allow": "block"}[says]
        assert judged(urls.judge(df, [("com/", other), ("b.com/xy", says), ("com/xy/z", other)]))[0][3:] == ("b.com/xy", says)
    assert urls.judge(pages(spark, ODD).limit(0), RULES).count() == 0


def test_sql_sees_the_same_graph(spark, tmp_path, small):
    df = pages(spark, ODD)
    df.select("page_id", "url", "html").coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = connect(small)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    cursor = con.execute(ORACLES["op13_url_filter"])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    assert sorted(tuple(r[i] for i in order) for r in cursor.fetchall()) == judged(urls.judge(df, RULES))


@pytest.mark.parametrize("url,want", [("a://B.c:1/D?e", ("b.c:1", "/D")), ("://x", ("x", "")), ("x", ("", "")), ("a://É.X#y", ("É.x", ""))])
def test_parts(spark, url, want):
    from pyspark.sql import functions as F

    assert tuple(spark.createDataFrame([(url,)], "u string").select(urls.host(F.col("u")), urls.path(F.col("u"))).first()) == want
