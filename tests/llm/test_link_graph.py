"""URL filter against brute force."""

import random

import duckdb
from annolith.llm import link_graph as L

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def brute(rows, steps=L.STEPS):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cutoff = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cutoff]), rest[cutoff:]
        return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    import re

    pages, edges = [], set()
    for page, url, html in rows:
        host, path = parts(url)
        best = max(((len(h + p), h + p, v) for h, p, v in L.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
        pages.append((page, host, path, best[1], best[2]))
        for link in re.findall(L.LINK, html or ""):
            to = parts("http:" + link if link.startswith("//") else link)[0]
            if host and to and to != host:
                edges.add((host, to))
    share = []
    for verdict, flow in (("allow", edges), ("block", {(b, a) for a, b in edges})):
        seed = {}
        for h in {p[1] for p in pages} - {""}:
            own = [p for p in pages if p[1] == h]
            seed[h] = L.SCALE * sum(p[4] == verdict for p in own) // len(own)
        linked = {h for e in flow for h in e}
        out = {h: sum(x == h for x, _ in flow) for h in linked}
        seeds = [{h: seed.get(h, 0) for h in linked}, dict.fromkeys(linked, L.SCALE)]
        got = [{}, {}]
        now = [{h: s * 15 // 100 for h, s in x.items()} for x in seeds]
        for _ in range(steps):
            for i in (0, 1):
                got[i] = dict.fromkeys(linked, 0)
                for a, b in flow:
                    got[i][b] += now[i][a] // out[a]
                now[i] = {h: seeds[i][h] * 15 // 100 + got[i][h] * 85 // 100 for h in linked}
        own = {h: s // (L.SCALE // L.PARTS) for h, s in seed.items()}
        passed = {h: int(got[0][h] / got[1][h] * L.PARTS) for h in linked if got[1][h]}
        share.append({h: max(own.get(h, 0), passed.get(h, 0)) for h in {*own, *passed}})
    return sorted(((page, h, p, r, v or ("block" if share[1].get(h, 0) - share[0].get(h, 0) > L.THRESHOLD else "allow"), share[0].get(h, 0), share[1].get(h, 0)) for page, h, p, r, v in pages), key=str)


def web():
    rnd = random.Random(4)
    hosts = ["a.example.net", "NET", "b.net", "x.example.com", "y.example.com", "farm.com", "good.org", "c.org", "lone.io", "d.com"]
    rows = []
    for i in range(60):
        h = rnd.choice(hosts)
        links = "".join(f'<a href="{rnd.choice(["http://", "https://", "//"])}{rnd.choice(hosts)}/q"> <img src=/local.png>' for _ in range(rnd.randint(0, 2)))
        rows.append((i, f"http://{h}{rnd.choice(['/en/1', '/de/2', '/fr/3?x=1', '', '?q', '#f', '/'])}", links))
    return [*rows, (100, None, None), (101, "no scheme", ""), (102, "http://", "x"), (102, "http://", "x"), (None, "ftp://Farm.COM/de/://z", "<a href='https://b.net'>"), (104, "http://farm.com\n/x", None)]


def test_matches_brute_force_and_sql(spark):
    rows = web()
    got = L.judge_urls(spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA))
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(c.execute(L.judge_sql()).fetchall(), key=str) == want


def test_empty_table(spark):
    assert L.judge_urls(spark.createDataFrame([], SCHEMA)).collect() == []


def judged(spark, rows):
    return {r.page_id: r for r in L.judge_urls(spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)).collect()}


def test_verdicts_do_not_fade_with_in_degree(spark):
    """Of many hosts that link to one blocked host, those that link to nothing else are blocked, and those that mostly link elsewhere are not."""
    rows = [(0, "http://bad.net/x", ""), (1, "http://plain.io/x", "")]
    rows += [(100 + i, f"http://only{i}.com/x", "<a href='http://bad.net/'>") for i in range(60)]
    rows += [(200 + i, f"http://mixed{i}.com/x", "<a href='http://bad.net/'>" + "".join(f"<a href='http://other{i}-{k}.com'>" for k in range(3))) for i in range(10)]
    got = judged(spark, rows)
    assert {got[100 + i].verdict for i in range(60)} == {"block"}
    assert {got[200 + i].verdict for i in range(10)} == {got[1].verdict} == {"allow"}


def test_trust_outweighs(spark):
    rows = [(0, "http://bad.net/x", ""), (1, "http://good.org/fr/x", "<a href='http://a.com'>"), (2, "http://a.com/x", "<a href='http://bad.net'>"), (3, "http://b.com/x", "<a href='http://bad.net'>")]
    got = judged(spark, rows)
    assert got[2].verdict == "allow" and got[2].trust > 900_000
    assert got[3].verdict == "block"


def test_hubs_in_slices_give_the_same(spark):
    rows = [(i, f"http://h{i}.com/x", f"<a href='http://h{(i * 7) % 40}.com'><a href='http://hub.com'>") for i in range(40)]
    rows += [(50, "http://hub.com/x", "".join(f"<a href='http://h{i}.com'>" for i in range(40)))]
    seeds = spark.createDataFrame([(k, f"h{i}.com", L.SCALE) for k in (0, 1) for i in range(0, 40, 3)], "kind int, host string, seed long")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", L.host_of(L.F.col("url")))
    edges = L.host_edges(pages)
    one, many = (sorted(map(tuple, L.propagate(edges, seeds, 6, hub=h).collect())) for h in (L.HUB, 3))
    assert one == many and len(one) == 82


def test_registered_query_over_linked_pages(spark, tmp_path):
    from annolith.llm.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame(web(), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op5_url_filter"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(ORACLE_SQL["op5_url_filter"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pages_without_links(spark):
    got = judged(spark, [(1, "http://a.net/x", None), (2, "http://b.io/x", "<a href='/y'>"), (3, "http://q.org/fr/x", "")])
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "allow", 3: "allow"}
    assert (got[1].distrust, got[2].distrust, got[3].trust) == (L.PARTS, 0, L.PARTS)
