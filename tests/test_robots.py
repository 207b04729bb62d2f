"""Robots rules against the standard parser, on generated files and URLs."""

from __future__ import annotations

import random
from urllib.robotparser import RobotFileParser

from hypothesis import given
from hypothesis import strategies as st

from lodestone import registry
from lodestone.sources import pages as G
from tests.compare import same

LINES = ["User-agent: *", "User-agent: bot", "user-agent: Lodestone", "User-Agent: other/2", "Disallow: /a/", "Disallow: /a/5", "Allow: /a/5", "Disallow:", "Allow: /", "Disallow: /A", "Disallow: *", "Disallow: /b%20c", "Disallow: /é", "# all", "", "Crawl-delay: 3", "Sitemap: http://x/s.xml", "Disallow: /q?x=1", "nonsense", " Disallow : /b "]
PATHS = ["", "/", "/a/", "/a/5", "/A/x", "/b c", "/b%20c/d", "/%C3%A9", "/é/1", "/q?x=1&y=2", "/q", "/a/5#top"]


@given(st.lists(st.sampled_from(LINES), max_size=14), st.sampled_from(["*", "lodestone/1.0", "bot", "LodestoneBot", "x"]), st.sampled_from(PATHS))
def test_first_rule_of_the_agents_group(lines, agent, path):
    parser = RobotFileParser()
    parser.parse(lines)
    rules = G.agent_rules("\n".join(lines), agent)
    asked = G.asked_path(f"http://h.x{path}")
    got = next((a for a, p in rules if p == "*" or asked.startswith(p)), True)
    assert got == parser.can_fetch(agent, f"http://h.x{path}")


def test_frames_say_the_same(spark):
    r = random.Random(2)
    files = {f"http://h{k}.x": "\r\n".join(r.choices(LINES, k=r.randrange(0, 12))) for k in range(60)}
    urls = [(i, f"{'HTTP' if i % 9 == 0 else 'http'}://H{i % 61}.x{r.choice(PATHS)}") for i in range(400)]
    rules = G.robots_rules(spark.createDataFrame(list(files.items()), "origin string, body string"), "origin", "body", "lodestone/1.0")
    got = {x.id: x.allowed for x in G.robots_allowed(spark.createDataFrame(urls, "id int, url string"), rules).collect()}
    for i, u in urls:
        parser = RobotFileParser()
        parser.parse(files.get(f"http://h{i % 61}.x", "").splitlines())
        assert got[i] == parser.can_fetch("lodestone/1.0", u), u
    assert set(got.values()) == {True, False}


ODD = [
    None, "", "/en/5", "h.x/en/5", " http://h.xy/en/5", "http:///en/5", "http://h.x:80/en/5", "http://h.x:8080/en/5", "http://h.x:8080/de/5", "http://u@h.x/de/5", "http://u:p@h.x/en/5", "http://h.x./en/5", "http://h.xy./de/5", "HTTP://H.X/en/5", "http://h.x/%65n/5", "http://h.xy/%64e/5",
    "http://h.x/en/%31", "http://h.x%2Fen/5", "http://h.xy/%2Fde/5", "http://h.x/d%E9/", "a1://h.x/en/5", "git+ssh://h.x/en/5", "http://[h.x/en/5", "http://[h.xy/de/5", "http://[a]b//[/de/", "http://h.x/e\tn/5", "http://h.xy/d\te/5", "http://h.x/en/\n5", "http://h.x/en/5\n", "http://h.x/en/5\r", "http://h.x/en/#\u2028",
    "http://h.x?/en/5", "http://h.x//en/5", "http://h.x#/en/", "http://h.x", "http://é.x/en/5", "http://éa.x/de/5", "http://h.xy/fr/1", "http://h.xy/FR/1", "http://h.xy/de/", "http://h.xy/DE/", "http://h.xy/de", "http://h.x/en/12",
]


def test_query_on_odd_urls_is_as_its_sql(spark, tmp_path):
    spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "t").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "t" / "pages.parquet")
    same(registry.queries()["robots_filter"](spark, str(tmp_path / "t")), registry.oracle_sql()["robots_filter"], str(tmp_path / "t"))


def test_ports_and_users_have_their_own_files(spark):
    rules = G.robots_rules(spark.createDataFrame([("http://h.x:8080", "User-agent: *\nDisallow: /"), ("http://h.x", "User-agent: *\nDisallow: /a")], "origin string, body string"), "origin", "body")
    urls = [(0, "http://H.x:8080/b"), (1, "http://h.x/b"), (2, "http://h.x/a"), (3, "http://u@h.x/a"), (4, "/a")]
    assert {r.id: r.allowed for r in G.robots_allowed(spark.createDataFrame(urls, "id int, url string"), rules).collect()} == {0: False, 1: True, 2: False, 3: True, 4: True}
