"""URL filters, WARC archives and mixing against brute force."""

import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries, urls, warc

URLS = [
    "http://a.example.com/en/7", "http://example.com/en/71?x", "http://EXAMPLE.com/en/8#a", "http://xexample.com/en/7", "https://a.net/de/1",
    "https://example.net/de/8x", "https://example.net/de/9", "com/en/", None, "", "http://com/en/", "http://b.org/es/?q=1", "http://b.org/es",
    "x://y://com/en/", "http://é.org/es/ñ", "http://a.org:80/es/1", "http://", "http:///en/", "http://.com/en/x", "http://a.example.com/en/7",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, path string")
    listed = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, listed).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert urls.filter_urls(pages.where("false"), listed).count() == 0
    none = urls.filter_urls(pages, listed.where("false")).collect()
    assert len(none) == len(URLS) and {r.verdict for r in none} == {"allow"}


def test_urls_with_columns_of_any_name(spark):
    names = ["key", "h", "_row", "row", "listed_verdict", "possible", "best", "n_host", "c0", "host", "rule", "verdict", "a.b"]
    pages = spark.createDataFrame([(i, u, *([f"own{i}"] * len(names))) for i, u in enumerate(URLS)], ["page_id", "url", *names])
    out = urls.filter_urls(pages, spark.createDataFrame(queries.RULES, "host string, path string, verdict string"))
    rows = [r.asDict() for r in out.collect()]
    assert out.columns == ["page_id", "url", *(n for n in names if n not in ("host", "rule", "verdict")), "host", "path", "rule", "verdict"]
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(URLS[r["page_id"]])
        assert {r[n] for n in names if n not in ("host", "rule", "verdict")} == {f"own{r['page_id']}"}


def test_op6_judges_by_the_rules_of_its_contract(spark, tmp_path):
    want = {
        "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/8": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "http://w.example.com/en/71?q": ("example.com/en/7", "allow"),
        "http://a.net/de/1": ("net/de/", "allow"), "http://NET/de/": ("net/de/", "allow"), "http://example.net/de/9": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://w.example.net/de/81#a": ("example.net/de/8", "block"),
        "http://a.org/es/1": ("org/es/", "block"), "http://a.org/de/1": (None, "allow"), "http://a.net/en/1": (None, "allow"), None: (None, "allow"),
    }
    spark.createDataFrame(enumerate(want), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_a_list_of_many_lengths_and_entries_that_fit_nothing(spark):
    listed = [("a.com", "/" + "x" * n, "block") for n in range(400)] + [("A.com", "/xx", "allow"), ("a.co", "m/xxx", "block"), (None, "/", "block")]
    listed += [("b.com", "", "block"), ("c.com/", "d", "block"), ("d.com", None, "block")]
    pages = [(0, "http://a.com/" + "x" * 350 + "y"), (1, "http://a.com/xx"), (2, "http://w.b.com"), (3, "http://a.com"), (4, "http://c.com/d"), (5, "http://d.com/")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    out = urls.filter_urls(frame, spark.createDataFrame(listed, "host string, path string, verdict string"))
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    assert got == {
        0: ("a.com/" + "x" * 350, "block"), 1: ("a.com/xx", "block"), 2: ("b.com", "block"),
        3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"),
    }


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    made = urls.build_filter(keys, max_blocks=128)
    h = lambda df: df.select(F.xxhash64("key")).toPandas().iloc[:, 0].to_numpy()
    assert urls.probe(made, h(keys)).all()
    others = spark.range(3000, 13000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    assert urls.probe(made, h(others)).mean() < 0.05


PAGES = [
    (5, "http://a/é b\r\nX: y", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/", None), (2, "http://d/", ""),
    (4, "http://e/", "WARC/1.1\r\n\r\nfake\r\n\r\nWARC/1.1\r\n"), (6, "http://f/", "é\U0001f600" * 1000), (7, "http://g/", "line\n\n\r\n"),
    (7, "http://h/", "line\n\n\r\n"), (8, "u", "x"), (None, "u", "x"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, record_type string")
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path, compression=compression)
    got = warc.read_warc(spark, path).withColumns({"page": warc.page_of(F.col("record_id")), "first": warc.page_of(F.col("refers_to"))}).collect()
    assert len(got) == len(PAGES)
    groups = {}
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    for r in got:
        html = next((h or "") for i, _, h in PAGES if i == r.page)
        first = min(i for i in groups[html] if i is not None)
        assert (r.payload_digest, r.payload_bytes) == (digest(html), len(html.encode()))
        if r.record_type == "response":
            assert bytes(r.payload) == html.encode() and r.page == first and r.refers_to is None
        else:
            assert r.first == first
    assert sum(r.record_type == "response" for r in got) == len(groups)
    uri = next(r.target_uri for r in got if r.page == 5)
    assert uri == "http://a/é%20b%0D%0AX:%20y"


def test_warc_predicates_skip_payloads(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path)
    found = warc.read_warc(spark, path).where("record_type = 'revisit' and refers_to is not null")
    assert found.count() == 5
    assert warc.read_warc(spark, path, payload="none").where("record_type in ('response')").where("payload is null").count() == 6
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.equal == {"record_type": frozenset(["response"])}
    rows = [row for part in reader.partitions() for row in reader.rows(part)]
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == len(rows)
    assert {row[1] for row in rows} == {"response"}


def test_unwanted_blocks_are_sought_over():
    record = lambda kind, body: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    stream = Counting(record("warcinfo", b"i" * 5000) + record("resource", b"hello"))
    got = list(warc.read_records(stream, lambda h: h["warc-type"] == "resource", "bytes"))
    assert [(r[5], r[4]) for r in got] == [(b"hello", 5)] and stream.taken == 5


def test_least_bytes_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = warc.deduplicate(pages, least_bytes=3).where("record_type = 'revisit'").select("page_id").collect()
    assert sorted(r.page_id for r in got) == [5, 7, 9]
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages.where("false"), path)
    assert warc.read_warc(spark, path).count() == 0


# --- mixing


def brute_rake(cells, targets, rounds):
    weight = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(rounds):
        for m in range(3):
            for v in {c[m] for c in cells}:
                have = sum(cells[c] * weight[c] for c in cells if c[m] == v)
                for c in cells:
                    if c[m] == v and have:
                        weight[c] *= targets[m][v] * total / have
    return weight


def test_raking_meets_the_marginals(spark):
    cells = {(s, x, t): 10 + 7 * i for i, (s, x, t) in enumerate((s, x, t) for s in "ab" for x in "uv" for t in "xy")}
    frame = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens bigint")
    targets = [{"a": 0.7, "b": 0.3}, {"u": 0.5, "v": 0.5}, {"x": 0.2, "y": 0.8}]
    frames = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in zip(mixing.MARGINS, targets, strict=True)}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(frame, frames, rounds=8).collect()}
    want = brute_rake(cells, targets, 8)
    assert got == pytest.approx(want, rel=1e-9)
    total = sum(cells.values())
    for m, t in enumerate(targets):
        for v, share in t.items():
            assert sum(got[c] * n for c, n in cells.items() if c[m] == v) / total == pytest.approx(share, rel=1e-3)


def test_probabilities_above_one_are_calibrated(spark):
    rows = [(i, "w " * 10, "ab"[i % 10 < 2], "uv"[i % 7 < 2]) for i in range(700)]  # a: 8 tenths, b: 2; u: 5 sevenths, v: 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("a", 0.78), ("b", 0.22)], "source string, target double")}
    targets["lang"] = spark.createDataFrame([("u", 0.68), ("v", 0.32)], "lang string, target double")
    kept = lambda budget: mixing.mix(docs, budget, targets=targets).toPandas().assign(t=lambda x: x.n_tokens * x.probability / 7000)
    got = kept(0.85)
    assert got.probability.max() <= 1 and (got.weight * 0.85).max() > 1
    assert got.t.sum() == pytest.approx(0.85, rel=1e-4)
    assert got.groupby("source").t.sum().to_dict() == pytest.approx({"a": 0.85 * 0.78, "b": 0.85 * 0.22}, rel=1e-4)
    assert got.groupby("lang").t.sum().to_dict() == pytest.approx({"u": 0.85 * 0.68, "v": 0.85 * 0.32}, rel=1e-4)
    got = kept(0.95)  # more than there is of b and v: they are kept whole
    assert got.t.sum() == pytest.approx(0.95, rel=1e-4)
    assert got.groupby("source").t.sum()["b"] == pytest.approx(0.2, rel=1e-4)
    assert got.groupby("lang").t.sum()["v"] == pytest.approx(2 / 7, rel=1e-4)


def test_mix_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "a b  c\n", "s", "en"), (3, "a b  c\n", "s", "en"), (None, "x y", "", "de"), (4, "z " * 50, "s", "fr")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, lang string, weight string")
    got = mixing.mix(docs).collect()
    assert len(got) == 6
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 3, 3, 50]
    assert not any(r.selected for r in got if r.doc_id is None)
    assert len({r.selected for r in got if r.doc_id == 3}) == 1
    assert {r.source for r in got} == {"s", "<none>"}
    assert mixing.mix(docs.where("false")).count() == 0
    kept = mixing.sample_mix(docs, budget=1e9)
    assert kept.columns == docs.columns and kept.count() == 5


def test_calibrated_sample_is_near_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).toPandas()
    share = (got.n_tokens * got.selected).sum() / (got.n_tokens * got.probability).sum()
    assert 0.85 < share < 1.15


def test_a_round_of_few_cells_has_no_join(spark, monkeypatch):
    plans, real = [], mixing.materialize

    def seen(session, df, tag):
        if tag == "rake":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(session, df, tag)

    monkeypatch.setattr(mixing, "materialize", seen)
    rows = [("abc"[k % 3], "xy"[k % 2], "t", 5 + k) for k in range(6)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    mixing.rake(cells, {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}, rounds=1)
    assert plans and "Join" not in plans[-1]
