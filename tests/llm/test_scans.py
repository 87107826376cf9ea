import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from semgraph.llm import licences, pages, personal, quality, urls
from semgraph.session import materialize
from tests.llm.against_sql import compare


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# URLs ------------------------------------------------------------------------------------------


def test_urls_against_sql(spark, small_sf):
    compare(spark, small_sf, urls.QUERIES, "op6_url_filter")


def test_urls_against_brute_force(spark):
    rules = [("net", "/", "block"), ("a.net", "/x", "allow"), ("a.net", "/x/y", "block"), ("b.a.net", "/", "allow"),
             ("b.a.net", "/", "block"), ("", "/", "block"), ("c.org", "", "block"), ("UPPER.org", "/q/", "allow")]
    links = [None, "", "no scheme", "http://a.net", "http://a.net/", "http://A.NET/xy/z", "https://a.net/x/y/z?q#f", "http://b.a.net/x/yy",
             "http://ba.net/x", "http://c.org", "x://d.c.org?/x", "http://upper.ORG/q/", "http://upper.org/Q/", "http://net/", "http:///x",
             "http://a..net/" + "s/" * 3000, "http://a.net/x"]
    frame_of = spark.createDataFrame([(i, u, "own") for i, u in enumerate(links + links[:3])], "page_id long, url string, host string")
    out = urls.judge_urls(frame_of, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(links) + 3
    for r in out:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host):])[0]
        fit = [(len(h + p), len(h), v == "block", h.lower() + p) for h, p, v in rules
               if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit) if fit else None
        want = (host, path, best[3] if best else None, ("block" if best[2] else "allow") if best else "allow")
        assert (r["_host"], r.path, r.rule, r.verdict) == want and r.host == "own", u
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge_urls(frame_of, empty, "block").collect()} == {"block"}


# Quality ---------------------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    rows = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in rows[:i] for i, x in enumerate(rows)), len(inside))


def test_counts_against_brute_force(spark, small_sf):
    texts = ["", "a", "a b", "a b c a b c", "x x x x", "é\n é\né\n\n \n#*$", "a\u00a0b c\x1cd", "one two three\nfour one two three"]
    texts += [r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").limit(40).collect() if len(r.text) < 4000]
    for text in texts:
        assert quality.count_signals(text)[:5] == brute_counts(text), text


def test_quality_query_agrees_with_labels(spark, sf):
    rows = {r.doc_id: r for r in quality.op8(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for d, r in rows.items():
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.kept and r.base_failed)
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2


def test_posteriors_start_no_python_workers(spark):
    rows = [(i, (0,) * len(quality.COUNTS)) for i in range(3)]
    fields = ", ".join(f"{name}: bigint" for name in quality.COUNTS)
    scored = materialize(spark.createDataFrame(rows, f"doc_id long, signals struct<{fields}>"))
    judged = quality.judge(scored, "signals")
    assert "ExistingRDD" not in judged._jdf.queryExecution().executedPlan().toString()
    assert judged.count() == 3 and judged.select("good_chance").distinct().count() == 1
    assert quality.judge(scored.limit(0), "signals").count() == 0


def test_quality_edge_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "word " * 60)]).withColumn("signals", F.lit(1)).withColumn("good_chance", F.lit(2))
    assert quality.drop_low_quality(docs).columns == docs.columns
    assert quality.drop_low_quality(docs).count() == 0
    assert quality.drop_low_quality(docs.limit(0)).count() == 0


def test_votes_recover_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.7
    votes = np.ones((6000, 5), int)
    for k, right in enumerate((0.95, 0.9, 0.8, 0.7, 0.55)):
        says = np.where(rng.random(6000) < right, truth, ~truth)
        votes[:, k] = np.where(rng.random(6000) < 0.3, 1, says * 2)
    patterns, at, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    kept = quality.fit_votes(patterns, times.astype(float))[at.ravel()] >= 0.5
    majority = ((votes == 2).sum(1) - (votes == 0).sum(1)) >= 0
    assert (kept == truth).mean() > max(0.9, (majority == truth).mean())


# Licences --------------------------------------------------------------------------------------


def test_licence_held_out_accuracy():
    fitted = licences.model()
    assert fitted["held_out"] > 0.7
    for family, notices in licences.NOTICES.items():
        assert family == licences.NONE or all(
            set(licences.grams_of(n)) & set(fitted["telling"]) for n in notices.split("\n"))


def test_licences(spark):
    rows = [(1, "Some prose.\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."),
            (3, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
            (4, "The driver showed his license to the general public at the version."), (5, None), (6, ""),
            (7, "Licensed under the Frobnicate Community License Agreement, revision blue."), (None, "Released under the MIT License."),
            (2, "Licensed under the Apache License, Version 2.0."), (8, "word " * 30000)]
    out = {(r.doc_id, r.families, r.n_notices, r.n_unknown, r.n_paragraphs) for r in licences.licence_documents(frame(spark, rows)).collect()}
    assert {(1, "MIT", 1, 0, 3), (2, "Apache-2.0", 1, 0, 1), (5, "", 0, 0, 0), (6, "", 0, 0, 0), (None, "MIT", 1, 0, 1), (8, "", 0, 0, 1)} <= {
        o if o[0] != 2 else (*o[:2], 1, *o[3:]) for o in out}
    by = {o[0]: o for o in out}
    assert by[3][1] == "CC-BY-NC,GPL" and by[4][1] == "" and by[7][1] == ""
    assert licences.licence_documents(frame(spark, rows).limit(0)).count() == 0


def test_every_line_is_scored(spark):
    lines = ["CC BY-SA 4.0", "Photos: CC BY-NC 3.0", "Available under CC BY 4.0", "Er kam mit der Frau.", "WTFPL", "", "Öl 4.0 4.0",
             *(n for notices in licences.NOTICES.values() for n in notices.split("\n"))]
    fitted = licences.model()
    at = {g: i for i, g in enumerate(fitted["grams"])}
    want = {}
    for i, line in enumerate(lines):
        scores = fitted["weights"][[at[g] for g in licences.grams_of(line) if g in at]].sum(0) + fitted["weights"][-1]
        if (family := fitted["families"][scores.argmax()]) != licences.NONE:
            want[i] = (family, round(float(1 / np.exp(scores - scores.max()).sum()), 5))
    got = {r.doc_id: (r.family, round(r.chance, 5))
           for r in licences.licence_paragraphs(frame(spark, list(enumerate(lines)))).collect()}
    assert {0, 1, 2} <= got.keys() == want.keys() and not {3, 4, 5} & got.keys()
    assert got[0][0] == "CC-BY-SA" and all(f in (want[i][0], "unknown") and abs(c - want[i][1]) < 2e-5 for i, (f, c) in got.items())


# Personal data ---------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(int(c) for c in digits[::-1]))
                if not 16 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns_against_brute_force(spark, small_sf):
    rng = random.Random(2)
    texts = ["".join(rng.choices("a@.1 +-()2", k=rng.randint(0, 40))) for _ in range(6000)]
    texts += [r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    texts += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "x@a.com@b.org", "@a.com@b.org", "+1 (988) 555-2485x", "007.1.1.256", "a@b@c.d"]
    for text in texts:
        assert personal.base_spans(text) == brute_spans(text), text


def test_personal_query_against_brute_force(spark, small_sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()}
    rows = personal.op9(spark, small_sf).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        want = brute_spans(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, *_ in want) for n in PATTERNS)
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= {":".join(s) for s in spans}
        order = [*PATTERNS, "secret", "identity"]
        assert spans == sorted(spans, key=lambda s: (order.index(s[0]), int(s[1])))
    secrets = sum(s.startswith("secret") for r in rows for s in r.spans.split(","))
    assert secrets == sum(len(re.findall('token = "[0-9a-f]{40}"|AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}', t)) for t in docs.values())


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "+1" + "(" * 300_000):
        personal.base_spans(text)


def test_spans_apart_from_others():
    rng = random.Random(5)
    for _ in range(300):
        base = [("ip", a, a + rng.randint(1, 9)) for a in rng.sample(range(60), rng.randint(0, 6))]
        more = [("secret", a, a + rng.randint(1, 9)) for a in rng.sample(range(60), rng.randint(0, 6))]
        assert personal._apart(base, more) == [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base)]
    many = [("ip", 10 * i, 10 * i + 4) for i in range(100_000)]
    assert personal._apart(many, [(k, a + 5, b + 5) for k, a, b in many]) == [(k, a + 5, b + 5) for k, a, b in many]


def test_field_on_held_out_rows():
    field = personal.Field(*personal.trained())
    rows = personal.labelled_rows(seed=77)
    right = total = found = 0
    for row, states in zip(rows, field.decode([[w for w, _ in row] for row in rows])):
        want = [personal.STATES.index(s) for _, s in row]
        right += sum(a == b != 0 for a, b in zip(states, want))
        total += sum(b != 0 for b in want)
        found += sum(a != 0 for a in states)
    assert right / total > 0.95 and right / found > 0.95


def test_personal_data(spark):
    rows = [(1, 'é token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" and a.b@c.org'), (2, None), (3, ""),
            (4, "write to jane at example dot com today"), (5, "Licensed under CC BY-NC 4.0.\nplain words only"), (None, "1.2.3.4")]
    docs = frame(spark, rows).withColumn("personal", F.lit(0))
    found = {r.doc_id: r["_personal"] for r in personal.find_personal_data(docs).collect()}
    assert [tuple(s) for s in found[1].base] == [("email", 57, 66)]
    assert [tuple(s) for s in found[1].added] == [("secret", 11, 51)]
    assert [s.kind for s in found[4].added] == ["email"]
    assert not found[2].base and not found[3].added and not found[5].added
    assert [s.kind for s in found[None].base] == ["ip"]
    assert personal.find_personal_data(docs.limit(0)).count() == 0


# Pages -----------------------------------------------------------------------------------------


def test_pages_query_gives_articles(spark, small_sf):
    raw = {r.page_id: r for r in spark.read.parquet(f"{small_sf}/pages.parquet").collect()}
    import html
    for r in pages.op10(spark, small_sf).collect():
        article = re.search("<article>(.*?)</article>", raw[r.page_id].html, re.S)[1]
        pieces = [html.unescape(re.sub("<[^>]*>", "", p)) for p in re.split("</?(?:p|h1|br)>", article)]
        want = " ".join(" ".join(re.split("[ \t-\r]+", p)).strip(" ") for p in pieces if p.strip())
        assert (r.text, r.n_chars, r.url) == (want, len(want), raw[r.page_id].url)


def test_differencing_without_article(spark):
    def page(body):
        return f"<html><body><div>Home</div><div>About us</div>{body}<div>All rights</div></body></html>"
    rows = [(1, "http://h.org/a/1", page("<p>first &amp; own</p>")), (2, "http://h.org/a/2", page("<p>second</p><p>more</p>")),
            (3, "http://i.org/a", page("<p>alone</p>")), (4, None, page("x")), (5, "http://j.org", None), (6, "http://h.org/a/1", ""),
            (7, "http://k.org/1", page("same")), (8, "http://k.org/2", page("same")),
            (1, "http://h.org/a/1", page("<p>first &amp; own</p>"))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("own"))
    out = {r.page_id: r["_main_text"] for r in pages.main_text(docs).collect()}
    assert out[1] == "first & own" and out[2] == "second more"
    assert out[3] == "Home About us alone All rights" and out[4] == "Home About us x All rights"
    assert out[5] == "" and out[6] == "" and out[7] == out[8] == "Home About us same All rights"
    assert pages.main_text(docs).count() == len(rows) and pages.main_text(docs.limit(0)).count() == 0


def test_common_subsequence_against_brute_force():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        found, rest = pages.shared(a, b), iter(b)
        assert len(found) == size[-1][-1] and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_copies_are_no_neighbours(spark):
    def page(*blocks):
        return "".join(f"<p>{b}</p>" for b in ("Menu one", *blocks, "Imprint"))
    first, edited = [f"Part {i} of the story" for i in range(8)], [f"Part {i} of the story" for i in range(7)]
    rows = [(1, "http://a.example/x/1", page("Own words")), (2, "http://a.example/x/1", page("Own words")),
            (3, "http://a.example/x/11", page("Own words")), (4, "http://a.example/y", page("Other words")),
            (5, "http://b.example/a", page("Some words")), (6, "http://b.example/s/1", page(*first)),
            (7, "http://b.example/s/2", page(*edited, "Part edited")), (8, "http://b.example/t", page("Last words"))]
    got = {r.page_id: r.main_text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[3] == "Own words" and got[4] == "Other words"
    assert got[6] == " ".join(first) and got[7] == " ".join([*edited, "Part edited"])


def test_marked_pages_are_compared_too(spark):
    teaser = "<article><p>Read our other stories</p></article>"
    def page(*blocks, marked=True):
        body = "".join(f"<p>{b}</p>" for b in blocks)
        return f"<div>Home</div>{f'<article>{body}</article>' if marked else body}{teaser}<div>All rights</div>"
    rows = [(1, "http://a.example/1", page("One long story of its own", "A paragraph that both have")),
            (2, "http://a.example/2", page("Two is a longer story of its own", "A paragraph that both have")),
            (3, "http://b.example/1", page("No mark around this one story", marked=False)),
            (4, "http://b.example/2", page("Nor is there any around this", marked=False)),
            (5, "http://c.example/1", "<h1>Own title</h1><article><p>The same story with another title</p></article>"),
            (6, "http://c.example/2", "<h1>New title</h1><article><p>The same story with another title</p></article>"),
            (7, "http://d.example/1", page("Alone with its teaser"))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = docs.select("page_id", pages.page_key().alias("key"))
    deleted = {r.page_id: r.deleted for r in pages.deletions(docs).join(own, "key").collect()}
    assert deleted == {1: [0, 2, 3, 4], 2: [0, 2, 3, 4], 3: [0, 2, 3], 4: [0, 2, 3], 5: [1], 6: [1]}
    got = {r.page_id: r.main_text for r in pages.main_text(docs).collect()}
    assert got == {1: "One long story of its own A paragraph that both have", 2: "Two is a longer story of its own A paragraph that both have",
                   3: "No mark around this one story", 4: "Nor is there any around this", 5: "The same story with another title",
                   6: "The same story with another title", 7: "Alone with its teaser Read our other stories"}


def test_long_sequences_are_split(monkeypatch):
    rng = random.Random(5)
    pairs = [[[rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2)] for _ in range(300)]
    whole = [len(pages.shared(a, b)) for a, b in pairs]
    monkeypatch.setattr(pages, "TRACED", 4)
    for (a, b), n in zip(pairs, whole):
        found, rest = pages.shared(a, b), iter(b)
        assert len(found) == n and found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_alignment_of_long_pages_holds_little():
    import tracemalloc
    long, other = list(range(20_000)), [i for i in range(20_000) for _ in range(1 + (i % 100 == 0))]
    tracemalloc.start()
    found = pages.shared(long, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == long and peak < 30_000_000
