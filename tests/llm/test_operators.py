import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose

SPACES = r"[^\x20\x09-\x0D]+"


def split(text):
    return re.findall(SPACES, text or "")


# --- mixing


def brute_targets(sizes, weights=(1, 2, 3), share=1.0, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        out = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if out[s] > most * sizes[s]]
        if not above:
            return fixed | out
        fixed |= {s: most * sizes[s] for s in above}


def test_mixing_hits_targets(spark, odd, odd_rows, empty):
    from ridgeline.llm.mixing import apply_mix, cube_mix

    got = cube_mix(odd, block_rows=8).collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len(split(r[1]))
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    again = cube_mix(odd.repartition(5), block_rows=8).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)
    mixed = apply_mix(odd, cube_mix(odd, block_rows=8))
    assert mixed.columns == odd.columns and mixed.count() == sum(r.times for r in got)
    assert cube_mix(empty).count() == 0


def test_mixing_is_balanced(spark):
    from ridgeline.llm.mixing import cube_mix

    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), None, f"s{rng.choice([0, 0, 0, 1, 2, 3])}", 0) for i in range(3000)]
    got = cube_mix(spark.createDataFrame(rows, SCHEMA), block_rows=128).toPandas()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken - per.target).abs() <= 61).all()


def test_many_equal_rows_are_one_unit_of_the_walk(spark, monkeypatch):
    from ridgeline.llm import mixing

    monkeypatch.setattr(mixing, "PIECE", 16)
    rng = random.Random(18)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), None, f"s{i % 3}", 0) for i in range(300)]
    rows += [(None, "all the same", None, "s1", 0)] * 700 + [(7, None, None, None, 0)] * 50
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.cube_mix(docs, block_rows=32).toPandas()
    assert len(got) == len(rows) and (got.taken == got["size"] * got.times).all() and got.times.between(0, 3).all()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken - per.target).abs() <= 31).all()
    same = got[got.doc_id.isna()].times
    assert same.max() - same.min() <= 1
    out = mixing.apply_mix(docs, mixing.cube_mix(docs, block_rows=32))
    assert out.count() == got.times.sum() and out.filter("text = 'all the same'").count() == same.sum()


# --- URL filters


def brute_rank(edges, seeds, damping=0.85, iterations=10):
    out = defaultdict(float)
    for s in seeds.values():
        out["all"] += s
    nodes = {a for a, _ in edges} | {b for _, b in edges} | set(seeds)
    degree = Counter()
    for (a, _), n in edges.items():
        degree[a] += n
    rank = {x: seeds.get(x, 0.0) for x in nodes}
    for _ in range(iterations):
        new = {x: (1 - damping) * seeds.get(x, 0.0) for x in nodes}
        for (a, b), n in edges.items():
            new[b] += damping * rank[a] * n / degree[a]
        for x in nodes:
            if not degree[x]:
                new[x] += damping * rank[x]
        rank = new
    return rank


def test_url_filter_rules_and_ranks(spark):
    from ridgeline.llm.url_filter import filter_urls

    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">t</a>' for h in hosts) + '<a href="/own">o</a>'
    rows = [
        (1, "https://good.org/a", link("friend.net", "friend.net", "other.net")),
        (2, "http://WWW.bad.com/de/x?y#z", link("spam.net")),
        (3, "http://spam.net/x", link("WWW.BAD.com", "bad.com")),
        (4, "http://friend.net/y#f", None),
        (5, "http://lonely.net", ""),
        (6, "no scheme", "x"),
        (7, None, None),
        (8, "http://example.org/es/1", ""),
        (9, "http://a.example.org/en/17", ""),
        (10, "http://example.org/en/2", ""),
        (11, "http://notexample.org?q", ""),
        (12, "http://other.net/q", link("friend.net")),
        (13, "http://bad.com/en/", ""),
        (None, "http://bad.com/fr/", ""),
    ]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 6, 7, 8, 9, 10, 11)] == [
        ("good.org", "/a", "org/", "allow"),
        ("www.bad.com", "/de/x", "com/de/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("a.example.org", "/en/17", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"),
        ("notexample.org", "", None, "allow"),
    ]
    assert got[3].verdict == "block" and got[4].verdict == "allow" and got[5].distrust is None
    edges, trusted, distrusted = Counter(), Counter(), Counter()
    for p, url, html in rows:
        m = re.match(r"\w+://([^/?#]*)", url or "")
        for h in re.findall(r'href="(?:https:/(/[^/]+)|/own)', html or "") if m else []:
            edges[m[1].lower(), h[1:].lower() or m[1].lower()] += 1
        if got[p].rule:
            (trusted if got[p].verdict == "allow" else distrusted)[got[p].host] += 1
    t = brute_rank(edges, trusted)
    d = brute_rank(Counter({(b, a): n for (a, b), n in edges.items()}), distrusted)
    for r in got.values():
        both = t.get(r.host, 0) + d.get(r.host, 0)
        assert r.distrust == (pytest.approx(d.get(r.host, 0) / both) if both else None)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranks_are_settled_and_reach_the_end_of_a_chain(spark):
    from ridgeline.llm.url_filter import filter_urls

    link = lambda *hosts: "".join(f'<a href="https://{h}/p">t</a>' for h in hosts)
    rows = [(i, f"http://h{i}.net/", link(f"h{i + 1}.net" if i < 13 else "bad.com")) for i in range(14)]
    rows += [(20, "http://bad.com/de/", link("mid.net")), (21, "http://good.org/", link("mid.net", "h20.net")), (22, "http://mid.net/", link("bad.com", "mid.net", "good.org"))]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {(got[i].verdict, got[i].distrust) for i in range(14)} == {("block", 1.0)}
    edges = Counter((re.match(r"\w+://([^/]*)", u)[1], h) for _, u, html in rows for h in re.findall(r'href="https://([^/]+)', html))
    t = brute_rank(edges, {"good.org": 1}, iterations=400)
    d = brute_rank(Counter({(b, a): n for (a, b), n in edges.items()}), {"bad.com": 1}, iterations=400)
    for i in (20, 21, 22):
        h = got[i].host
        assert got[i].distrust == pytest.approx(d[h] / (t[h] + d[h]), rel=1e-6)


def test_hub_hosts_odd_columns_and_hostile_pages(spark, monkeypatch):
    from ridgeline.llm import url_filter

    rng = random.Random(17)
    hosts = [f"h{i}.net" for i in range(30)] + ["bad.com", "good.org"]
    link = lambda hs: "".join(f'<A class=x HREF=//{h}/p>t</a>' for h in hs)
    rows = [(i, f"http://{h}/{'de/' if h == 'bad.com' else ''}", link(hosts if i == 0 else rng.sample(hosts, 2))) for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: (r.verdict, round(r.distrust, 9)) for r in url_filter.filter_urls(pages).collect()}
    monkeypatch.setattr(url_filter, "HUB", 4)
    odd = pages.selectExpr("*", "'x' as host", "1 as rule", "2 as rank", "'d' as way", "3 as cell", "4 as src", "5 as verdict")
    got = url_filter.filter_urls(odd).collect()
    assert {r.page_id: (r.verdict, round(r.distrust, 9)) for r in got} == want and len(got) == len(rows)
    hostile = spark.createDataFrame([(1, "http://a.net", "<a " * 300_000), (2, "http://b.net", "<a href" * 300_000)], "page_id long, url string, html string")
    assert url_filter.filter_urls(hostile).count() == 2


# --- language ID


def test_language_id(spark, odd, empty):
    from ridgeline.llm.langid import identify, keep_identified, learn

    rng = random.Random(2)
    ends = {"en": ("ing", "th", "the"), "fr": ("eau", "é", "que"), "de": ("sch", "ung", "ö")}
    rows = [(i, " ".join(rng.choice("bcdfgm") + rng.choice(ends[lang]) for _ in range(12)), lang, "s", 0) for i in range(600) for lang in [rng.choice(list(ends))]]
    docs = spark.createDataFrame([*rows, (1000, "12 34 !", "en", "s", 0), (1001, None, "fr", "s", 0), (1002, "", None, None, 0)], SCHEMA)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert len(got) == 603
    for i, _, lang, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    held = [(got[i].lang_pred, lang) for i, _, lang, *_ in rows if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].score == 0
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = keep_identified(odd, learn(docs))
    assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0


def plain_bayes(rows, texts):
    """Naive Bayes by loops: {text: (language, posterior)}."""
    from math import exp, log

    from ridgeline.llm.langid import ALPHA, BUCKETS

    full = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    def grams(text):
        chars = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                gram = chars[i : i + n]
                if any(c != 32 for c in gram):
                    code = 0
                    for c in gram:
                        code = code * (1 << 21) + c & full
                    yield mixed(code * 4 + n & full) % (BUCKETS - 1) + 1

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in rows:
        counts[lang].update(grams(text))
        docs[lang] += 1
    out = {}
    for text in texts:
        like = {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + ALPHA * BUCKETS
            like[lang] = log(docs[lang] / sum(docs.values())) + sum(log((counts[lang][g] + ALPHA) / total) for g in grams(text))
        best = max(sorted(like), key=like.get)
        out[text] = (best, 1 / sum(exp(x - like[best]) for x in like.values()))
    return out


def test_language_id_is_plain_naive_bayes_and_the_filter_rejects_what_was_never_learned(spark):
    from ridgeline.llm.langid import identify, keep_identified, learn, predict

    rng = random.Random(21)
    ends = {"en": ("ing", "th", "the"), "fr": ("eau", "é", "que"), "de": ("sch", "ung", "ö")}
    word = lambda lang: rng.choice("bcdfgm") + rng.choice(ends[lang])
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(1, 6))), lang, "s", 0) for i in range(150) for lang in [rng.choice(list(ends))]]
    rows += [(i, " ".join(word(rng.choice(list(ends))) for _ in range(2)), None, "s", 0) for i in range(150, 200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    learned = [(t, lang) for i, t, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    want = plain_bayes(learned, {r[1] for r in rows})
    for r in identify(docs.withColumn("lang_pred", F.lit(7))).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (r.lang_pred, r.score) == (want[r.text][0], pytest.approx(want[r.text][1], abs=1e-4))
    strange = spark.createDataFrame([(900, "Это обычный русский текст, который никогда не был выучен", None, "s", 0), (901, "これは日本語の文章です。", None, "s", 0)], SCHEMA)
    kept = {r.doc_id for r in keep_identified(docs.unionByName(strange), learn(docs)).collect()}
    assert kept & {900, 901} == set() and len(kept) > 190
    assert {r.lang_pred for r in identify(docs.limit(0)).collect()} == set()
    whole, cut = learn(docs), learn(docs, 2)
    assert whole.names == cut.names == sorted(ends) and [len(whole.slices), len(cut.slices)] == [1, 2]
    assert predict(docs, whole).orderBy("doc_id").collect() == [pytest.approx(r) for r in predict(docs, cut).orderBy("doc_id").collect()]


def test_no_language_is_left_out(spark):
    from ridgeline.llm.langid import identify

    letters = "abcdefghijklmnopqrstuvwxyzäöüéèßñçøå"
    rows = [(1000 * i + j, f"{a}{b}" * (5 + j), a + b, "s", 0) for i, (a, b) in enumerate((a, b) for a in letters for b in letters if a < b) for j in range(3)]
    docs = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], SCHEMA)
    assert docs.select("lang").distinct().count() > 600
    wrong = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred != lang").count()
    assert wrong == 0


# --- decontamination


def test_retrieval_loses_no_pair_that_aligns(spark):
    from ridgeline.llm.decontaminate import _one, aligned, contaminated

    rng = random.Random(22)
    items = [prose(rng, rng.randint(8, 40)) for _ in range(8)]
    items += [items[0] + " 5 km", "On day 3 the train to Rome took 7 hours and the bus to Oslo took 9 hours for 20 euro"]
    texts = [None, "", prose(rng, 300)]
    for i in range(60):
        words = rng.choice(items).split()
        for _ in range(rng.randint(0, len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(("9", "Paris", prose(rng, 1)))
        texts.append(prose(rng, rng.randint(0, 40)) + " " + " ".join(words) + ". " + prose(rng, rng.randint(0, 40)))
    docs = spark.createDataFrame([(i if i % 9 else None, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).selectExpr("*", "1 as id", "2 as print", "3 as hash", "4 as items")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "9 as id", "8 as doc_id")
    want = {(i if i % 9 else None, k) for i, t in enumerate(texts) for k, item in enumerate(items) if t and aligned(_one(t), _one(item), 0.8)}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want and len(want) > 20


def test_decontamination(spark, empty):
    from ridgeline.llm.decontaminate import contaminated

    rng = random.Random(3)
    question = "A train leaves Rome at 9 and covers 120 km in 2 hours while Anna walks 5 km to the station, how far is the train from Rome when Anna arrives there after 3 hours"
    changed = question.replace("Rome", "Oslo").replace("Anna", "Bert").replace("120", "75.5").replace("5 km", "8 km").replace(" 9 ", " 10 ").replace("2 hours", "4 hours").replace("3 hours", "6 hours")
    mangled = question.replace("from Rome", "from Lima").replace("when Anna", "when Carl").replace("while Anna", "while Dora").replace("leaves Rome", "leaves Kiev")
    benchmark = spark.createDataFrame([(1, question), (2, prose(rng, 40)), (3, "too short"), (4, None)], "item_id long, text string")
    item2 = benchmark.filter("item_id = 2").first().text
    texts = {1: prose(rng, 50) + ". " + question + ". " + prose(rng, 50), 2: changed, 3: mangled, 4: prose(rng, 500), 5: item2[: len(item2) // 2], 6: "Before. " + item2 + "\nafter", 7: None, 8: "", 9: prose(rng, 9000) + " " + item2}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()] + [(6, texts[6], None, None, 0)], SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (9, 2)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].slot_agreement == 1.0
    assert contaminated(empty, benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0


# --- n-gram join


def test_every_stretch_is_compared():
    from ridgeline.llm.decontaminate import _one, aligned

    rng = random.Random(6)
    question = "A train leaves Rome at 9 and covers 120 km in 2 hours while Anna walks 5 km to the station, how far is the train from Rome when Anna arrives there after 3 hours"
    mangled = question.replace("from Rome", "from Lima").replace("when Anna", "when Carl").replace("while Anna", "while Dora").replace("leaves Rome", "leaves Kiev")
    other = question.replace("Rome", "Oslo").replace("Anna", "Bert")
    edited = question.replace("leaves", "is leaving", 1)
    item = _one(question)
    found = lambda text: aligned(_one(text), item, 0.8)
    assert found(mangled) is None and found(mangled + ". " + mangled) is None
    for text in (mangled + ". " + prose(rng, 200) + ". " + question, question + ". " + prose(rng, 200) + ". " + mangled, mangled + ". " + question, question + ". " + mangled):
        hit = found(text)
        assert hit and hit[2] == 1.0 and hit[3] == 1.0 and hit[4], text
    for text in (edited + ". " + other, other + ". " + edited, edited + ". " + other + ". " + mangled, "while Dora walks 5 km to the " + other):
        hit = found(text)
        assert hit and hit[3] >= 0.8, text


def test_items_that_share_an_id_are_each_looked_for(spark):
    from ridgeline.llm.decontaminate import contaminated

    rng = random.Random(7)
    texts = [prose(rng, 15) for _ in range(60)]
    benchmark = spark.createDataFrame([(None if i % 2 else 4, t) for i, t in enumerate(texts)] + [(9, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(rng, 20) + " " + t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()}
    assert got == {(i, None if i % 2 else 4) for i in range(60)} | {(0, 9)}


def brute_components(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = split((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(top(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 512), (5, 80, 4)])
def test_ngram_join(spark, odd, odd_rows, empty, monkeypatch, k, percent, block):
    from ridgeline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(4)
    base = prose(rng, 120).split()
    rows = list(odd_rows)
    for i in range(40):  # a dense group, with links of all strengths
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice("xyz") * 3
        rows.append((100 + i, " ".join(w), None, None, 0))
    got = ngram_join.similar_sets(spark.createDataFrame(rows, SCHEMA), k, percent).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows, k, percent), key=key)
    if block == 4:
        assert ngram_join.similar_sets(empty, k, percent).count() == 0
        kept = ngram_join.keep_first(odd, ngram_join.similar_rows(odd, k, percent))
        assert kept.columns == odd.columns
        want = {r[0] for r in brute_components(odd_rows, k, percent) if r[0] is not None and r[0] == r[2]}
        assert want <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_ngram_join_with_a_token_that_nearly_all_sets_hold(spark):
    from ridgeline.llm import ngram_join

    rng = random.Random(14)
    line = "this line stands in nearly every text of the source"
    rows = [(i, f"{prose(rng, rng.randint(3, 60))} {line if i % 8 else ''} {prose(rng, 5)}", None, None, 0) for i in range(160)]
    rows += [(1000 + i, r[1] + " and", None, None, 0) for i, r in enumerate(rows[:40])] + [(2000 + i, r[1], None, None, 0) for i, r in enumerate(rows[:60])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    tokens, classes = ngram_join._common(docs.selectExpr("text", "xxhash64(doc_id) as key"), docs, 3)
    assert len(tokens) >= 8 and classes.min() > 0
    got = sorted(map(tuple, ngram_join.similar_sets(docs, 3, 90).collect()))
    assert got == sorted(brute_components(rows, 3, 90))


# --- license scans


def test_license_scan(spark, odd, empty):
    from ridgeline.llm.license_scan import TEMPLATES, scan

    rng = random.Random(6)
    apache = TEMPLATES["Apache-2.0 header"]
    rows = [
        (1, prose(rng, 300) + " " + apache.upper().replace(" ", "\n") + " " + prose(rng, 300)),
        (2, "released under the mit license."),
        (3, " ".join(apache.split()[:40])),
        (4, apache.replace("compliance", "accordance")),
        (5, None),
        (6, "Licensed under"),
        (7, prose(rng, 5000)),
    ]
    rows = [(i, t, None, None, 0) for i, t in rows]
    got = {(r.doc_id, r.license): r for r in scan(spark.createDataFrame([*rows, rows[1]], SCHEMA)).collect()}
    assert {k for k in got if k[1] != "Apache-2.0 line"} == {(1, "Apache-2.0 header"), (2, "MIT line"), (4, "Apache-2.0 header")}
    assert got[1, "Apache-2.0 header"].containment == 1 and got[1, "Apache-2.0 header"].position == 300
    assert 0.8 <= got[4, "Apache-2.0 header"].containment < 1
    assert scan(empty).count() == 0 and scan(odd).count() == 0


# --- quality rules


def test_line_quality_against_sql(spark, odd, odd_rows, empty):
    import duckdb

    from ridgeline.llm import line_quality

    rng = random.Random(7)
    line = prose(rng, 30)
    rows = odd_rows + [(200 + i, line + "\n" + prose(rng, 40 if i % 2 else 5), "en", "s1", 0) for i in range(14)] + [(300, line, "en", "s2", 0)] * 15
    rows += [(None if i else -1, line.upper() + "\n" + prose(rng, 60 + i), "en", "s9", 0) for i in range(12)]
    rows += [(None, line + "\n" + prose(rng, 60), "en", "s8", 0)] * 12
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_quality.judge(docs).toPandas()
    assert sorted(got.n_removed_words[got.doc_id.isna() & (got.n_words > 88)])[-12:] == [0] + [30] * 11
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(line_quality.SQL).df()
    flat = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype({"doc_id": "Int64"}).itertuples(index=False))
    assert flat(got) == flat(want)
    kept = dict(zip(got.doc_id, got.kept, strict=True))
    assert kept[201] and not kept[202] and kept[300]
    assert line_quality.judge(empty).count() == 0 and line_quality.judge(odd).count() == len(odd_rows)


# --- HTML extraction


def test_html_extraction(spark):
    from ridgeline.llm.html_extract import extract

    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News &amp; more</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and by staying here you agree to this long notice of many words.</p></div>
<article><h1>Title &eacute;</h1><p>First <b>bold</b>paragraph,   with&nbsp;words and a line<br>break.<p>Of.</p><div class="ad">Buy this now, a very good thing for all of you, only today.</div><p>Last one &lt;here&gt;.</article>
<aside><p>Some other reading that is long enough to look like text, with commas, and so on.</p></aside>
<section class="comments"><p>I read this article with great pleasure and want to tell everybody about it.</p></section><form><label>Name</label></form><footer>&copy; host</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain text only"), (5, "u", "<!-- never closed <p>text"), (1, "u", page)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6
    assert by[1].text == "Title é\nFirst boldparagraph, with words and a line break.\nOf.\nLast one <here>."
    assert by[1].n_chars == len(by[1].text) and by[4].text == "plain text only"
    assert [by[i].text for i in (2, 3, 5)] == ["", "", ""]


def test_marks_around_the_article_do_not_drop_it():
    from ridgeline.llm.html_extract import main_text

    rng = random.Random(9)
    first, last, teaser, said = (prose(rng, n) for n in (100, 30, 12, 40))
    menu = "<nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav>"
    article = f"<article><p>{first}</p><p>{last}</p></article>"
    rest = f'<aside class="related"><article><p>{teaser}</p></article></aside><section class="comments"><article class="comment"><p>{said}</p></article></section><footer>&copy; host</footer>'
    want = f"{first}\n{last}"
    for page in (
        f'<html class="no-widgets"><body class="has-sidebar">{menu}{article}{rest}</body></html>',
        f'<body>{menu}<div class="layout-sidebar"><div>{article}{rest}</div></div></body>',
        f"<body><form action=x>{menu}{article}{rest}</form><div>Copyright</div></body>",
        f'<body><form action=x>{menu}<div class="page"><p>{first}</p><p>{last}</p></div>{rest}</form></body>'.replace("article", "div"),
        f'<body>{menu}<div class="overflow-hidden" aria-hidden="false">{article}</div>{rest}</body>',
        f'<body><div class="sidebar-page"><div id="content"><p>{first}</p><p>{last}</p></div></div>{menu}</body>',
        f'<body>{menu}{article.replace("<article", "<article class='post category-social'")}{rest}</body>',
        f"<body>{menu}{article}<div hidden><article><p>{said}</p></article></div><div style='display: none'><p>{said}</p></div></body>",
    ):
        assert main_text(page) == want, page[:80]
    math = "<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></semantics></math>"
    assert main_text(f"<article><p>{first} {math} then</p></article>") == f"{first} x=2 then"
    assert main_text(f'<body><div><p>{first}</p></div><footer><div class="content"><p>{teaser}</p></div></footer></body>') == first
    assert main_text(f"<article hidden><p>{first}</p></article><form><label>Name</label><input></form>") == ""


def test_the_cut_decides_where_a_block_alone_would_not():
    from ridgeline.llm.html_extract import labelled

    rng = random.Random(15)
    first, last, entry, long_footer = (prose(rng, n) for n in (60, 30, 9, 90))
    menu = "".join(f"<li><a href=x>{prose(rng, 2)}</a></li>" for _ in range(3))
    page = f"<body><ul>{menu}<li>{entry}</li>{menu}</ul><div><p>{first}</p>Of<p>{last}</p></div><footer><p>{long_footer}</p></footer></body>"
    found = labelled(page)
    assert [k for _, _, k in found] == [False] * 7 + [True, True, True, False]
    assert [s > 0 for _, s, _ in found] == [False] * 3 + [True] + [False] * 3 + [True, False, True, False]


INNER = [
    ('<section class="related-work"><h2>Related work</h2><p>{}</p></section>', 30, "Related work\n{}"),
    ('<div class="discussion"><p>{}</p></div>', 30, "{}"),
    ('<p class="legal">{}</p>', 12, "{}"),
    ("<div><header><h1>{}</h1></header></div>", 5, "{}"),
    ("<p>Press <button>Save</button> to keep it, {}</p>", 9, "Press Save to keep it, {}"),
    ('<div class="ad">{}</div>', 12, ""),
    ('<section class="comments"><p>{}</p></section>', 30, ""),
    ("<aside><p>{}</p></aside>", 20, ""),
    ("<form><label>Name</label><button>Send</button></form>", 1, ""),
]


@pytest.mark.parametrize("part", range(len(INNER)))
@pytest.mark.parametrize("at", [0, 2, 4])
def test_parts_of_the_article_stay_and_what_stands_in_it_goes(part, at):
    from ridgeline.llm.html_extract import PRIOR, examples, fitted, main_text

    rng = random.Random(part)
    html, n, want = INNER[part]
    own, paragraphs = prose(rng, n), [prose(rng, 40) + "." for _ in range(4)]
    blocks = [f"<p>{p}</p>" for p in paragraphs]
    page = "<body><nav><ul><li><a href=x>Home</a></ul></nav><article>" + "".join([*blocks[:at], html.format(own), *blocks[at:]]) + "</article><footer>&copy; host</footer></body>"
    text = "\n".join([*paragraphs[:at], *([want.format(own)] if want else []), *paragraphs[at:]])
    plain = "<body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class=ad>Buy this now.</div><article><h1>A title</h1>" + "".join(blocks) + "</article><footer>&copy; host, and a line.</footer></body>"
    learned = [x for _ in range(200) for x in examples(plain)]
    import numpy as np

    for weights in (PRIOR, fitted(np.array([x for x, _ in learned], float), np.array([y for _, y in learned]))):
        assert main_text(page, weights) == text


def test_text_alone_tells_once_the_weights_are_fitted(spark):
    from ridgeline.llm.html_extract import extract, fit

    rng = random.Random(31)
    pages = []
    for i in range(60):
        body = f"<h1>{prose(rng, 6)}</h1>" + "".join(f"<p>{prose(rng, rng.randint(10, 80))}.</p>" for _ in range(rng.randint(1, 6)))
        menu = "".join(f"<li><a href=x>{prose(rng, 1)}</a></li>" for _ in range(4))
        pages.append((i, "u", f'<body><nav><ul>{menu}</ul></nav><div class="ad">{prose(rng, 5)}.</div><article>{body}</article><footer>&copy; host {prose(rng, 8)}.</footer></body>'))
    marked = spark.createDataFrame(pages, "page_id long, url string, html string")
    weights = fit(marked)
    assert (fit(marked) == weights).all() and (fit(marked.limit(0)) != weights).any()
    bare = [(i, u, re.sub(r' class="\w+"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h))) for i, u, h in pages]
    want = {r.page_id: r.text for r in extract(marked, weights).collect()}
    assert all(want.values())
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(bare, marked.schema), weights).collect()} == want


def test_hostile_pages_take_linear_time():
    import time

    from ridgeline.llm.html_extract import main_text

    start = time.time()
    for page in ("<a " * 400_000, '<a "' * 200_000 + ">", "<a '\"'>" * 100_000, "<div class=ad>" * 50_000 + "x", "<form>w " * 50_000, "<ul>" * 50_000 + "</div>" * 50_000, "</script " * 50_000 + ">", "<p>Of.</p>" * 50_000, "<div><p>word word</p><p>x</p></div><ul><li>a</ul>" * 5_000):
        main_text(page)
    assert time.time() - start < 60


def test_extraction_of_long_pages_extra_columns_and_no_rows(spark):
    from ridgeline.llm.html_extract import extract

    rng = random.Random(16)
    paragraphs = [prose(rng, 12) for _ in range(5000)]
    page = "<nav><a href=x>Home</a></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    rows = spark.createDataFrame([(1, "u", page), (None, None, page)], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = extract(rows).collect()
    assert [r.text for r in got] == ["\n".join(paragraphs)] * 2 and got[0].n_chars == len(got[0].text)
    assert extract(rows.limit(0)).count() == 0


def test_min_cut_is_minimal():
    from itertools import product

    from ridgeline.llm.html_extract import min_cut

    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: sum(-s for s, v in zip(scores, x, strict=True) if s < 0 and v) + sum(s for s, v in zip(scores, x, strict=True) if s > 0 and not v) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(min_cut(scores, edges)) == pytest.approx(min(cost(x) for x in product([False, True], repeat=n)))


# --- sharding


def test_kd_shards(spark, odd, odd_rows, empty):
    from ridgeline.llm.kd_shards import kd_shards, with_shard

    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 80)), None, None, 0) for i in range(4000)] + [(5000 + i, "same text", None, None, 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = kd_shards(docs, 8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.06 * sums.min()
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    small = got[got.doc_id < 5000].groupby("text_crc32").shard.nunique()
    assert small.max() == 1
    again = kd_shards(docs.repartition(7), 8).toPandas()
    assert sorted(zip(got.doc_id, got.shard, got.slot, strict=True)) == sorted(zip(again.doc_id, again.shard, again.slot, strict=True))
    placed = {r.doc_id: r.shard for r in with_shard(docs, 8).collect()}
    assert placed == dict(zip(got.doc_id, got.shard, strict=True))
    few = kd_shards(odd, 40).collect()
    assert len(few) == len(odd_rows) and all(0 <= r.shard < 40 for r in few)
    for r in few:
        if r.size == 16:
            assert r.text_crc32 == 0
    assert kd_shards(empty, 40).count() == 0 and with_shard(empty, 40).count() == 0


def test_shards_are_balanced_whatever_the_names(spark):
    from ridgeline.llm.kd_shards import kd_shards, with_shard

    rng = random.Random(14)
    rows = [(i, prose(rng, rng.choice((5, 40, 400, 900))), None, None, 0) for i in range(1500)]
    rows += [(3000 + i, "hot text " * 9, None, None, 0) for i in range(9000)] + [(None, None, None, None, None)] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    named = docs.selectExpr("*", "1L as weight", "'n' as node", "0.5 as __t", "7 as cut_node", "1 as lo_v", "2 as __h", "3 as placed", "99 as shard")
    got = kd_shards(docs, 8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() < 1.01 * sums.mean() and sums.min() > 0.99 * sums.mean()
    parts = got.groupby("text_crc32").shard.nunique()
    assert (parts > 1).sum() == 1  # only the texts that together outweigh a shard
    out = with_shard(named, 8)
    assert out.columns == named.columns and {r.node for r in out.select("node").collect()} == {"n"}
    assert out.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("n")).toPandas().set_index("shard").n.to_dict() == sums.to_dict()


# --- repeated byte strings


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats(spark, odd_rows, empty, monkeypatch):
    from ridgeline.llm import suffix_levels

    monkeypatch.setattr(suffix_levels, "PART_SPANS", 2)
    rng = random.Random(10)
    passage = prose(rng, 120)
    rows = odd_rows + [(400 + i, prose(rng, 60) + passage[i : 500 + i] + prose(rng, 60), None, None, 0) for i in range(8)]
    rows += [(500, passage[:399], None, None, 0), (501, "é" * 300 + passage[:450], None, None, 0), (502, "ab" * 220, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_levels.remove_repeats(docs).collect())))
    want = sorted(map(str, ((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 400), strict=True))))
    assert got == want
    assert suffix_levels.remove_repeats(empty).count() == 0


def test_a_later_batch_finds_matches_in_levels_that_stand_there(spark, tmp_path):
    from ridgeline.llm.suffix_levels import _ARRAYS, _INDEX, LevelFamily, _indexed

    rng = random.Random(19)
    passage = prose(rng, 150)

    def batch(rows):
        index = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(_indexed(400), _INDEX)
        return index.select(F.col("doc_id").alias("id"), "k", F.inline(F.arrays_zip(*_ARRAYS)))

    folder = str(tmp_path / "levels")
    texts = {i: prose(rng, 200) for i in range(9)}
    texts[1] += " " + passage
    texts[8] = passage[7:] + texts[8]
    for i in range(8):
        found = LevelFamily(spark, folder).add(batch([(i, texts[i])]))
        assert found.count() == 0
    opened = LevelFamily(spark, folder)
    assert opened.levels == [(0, 7)]
    level = opened.read((0, 7)).collect()
    assert [(r.lead, r["head"], r.rgt) for r in level] == sorted((r.lead, r["head"], r.rgt) for r in level)
    raw = {i: t.encode() for i, t in texts.items()}
    for r in level:
        assert int.from_bytes(raw[r.id][r["at"] : r["at"] + 8], "big") == r.lead + (1 << 63)
    found = opened.add(batch([(8, texts[8])]))
    assert opened.levels == [(0, 7), (8, 8)] and LevelFamily(spark, folder).levels == opened.levels
    pairs = {}
    for r in opened.entries(found).collect():
        pairs.setdefault(r["head"], {})[r.id] = raw[r.id][r["at"] : r["at"] + 64]
    assert pairs and all(set(p) == {1, 8} and p[1] == p[8] for p in pairs.values())


def test_ladders_drop_only_what_cannot_match(spark, monkeypatch):
    from ridgeline.llm import suffix_levels

    rng = random.Random(20)
    common, rows = prose(rng, 90)[:520], []
    for i in range(60):  # shared pieces of every length around 400, at every distance from the anchor
        a = rng.randint(0, 200)
        piece = common[a : a + rng.randint(300, 500)]
        rows.append((i, prose(rng, rng.randint(0, 60)) + piece + prose(rng, rng.randint(0, 60)), None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((i, *x) for (i, *_), x in zip(rows, brute_repeats([r[1] for r in rows], 400), strict=True))
    for spans in (4096, 3):
        monkeypatch.setattr(suffix_levels, "PART_SPANS", spans)
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_levels.remove_repeats(docs).collect()) == want


def test_repeats_return_the_kept_text_and_the_removed_spans(spark):
    from ridgeline.llm import suffix_levels

    rng = random.Random(21)
    passage = prose(rng, 120)
    texts = [prose(rng, 60), "é" * 3 + passage, prose(rng, 50) + passage + prose(rng, 20), None, "", "é" * 250 + "!", "x" + "é" * 250 + "?"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in suffix_levels.remove_repeats(docs).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert got[3].text is None and got[4].text == "" and got[0].text == texts[0] and not got[0].spans
    for i, (t, want) in enumerate(zip(texts, brute_repeats(texts, 400), strict=True)):
        raw, r = (t or "").encode(), got[i]
        left, at = b"", 0
        for x in r.spans:
            left, at = left + raw[at : x.start], x.end
        left += raw[at:]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        assert (len(raw) - len(left), len(r.spans), hashlib.sha256(left).hexdigest()) == want[1:]
        assert (r.text or "") == left.decode("utf-8", "replace")
    assert passage not in got[1].text and passage not in got[2].text


def test_entries_of_hot_spans_stay_where_they_lie(spark, monkeypatch):
    from ridgeline.llm import suffix_levels

    monkeypatch.setattr(suffix_levels, "HOT_TIMES", 50)
    rng = random.Random(22)
    lines, passage = (prose(rng, 9) + "\n") * 40, prose(rng, 120)
    rows = [(i, prose(rng, 20) + lines + prose(rng, 20), None, None, 0) for i in range(12)]
    rows += [(20 + i, prose(rng, 20) + passage + prose(rng, 20), None, None, 0) for i in range(3)] + [(30, prose(rng, 200), None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = docs.select("doc_id", "text").mapInArrow(suffix_levels._indexed(400), suffix_levels._INDEX)
    entries = suffix_levels.saved(index.select(F.col("doc_id").alias("id"), "k", F.inline(F.arrays_zip(*suffix_levels._ARRAYS))))
    spans = suffix_levels.saved(entries.groupBy("head", "span").agg(F.count(F.lit(1)).alias("times")))
    most = spans.orderBy(F.desc("times")).first()
    assert most.times == 12 * 30
    whole = suffix_levels._repeated(entries, spans)
    assert whole.count() == spans.filter("times > 1").agg(F.sum("times")).first()[0]
    held = whole.filter((F.col("head") == most["head"]) & (F.col("span") == most.span)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == most.times and max(r["count"] for r in held) < most.times
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_levels.remove_repeats(docs).collect())
    assert got == sorted((i, *x) for (i, *_), x in zip(rows, brute_repeats([r[1] for r in rows], 400), strict=True))


def test_planted_passages_are_read_by_n_removed_and_text_not_by_n_bytes(spark, tmp_path):
    import __spark_entry__ as entry

    rng = random.Random(23)
    planted = {i: (prose(rng, 30), prose(rng, 90), prose(rng, 30)) for i in range(0, 20, 2)}
    planted |= {i + 1: (prose(rng, 30), planted[i][1], prose(rng, 30)) for i in list(planted)}
    short = "of it so we go on " * 12  # 72 words, 216 bytes: stays
    texts = {i: " ".join(x) for i, x in planted.items()} | {100 + i: prose(rng, 150) for i in range(20)}
    texts |= {200 + i: prose(rng, 30) + short + prose(rng, 30) for i in range(2)}
    assert all(len(x[1]) > 400 and len(x[1].split()) > 50 for x in planted.values()) and len(short.split()) > 50
    rows = [(i, t, None, None, len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["op10_suffix_levels"](spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r.n_removed} == set(planted)
    assert all(planted[i][1] not in got[i].text and len(got[i].text) <= len(texts[i]) - len(planted[i][1]) for i in planted)
    assert all(r.text == texts[i] for i, r in got.items() if i not in planted)
    assert all(r.n_bytes == len(texts[i].encode()) for i, r in got.items()) and sorted(got) == sorted(texts)
