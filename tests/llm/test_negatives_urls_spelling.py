"""Hard negatives, url verdicts and spelling variants against brute force on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from citygrid.llm import hard_negatives, queries, spelling, url_filter

VECTORS = "vec_id long, embedding array<float>, label int, rank int, id string, dim string, score double"


def brute_negatives(rows, every=50):
    best = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in e], label, e)
        if i not in best or (row[2], row[3]) < best[i][2:]:
            best[i] = row
    out = set()
    for a, (la, va, *_) in best.items():
        if a % every:
            continue
        s = [(-sum(x * y for x, y in zip(va, v)), b, lb == la) for b, (lb, v, *_) in best.items() if b != a and len(v) == len(va)]
        for p, pid, _ in sorted(x for x in s if x[2])[:5]:
            fit = sorted((n, nid) for n, nid, same in s if not same and 50 * -p <= 100 * -n <= 95 * -p)
            out |= {(a, pid, k, nid, -p, -n) for k, (n, nid) in enumerate(fit[:3], 1)}
    return out


@pytest.mark.parametrize("block,chunk,stages", [(40, 3, 4), (1000, 1000, 1)])
def test_hard_negatives(spark, block, chunk, stages):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=20) + rng.integers(0, 2, 20) * 2).tolist(), int(rng.integers(0, 4))) for k in range(240)]
    rows += [(300 + k, rows[k % 7][1], k % 3) for k in range(60)]  # repeated vectors: ties
    rows += [(400, None, 1), (401, [1.0] * 20, None), (402, [float("nan")] * 20, 1), (403, [None] + [1.0] * 19, 1), (None, [1.0] * 20, 1), (450, [1.0, 2.0], 1), (451, [1.0, 2.0], 2), (452, [1.0, 3.0], 1), (500, [], 1), (501, [0.0] * 20, 1)]
    rows += [rows[3], (rows[5][0], rows[6][1], 3), (150, [0.0] * 20, 0), (10_000, rows[0][1], 9)]
    given = spark.createDataFrame([(*r, 1, "x", "y", None) for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(given, hard_negatives.Settings(block=block, chunk=chunk, stages=stages)).collect()
    want = brute_negatives(rows)
    assert len(got) == len(want) > 40 and {tuple(r) for r in got} == want
    assert hard_negatives.hard_negatives(given.limit(0)).count() == 0


def test_very_large_components(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [2e38, 0.0], 2), (3, [1.0, 1.0], 2), (4, [1e20, 0.0], 3)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert got == []  # all scores are the largest long, which is not 95 % of itself
    doubles = spark.createDataFrame([(50, [1e6, 2.0], 1), (1, [1e6, 0.0], 1), (2, [9e5, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in hard_negatives.hard_negatives(doubles).collect()] == [(50, 1, 1, 2, 256_000_000**2, 256_000_000 * 230_400_000)]


def test_intervals_hold_the_score_and_leave_rows_out():
    rng, s = np.random.default_rng(9), hard_negatives.Settings()
    x, q = np.floor(rng.normal(size=(500, 70)) * 256), np.floor(rng.normal(size=(20, 70)) * 256)
    codes, aligned, left = hard_negatives.encode(x, s)
    low, high = hard_negatives.intervals(q, codes, aligned, left, np.linalg.norm(x, axis=1), s)
    true = q @ x.T
    assert (low <= true).all() and (true <= high).all()
    fifth = np.partition(low, -5, 1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.5


RULES = queries.RULES


def page(host, *targets, path="/x"):
    return f"http://{host}{path}", "<p>" + "".join(f'<a class="l" href="{t}">t</a>' for t in targets)


def brute_verdicts(rows, rules, rounds=20):
    said, judged = dict(rules), []
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    links = Counter()
    for pid, url, html in rows:
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r, _ in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        judged.append((pid, host, path, max(fits, key=len, default=None)))
        shown = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ", html or "")
        for t in re.findall(r"""(?i)<a [^>]*?href=["']?(?:https?:)?//([^/?#"'\s>]+)""", shown):
            if host and lower(t) != host:
                links[host, lower(t)] += 1
    n, good, bad = (Counter(h for _, h, _, r in judged if h and keep(said.get(r))) for keep in (lambda v: True, lambda v: v == "allow", lambda v: v == "block"))

    def spread(seeds, edges):
        degree = Counter()
        for (a, _), k in edges.items():
            degree[a] += k
        own = {h: c * 10**9 // n[h] * 15 // 100 for h, c in seeds.items()}
        score = dict(own)
        for _ in range(rounds):
            after = defaultdict(int, own)
            for (a, b), k in edges.items():
                after[b] += score.get(a, 0) * 85 * k // (degree[a] * 100)
            score = after
        return score

    trust, distrust = spread(good, links), spread(bad, Counter({(b, a): k for (a, b), k in links.items()}))
    verdict = lambda h, r: said.get(r) or ("block" if h and distrust.get(h, 0) - trust.get(h, 0) >= 75_000_000 else "allow")
    return sorted((p, h, path, r or "", verdict(h, r)) for p, h, path, r in judged)


def test_urls(spark):
    rows = [
        page("A.com", "https://good.org/1", "//sub.org"), page("www.Example.com", path="/en/1"), page("m.example.com", path="/en/1"), page("example.com", "http://good.org", path="/en/?q"),
        page("x.net", path="/es/1"), page("x.net", "http://other.org", path="/de/1"), page("farm.org", "http://x.net/a", "http://y.net/", "/local", "http://FARM.org"), page("y.net", path="/fr/"),
        page("farm2.org", "http://farm.org/"), page("mixed.org", "http://x.net", "http://a.com"), page("good.org", "http://mixed.org"), page("lone.org"), page("net", path="/es/"), page("notnet", path="/es/"),
        ("http://bare.com?x", None), ("no scheme", "<a href='http://x.net'>"), (None, None), ("", ""), ("http://c.com#f://y/", "<!-- <a href='http://x.net'> --><script><a href='http://x.net'></script>"), ("a://b://c/d", "<a>"), ("http://d.com/" + "p" * 5000, "<a href=//x.net " * 50),
    ]
    rows = [(k, *r) for k, r in enumerate(rows)]
    rows += [rows[6], (None, *page("nul.org", "http://farm2.org"))]
    given = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "page_id long, url string, html string, host string, rule string, trust int")
    got = [(r["page_id"] if r["page_id"] is not None else -1, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.judge_urls(given, RULES).collect()]
    want = brute_verdicts([(-1 if p is None else p, u, h) for p, u, h in rows], RULES)
    assert sorted(got) == want
    by = {h: v for _, h, _, r, v in want if not r}
    assert by["farm.org"] == "block" and by["farm2.org"] == "block" and by["lone.org"] == "allow" and by["good.org"] == "allow"
    assert url_filter.judge_urls(given.limit(0), RULES).count() == 0
    con = duckdb.connect()
    con.register("pages", given.select("page_id", "url", "html").toArrow())
    told = con.execute(f"SELECT coalesce(page_id, -1), host, path, coalesce(rule, ''), verdict FROM ({queries.SQL['op12_urls']})").fetchall()
    assert sorted(told) == want


def brute_spelling(rows, shortest=6, least=5, times=5, slip=199):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if slip and h % slip == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    rest = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            rest[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            near[w] |= rest[k, short] - {w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), c, len(near[w]), n[form[w]] if w in form else 0) for w, c in n.items())


@pytest.mark.parametrize("most,window,slip", [(2000, 64, 199), (2, 64, 5), (3, 4, 0)])
def test_spelling(spark, most, window, slip):
    rng = random.Random(3)
    letters, rows = "abÀé", []
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    for k in range(500):
        w = rng.choice(base)
        at = rng.randrange(len(w))
        rows.append((k, " ".join(rng.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]]) for _ in range(9))))
    long = "y" + "x" * 300
    rows += [(k, f"{long} {long[1:]}1{long}z") for k in range(6)] + [(None, "nullid nullid, nullid; nullid-nullid"), (7, None), (8, ""), (9, "aaaaaa " * 3000), (9, "aaaaaa"), (10, "\n\t 123")]
    given = spark.createDataFrame([(*r, 1, "x", "y", None) for r in rows], "doc_id long, text string, n long, word string, form string, h double")
    got = spelling.spelling_variants(given, spelling.Settings(most=most, window=window, slip=slip)).collect()
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in got) == brute_spelling(rows, slip=slip)
    assert spelling.spelling_variants(given.limit(0)).count() == 0


def test_acceptor_is_minimal():
    m = spelling.Automata()
    m.acceptor(sorted(a + b + c for a in "xyz" for b in "xyz" for c in "xyz"))
    assert len(m.arcs) == 4
    assert sorted(spelling.near_pairs(["ab", "ac"], ["aab", "abc"], 3)) == [("ab", "aab"), ("ab", "abc"), ("ab", "ac"), ("ac", "abc")]
