"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

from citygrid.llm import html, mixing, near_vectors, ogg, pieces, quality, secrets


def test_pieces_that_start_with_the_dummy_space():
    c = pieces.codec(pieces.default_model())
    crossing = [p for p in c.ids if pieces.FINE.match(p).end() < len(p)]
    texts = ["_a", "_word_ b", "a\nb", "\n", "\n\n a\n b \n", "a\0b\nc", "\0", "a \n_b\n\n_", "x\r\ny", "▁_", "{_x", " _a", "a _b", *(p.lstrip(pieces.SPACE) for p in crossing), *(p.replace(pieces.SPACE, " ") for p in crossing)]
    encoded = [c.encode(t)[0] for t in texts]
    assert encoded == c.library.encode(texts)
    c.check(texts, encoded)


def test_pieces_check_sees_wrong_cuts(monkeypatch):
    c = pieces.Codec(pieces.default_model())  # the shared one may remember the word
    monkeypatch.setattr(c, "crossing", [])
    encoded = [c.encode("_a")[0]]
    c.check_new()
    with pytest.raises(ValueError):
        c.check(["_a"], encoded)


def test_pieces_of_new_words_side_by_side(monkeypatch):
    """Words merged in step are those of the agenda and of the library, whatever the memo holds; short words of known
    characters that cross no cut are not merged alone."""
    c, alone = pieces.Codec(pieces.default_model()), []
    merge = c.merge
    monkeypatch.setattr(c, "merge", lambda word: alone.append(word) or merge(word))
    rng = np.random.default_rng(5)
    signs = list("abcdeinorstéß.,;:!?'-0179(){}/") + ["th", "ing", "ción", " ", " ", "\n", "  "]
    texts = ["".join(rng.choice(signs, int(n))) for n in rng.integers(0, 400, 300)] + ["", " ", "\n", "a ", " a", "▁a", "x" * 32, "e" * 31, "\ud7ff", "日本"]
    monkeypatch.setattr(pieces, "CHARS", 5_000)
    for most in (300_000, 50):
        c.words.most = most
        encoded = c.encode_all(texts)
        assert [e[0] for e in encoded] == c.library.encode(texts)
        assert [e[1] for e in encoded] == [",".join(map(str, e[0])) for e in encoded] and encoded[:20] == [c.encode(t) for t in texts[:20]]
        c.check(texts, [e[0] for e in encoded])
    alone.clear()
    words = [f"{a}{b}{k}" for k in range(1_000) for a, b in (("the", "ing"), ("ción", ","), ("(x", "y)"))]
    assert [e[0] for e in c.encode_all([" ".join(words)])] == c.library.encode([" ".join(words)]) and not alone
    words = [w for w in {w for t in texts for w in t.replace("\n", " ").split()} if len(w) <= pieces.SHORT]
    assert {w: list(v) for w, v in c.merge_all(words).items()} == {w: [c.ids[s] for s in merge(w)] for w in words if all(s in c.ids for s in merge(w))}


def test_mixing_labels_of_documents_that_are_gone(spark):
    """They change neither the terms, nor the priors, nor the size of the sample."""
    rows = [(k, " ".join(["bad" if k % 4 == 0 else "fine", f"w{k % 5}", *["word"] * (5 + k % 7)])) for k in range(200)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "id long, text string")
    of = lambda ids: spark.createDataFrame([(k, "toxic" if k % 4 == 0 else "good") for k in ids], "id long, domain string")
    s = mixing.Settings(rows=120)
    want, prior = mixing.fit_terms(docs, of(range(200)), ["good", "toxic"], s)
    got, prior_too = mixing.fit_terms(docs, of(range(200)).unionByName(of(range(1001, 3000, 2))), ["good", "toxic"], s)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and prior == prior_too
    for r in mixing.posteriors(docs, of(range(200)), ["good", "poor", "toxic"], s).collect():
        assert r["p"][1] == 0 and (r["p"][2] > 0.5) == (r["id"] % 4 == 0)
    assert {"bad", "fine"} <= {r["term"] for r in got.collect()} and "word" not in {r["term"] for r in got.collect()}


def test_near_vectors_with_many_lists(spark):
    """Counts are symmetric, no link is false and nearly all are found when there are many lists."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 32))
    x = np.vstack([x, x + 0.45 * rng.normal(size=x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(32)]).astype(np.float32)
    s = near_vectors.Settings(per_list=8)
    given = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(given, s=s).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[k] for k in range(len(x))])
    assert links.sum() > 500 and (found <= links.sum(1)).all() and found.sum() >= 0.98 * links.sum()
    pairs = links.sum(1) == 1  # one link each: both ends have it or neither
    partner = links.argmax(1)
    assert (found[pairs & pairs[partner]] == found[partner[pairs & pairs[partner]]]).all()


def test_quality_sees_whole_words():
    """The end of a text without white space counts, whatever its length."""
    s = quality.Settings()
    for n in (61, quality.SLICE - 1, 3 * quality.SLICE + 7):
        word = "".join(chr(0x4E00 + (k * k) % 997) for k in range(n))
        marked = f"<{word}>"
        grams = [marked[i : i + k] for k in (3, 4) for i in range(len(marked) - k + 1)]
        assert sorted(quality.features(word, s)) == sorted(2 + quality.zlib.crc32(g.encode()) % (s.buckets - 2) for g in [word, *grams])
        ids, shares = quality.bag(word, quality.GenerationalCache(lambda w: quality.features(w, s), longest=quality.LONG), s)
        assert len(set(quality.features(word, s))) == len(ids) - 1 and abs(shares.sum() - 1) < 1e-5
    model = np.zeros(s.buckets, np.float32)
    model[[2 + quality.zlib.crc32(g.encode()) % (s.buckets - 2) for g in ("bad", "badx", "xbad")]] = -9
    scorer = quality.Scorer(model, s)
    assert scorer("y" * 5000 + "xbadx") < scorer("y" * 5000 + "xgoodx") and not any(len(w) > quality.LONG for w in scorer.cache)


def test_html_self_closing_pictures():
    page = "<article><p>One<svg class='a'/> two.</p><math />%s<p>Three.</p></article>"
    assert html.main_text(page % "") == html.main_text(page % "<svg><title>no</title></svg>") == "One two. Three."


def test_html_article_in_chrome_names():
    text = "The boats came in late and the whole town stood at the harbour wall to see them."
    for page in (f"<div class='content-sidebar-wrap'><article><h1>A</h1><p>{text}</p></article></div>", f"<article class='post comments-open'><h1>A</h1><p>{text}</p></article>", f"<div id=search-page><main><h1>A</h1><p>{text}</p></main></div>"):
        assert html.main_text(f"<body><nav><a>Home</a></nav>{page}<div class=comments><article class=comment><p>{text}</p></article></div><aside><article><p>{text}</p></article></aside></body>") == f"A {text}"


def test_secrets_in_unbroken_text():
    """Each secret of a text without white space has its span, wherever it stands."""
    rng = np.random.default_rng(4)
    pick = lambda n: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    tagger = secrets.Tagger(secrets.fit(secrets.windows(["some plain words of a text about nothing much at all " * 12] * 60)))
    keys = ["ghp_" + pick(36), "sk_live_" + pick(24), ".".join(["eyJ" + pick(20), pick(40), pick(30)])]
    fill = ",".join(f'"name{k}":"value"' for k in range(60))
    for text in ("{" + fill + "," + ",".join(f'"k{k}":"{v}"' for k, v in enumerate(keys)) + "}", "see a=" + "&b=".join(keys) + " there", "x" + "".join(f";{v}" for v in keys)):
        redacted = secrets.redacted(text, tagger.all_spans(text)[1])
        assert not any(k in redacted or k[8:] in redacted for k in keys), redacted
        assert len(tagger.spans(text)) >= 3


def test_ogg_of_others_and_damaged(spark):
    """Foreign codecs and damaged first pages are problems, not failures."""
    good = ogg.store(b"a" * 5000)
    damaged = bytearray(good)
    damaged[30] ^= 1
    foreign = ogg.mux({7: [(b"\x01vorbis and more", 0), (b"x" * 300, 64)]})
    files = [good, bytes(damaged), foreign, b"", None, b"OggS", good[:40], b"no ogg at all", good[:-10]]
    given = spark.createDataFrame([(k, f and bytearray(f)) for k, f in enumerate(files)], "doc_id long, ogg binary")
    got = {r["doc_id"]: r for r in ogg.ogg_features(given).collect()}
    assert got[0]["problems"] == [] and got[0]["payload_bytes"] == 5000
    assert all(got[k]["problems"] for k in (1, 2, 5, 6, 7, 8)) and all(got[k]["payload_bytes"] == 0 for k in (2, 3, 4, 5, 6, 7))
    assert ogg.ogg_features(given.limit(0)).count() == 0


def test_ogg_times_and_features():
    """Granule positions give each stream's time; the feature line counts what is stored."""
    payload = bytes(range(64)) * 300
    back, streams, wrong = ogg.load(ogg.store(payload, rate=1000, streams=2, block=4000))
    assert back == payload and wrong == []
    parts = [payload[k : k + 4000] for k in range(0, len(payload), 4000)]
    for serial, own in ((1, parts[0::2]), (2, parts[1::2])):
        assert streams[serial].last == sum(map(len, own)) and [len(p) for p in streams[serial].packets[1:]] == [len(p) for p in own]
        ends = [t for t in streams[serial].times if t is not None]
        assert ends == sorted(ends) and ends[-1] == streams[serial].last / 1000
    feature = ogg.read_features(ogg.store(payload))[5]
    assert f"packets={len(parts) + 2};" in feature and f"zeros={payload.count(0)};spaces={payload.count(32)};" in feature


def test_copies_with_any_column_names(spark):
    rows = [(1, "a", 5, 6, "x"), (1, "b", 5, 6, "x"), (2, "c", 5, 6, None), (None, "d", 5, 6, "x"), (3, "e", 5, 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copies int, copies int, `a.b` string")
    mixed = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, copies int")
    assert sorted(map(repr, map(tuple, mixing.apply_copies(docs, mixed).collect()))) == sorted(map(repr, rows[:2] * 2 + rows[3:]))


def test_mixing_rates_against_plain_least_squares(spark):
    """The rates are those of an undistributed projected-gradient fit, and meet the targets."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(1, 400, 300)
    held = spark.createDataFrame([(k, int(t), [float(v) for v in q]) for k, (t, q) in enumerate(zip(n, p))], "id long, n_tokens long, p array<double>")
    targets = {"a": 0.6 * n.sum(), "b": 0.3 * n.sum(), "c": 0.1 * n.sum()}
    s = mixing.Settings(rounds=200)
    gradients = mixing.fit_rates(held, targets, s)
    got = np.array([r[0] for r in held.orderBy("id").select(mixing.rate_of(gradients, None)).collect()])
    goal, mass = np.array(list(targets.values())), n @ p
    moment = (p * n[:, None]).T @ p
    eta = 1 / max((moment / np.sqrt(np.outer(mass, mass))).sum(1))
    rate = np.ones(300)
    for _ in gradients:
        rate = np.maximum(0, rate - eta * p @ (((rate * n) @ p - goal) / mass))
    assert np.allclose(got, rate, atol=1e-9) and (got >= 0).all()
    assert np.allclose((got * n) @ p, goal, rtol=2e-3)


def test_html_tree_asks_for_neighbours_and_needs_no_names(monkeypatch):
    """On pages never seen the tree agrees with how they were made; where pages are marked up by tags, names change nothing."""
    tree = html.default_tree()
    asked = set()

    def walk(t):
        if not isinstance(t, bool):
            asked.add(html.NAMES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert {"words", "in_main"} <= asked and asked & {"words_before", "words_after", "density_before", "density_after"}
    rng = np.random.default_rng(4711)
    right = {0: [], 1: [], 2: []}
    texts = []
    for k in range(150):
        page, told = html.invented_page(rng, k % 3)
        found = html.blocks(page)
        right[k % 3] += [html.decide(tree, r) == label for r, (_, label) in zip(html.table(found).tolist(), told)]
        if k % 3 == 0:
            texts.append((page, " ".join(t for t, label in told if label)))
    assert np.mean(right[0]) > 0.99 and np.mean(right[1]) > 0.97 and np.mean(right[2]) > 0.92
    monkeypatch.setattr(html, "CHROME_WORDS", frozenset())
    tagged = [(p, t) for p, t in texts if "<article>" in p or "<main>" in p]
    assert len(tagged) > 30 and sum(html.main_text(p) == t for p, t in tagged) >= 0.97 * len(tagged)


def test_html_articles_keep_blocks_with_like_names():
    text = "The boats came in late and the whole town stood at the harbour wall to see them."
    page = f"<body><article><h1>A</h1><p>{text}</p><div class='notice-period'>{text}</div><section class='related-work'><p>{text}</p></section></article><div class='cookie-banner'><p>{text}</p></div></body>"
    assert html.main_text(page) == f"A {text} {text} {text}"


def test_html_rows(spark):
    """Empty tables, nulls, other columns and a very long page."""
    long = "<article>" + "".join(f"<p>word{k} and some more words to fill the line up here</p>" for k in range(20_000)) + "</article>"
    rows = [(1, None, None, "x"), (None, "u", long, None), (1, "u", "", "x")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(given).collect()
    assert len(got) == 3 and max(r["n_chars"] for r in got) > 900_000 and sum(r["text"] == "" for r in got) == 2
    assert html.extract(given.limit(0)).count() == 0


def test_redaction_and_keeping_carry_values(spark):
    """All columns with their values, clashing names included; texts without secrets as they were."""
    rows = [(1, "a b c", "en", "s", 5, None), (2, 'x password = "hunter2hunter2" y', None, "s", 31, 7), (None, None, "en", None, None, 1), (1, "", "de", "t", 0, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long, spans long")
    w = secrets.Weights()
    w.own[0] = [9, 0, 0]
    got = [tuple(r) for r in secrets.redact(docs, w).collect()]
    assert got[0] == rows[0] and got[2:] == rows[2:] and got[1][1] == 'x [SECRET]" y' and got[1][4] == len(got[1][1]) and got[1][5] == 7
    kept = [tuple(r) for r in quality.keep_good(docs, np.zeros(quality.Settings().buckets, np.float32)).collect()]
    assert kept == rows
    assert secrets.scan(docs.limit(0), w).count() == 0 and quality.keep_good(docs.limit(0), np.zeros(quality.Settings().buckets, np.float32)).count() == 0
