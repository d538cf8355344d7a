import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gradus.llm import caps, fingerprints, forest, mixing, toxicity, unigram, urls
from gradus.llm._words import HashIndex, prefix_hash, span_hash, words

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "te", "sar", "on") for b in ("da", "ri", "no", "ve", "lus", "m")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


# --- shared pieces


def test_words_are_runs_without_ascii_white_space():
    texts = ["", " a  bc\td\n", "é ü", "x", "   ", "last one"]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    start, end, first = words(buf, offsets)
    got = [[bytes(buf[a:b]).decode() for a, b in zip(start[p:q], end[p:q])] for p, q in zip(first, first[1:])]
    assert got == [t.split() for t in texts]
    h = span_hash(prefix_hash(buf), np.array([1, 21]), np.array([1, 21]))
    assert h[0] == h[1]


def test_hash_index_grows():
    rng = np.random.default_rng(0)
    index, keys = HashIndex(4), rng.integers(1, 2**63, 5000).astype(np.uint64)
    for part in np.split(keys, 10):
        index.insert(part)
    assert list(index.lookup(keys)) == list(range(5000)) and (index.lookup(keys + np.uint64(1)) == -1).all()


# --- fingerprints


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_with_edits(spark):
    rng = random.Random(3)
    rows = [(3 * k, prose(rng, rng.choice([0, 1, 3, 6, 80, 400]))) for k in range(70)] + [(None, "no id é"), (9, "twice the same id"), (500, None), (501, " \n "), (502, "😀é" * 301)]
    rows.append((600, rows[5][1]))
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, bucket int, fingerprint string")
    got = sorted(fingerprints.fingerprint_with_edits(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    errors = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = next(r for r in by_id[d] if r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == edited:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.02
    assert len({r.fingerprint for r in got if r.doc_id in (15, 600)}) == 1
    assert fingerprints.fingerprint_with_edits(df.limit(0)).count() == 0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df).collect()}
    assert plain[600] == by_id[600][0].fingerprint and plain[501] == ""


# --- url filter


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")


def test_rules(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "https://example.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://sub.EXAMPLE.net/en/": ("sub.example.net", "/en/", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "x://example.com/de/://z": ("example.com", "/de/://z", "example.com/de/", "block"),
        "http://o.org/fr/#x": ("o.org", "/fr/", "org/fr/", "allow"),
        "http://É.net?/": ("É.net", "", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://n\nx.net/a\nb": ("n\nx.net", "/a\nb", "net/", "block"),
    }
    rows = [(k, u, None) for k, u in enumerate(cases)] + [(99, None, "<link rel=canonical href='http://a.net/x'>"), (None, "http://a.net/x", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages(spark, rows)).collect()}
    assert got == {k: v for k, v in enumerate(cases.values())} | {99: ("", "", None, "allow"), None: ("a.net", "/x", "net/", "block")}
    assert urls.judge_urls(pages(spark, rows).limit(0)).count() == 0


def test_aliases_take_over_blocks_but_not_against_allow_rules(spark):
    rows = [
        (1, "http://bad.net/a", "<html>"), (2, "http://ok.com/b", '<LINK href="http://bad.net/a" REL="canonical">'),
        (3, "http://ok.com/c/d", "<meta http-equiv='Refresh' content='0; url=/b'>"), (4, "http://ok.com/c/e", "<meta http-equiv=refresh content='5;d'>"),
        (5, "http://x.org/fr/z", "<link rel='canonical' href='//ok.com/b'>"), (6, "http://far.com/", "<a href='http://bad.net/a'>"), (7, "http://ok.com/b", None), (8, "http://y.com/", "<link rel=canonical href=http://gone.net/q>"),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block"}


# --- mixing


def test_mix(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randint(0, 60)), rng.choice(["b", "a", None, "é", "Z", "b", "b", "b"])) for k in range(900)] + [(5, None, "a"), (None, "x y", "b"), (5, "same", "a"), (5, "same", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    sizes, taken, target = {}, {}, {}
    for r, key in ((r, (r.source_size, r.target)) for r in got):
        sizes[key] = sizes.get(key, 0) + r.size
        taken[key] = taken.get(key, 0) + r.taken
        assert r.taken <= 3 * r.size
        target[key] = r.target
    assert len(got) == len(rows) and all(k[0] == s for k, s in sizes.items())
    total = sum(sizes.values())
    assert abs(sum(target.values()) - total) < 1e-6 and all(t <= 3 * k[0] + 1e-9 for k, t in target.items())
    for k, t in target.items():
        assert abs(taken[k] - t) <= max(20, 0.02 * t)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns and sum(mixing_size(r.text) for r in copies.collect()) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def mixing_size(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_water_level(spark):
    rows = [(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate([(1, "a"), (100, "b"), (100, "c")])]
    got = {r.source_size: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.source_size == 1}
    assert got == {1: 3.0}  # weight 5 of 8 would be far above the cap


# --- token counts


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = unigram.vocabulary(P.path("piece_bpe_32k.model"))
    vocab = [("<unk>", min(s for _, s in pieces)), *pieces]
    tok = Tokenizer(models.Unigram(vocab, unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)  # the whole text is searched
    rng = random.Random(1)
    texts = ["", " ", "  ", "hello world", " lead", "trail  ", "a\nb\tc", "▁mark▁", "日本語テスト ⊕⊗⊘ ꙮꙮ x", "x" * 300, "Ünïcödé straße", None, "a        b", f"run{' ' * 17}on   and{' ' * 40}"] + [prose(rng, 50) for _ in range(20)]
    texts += ["".join(rng.choice("abcé ▁ꙮ") for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(df, P.path("piece_bpe_32k.model")).collect()}
    assert got == {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert unigram.token_counts(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_ties_go_to_the_piece_that_starts_first():
    c = unigram.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert c.pieces("▁ab") == 2  # ▁ + ab and ▁a + b score alike; so does ▁ + a + b
    assert c.pieces("▁zz") == 2  # unknown characters in a row are one piece
    assert unigram.Counter([]).pieces("abc") == 1


def test_units_are_cut_only_where_no_piece_crosses():
    apart = unigram.Counter([("▁", -3.0), ("▁▁▁", -1.0), ("a", -2.0), ("▁a", -1.5)])
    assert apart.units("▁a▁▁▁a▁") == ["▁a", "▁▁▁a", "▁"] and apart.count("a   a ") == 4
    whole = unigram.Counter([("▁", -3.0), ("a▁a", -1.0), ("a", -2.0)])
    assert whole.units("▁a▁\na") == ["▁a▁\na"] and whole.count("a a") == 2
    assert unigram.Counter([("a", -1.0)]).count("a  a") == 4  # the marks are unknown, in a row one piece
    same = [("▁", -3.0), ("a", -2.0)]
    assert unigram.Counter(same).count("a" * 30000 + " a") == 30003 and len(unigram.Counter(same)) == 0


# --- toxicity


def test_links_are_resolved_as_the_standard_library_does(spark):
    from urllib.parse import urljoin

    bases = ["http://a.org/b/c/d", "http://a.org/b/c/", "http://a.org", "http://A.org/x?y=1#z"]
    links = ["../e", "./f", "../../g", "../../../../h", ".", "..", "./", "../", "/i/../j/./k", "l?m=../n#o/../p", "//c.net/q/../r", "https://d.org/s/./t", "?u=http://v", "w://x/../y", "...", "e..", "/z"]
    # urljoin leaves the segments of links with a host of their own; RFC 3986 (5.2.2) resolves them too
    own_host = {"//c.net/q/../r": "http://c.net/r", "https://d.org/s/./t": "https://d.org/s/t", "w://x/../y": "w://x/y"}
    rows = [(b, k) for b in bases for k in links]
    got = spark.createDataFrame(rows, "url string, link string").select("url", "link", urls.absolute(F.col("link"), F.col("url")).alias("full")).collect()
    for r in got:
        want = own_host.get(r.link, urljoin(r.url, r.link))
        bare = lambda u: u.removesuffix("/") if u.count("/") == 3 else u
        assert bare(r.full) == bare(want), r


def test_all_links_of_a_page_count(spark):
    html = "<link rel=canonical href=/a><meta http-equiv=refresh content='0;url=b'><link rel='canonical' href='../c'><link rel=other href=/d><CANONICAL>"
    edges = urls.link_edges(pages(spark, [(1, "http://x.com/p/q", html), (2, None, html), (3, "http://x.com/p/q", None)])).collect()
    assert {(r.a, r.b) for r in edges} == {("x.com/p/q", f"x.com/{t}") for t in ("a", "p/b", "c")}


@pytest.mark.parametrize("seed", range(4))
def test_thresholds_by_trying_every_cut(seed):
    rng = np.random.default_rng(seed)
    n_steps = round(2 * toxicity.MOST_LOGIT / toxicity.STEP)
    counts = np.zeros((len(toxicity.LANGUAGES), 2, n_steps), np.int64)
    for k, n in enumerate((400, 60, 12, 3, 0)):
        for label in (0, 1):
            steps = (rng.normal(3 * label - 1 + k, 1.5, n) + toxicity.MOST_LOGIT) // toxicity.STEP
            np.add.at(counts[k, label], steps.astype(int), 1)
    errors = lambda c, cut: c[1, :cut].sum() + c[0, cut:].sum()
    cuts = toxicity.thresholds(counts)
    every = toxicity.threshold(counts.sum(0))
    for k in range(len(cuts)):
        own = counts[k] if (counts[k].sum(1) >= toxicity.LEAST_LABELS).all() else counts.sum(0)
        at = int(np.floor((cuts[k] + toxicity.MOST_LOGIT) / toxicity.STEP + 1e-6))
        held = np.flatnonzero(own.sum(0))
        assert errors(own, at) == min(errors(own, c) for c in (*held, held[-1] + 1))
    assert cuts[3] == cuts[4] == every
    assert toxicity.thresholds(counts[:, :, :] * np.array([1, 0])[None, :, None]).tolist() == [0.0] * len(cuts)  # no toxic rows
    assert toxicity.thresholds(counts * 0).tolist() == [0.0] * len(cuts)


def test_thresholds_see_every_row_that_isnt_learned(spark):
    rows = [(k, f"word{k % 7} word{k % 11}", k % 3 == 0) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "a"), (9000, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows] + [(None, 1), (9001, 1), (7, None)], "doc_id long, toxic int")
    fits = {k for k in range(600) if zlib.crc32(str(k).encode()) % 5} - {7} | ({7} if zlib.crc32(b"7") % 5 else set())
    for most in (0, 50, 100000):
        ids, texts, known = toxicity.labelled_sample(docs, labels, most)
        assert set(ids) <= fits and len(ids) == len(texts) == len(known) <= most and (most < 1000 or 0 < len(ids) < len(fits))
        model = spark.sparkContext.broadcast(toxicity.train(texts, known))
        assert toxicity.calibration_counts(docs, labels, ids, model).sum() == len(fits) - len(ids)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["grobal", "vilnak", "zotter"]
    rows, labels = [], []
    for k in range(1500):
        w, toxic = prose(rng, rng.randint(5, 60)).split(), int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), 3.0))
        labels.append((k, 0, toxic))
    rows += [(5000, "", 0.0), (5001, None, 0.0), (None, "no id", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (3, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[d].predicted, t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    clean = toxicity.clean_documents(docs, known)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in got.values())
    untrained = toxicity.score(docs, known.limit(0)).collect()
    assert len(untrained) == len(rows)
    assert toxicity.score(docs.limit(0), known).count() == 0


# --- near copies


def brute_links(rows):
    sets = [shingle_set(t or "") for _, t in rows]
    links = [[] for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i < j and ((a or "") == (b or "") or (sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                links[i].append(j)
                links[j].append(i)
    return links


def reach(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return seen


def near_rows():
    rng = random.Random(12)
    rows = []
    for k in range(40):
        base = prose(rng, rng.choice([4, 7, 30, 120])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((rng.randint(0, 10**6), " ".join(w)))
    rows += [(11, None), (12, ""), (13, "  "), (None, rows[3][1]), (rows[0][0], rows[0][1]), (14, "é ü")]
    return rows


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_documents_against_brute_force(spark, chunk):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, h int, kept string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_links, r.class_id, r.kept) for r in forest.near_documents(df, chunk=chunk).collect())
    links, want = brute_links(rows), []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in reach(links, i) if rows[j][0] is not None]
        low = min(ids) if ids else None
        want.append((d if d is not None else -1, len(links[i]), low, d is not None and d == low))
    assert got == sorted(want)


def test_one_of_each_keeps_one_row_a_class(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class int")
    out = forest.one_of_each(df)
    links = brute_links(rows)
    assert out.columns == df.columns and out.count() == len({min(reach(links, i)) for i in range(len(rows))})
    assert forest.one_of_each(df.limit(0)).count() == 0


def test_prefixes_shorten_until_the_recall(spark):
    n = np.array([1, 2, 4, 10, 40, 500])
    k = forest.prefix_length(n, 0.8, 0.9999)
    assert list(k) == sorted(k) and k[0] == 1 and 1 - (1 - 0.8 ** k[-1]) ** forest.TREES >= 0.9999


# --- near vectors


def brute_vectors(rows, cut):
    def vec(e):
        if not e or any(x is None or not np.isfinite(x) for x in e) or not np.any(e):
            return None
        return np.array(e, float)

    v = [vec(e) if label is not None else None for _, e, label in rows]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= cut:
                    links[i].append(j)
                    links[j].append(i)
    return links


@pytest.mark.parametrize("chunk", [2048, 5])
def test_near_vectors_against_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((30, 16))
    for k in range(260):
        e = base[k % 30] + rng.standard_normal(16) * (0.02 if k % 3 else 1.0)
        rows.append((int(k * 7 % 1000), [float(np.float32(x)) for x in e], int(k % 2)))
    rows += [(2001, rows[0][1], 0), (2002, [2 * x for x in rows[0][1]], 0), (2003, None, 0), (2004, [0.0] * 16, 0), (2005, [float("nan")] * 16, 0), (2006, [None] * 16, 0), (2007, rows[0][1], None), (2008, [1.0, 0.5], 0), (2009, [1.0, 0.5], 0), (2010, [], 1), (2011, [1e30] * 16, 1), (2012, [1e-30] * 16, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_vectors(df, chunk=chunk).collect()}
    links = brute_vectors(rows, 0.98)
    want = {}
    for i, (d, _, _) in enumerate(rows):
        low = min(rows[j][0] for j in reach(links, i))
        want[d] = (len(links[i]), low, d == low)
    assert got == want
    assert caps.near_vectors(df.limit(0)).count() == 0


def all_scores(code, v):
    a, b = code.scores(v)
    return (a[:, :, None] + b[:, None, :]).reshape(len(v), -1)


def test_code_lists_the_best_directions():
    code = caps.ProductCode(10, 256)
    v = np.random.default_rng(0).standard_normal((20, 10))
    assert (code.best(v, 12) == np.sort(np.argsort(-all_scores(code, v), axis=1)[:, :12], axis=1)).all()


@pytest.mark.parametrize("height", [-0.3, 0.4, 0.9, 1.3])
def test_caps_hold_all_vectors_above_their_height(height):
    code = caps.ProductCode(10, 1024)
    v = np.random.default_rng(0).standard_normal((30, 10))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = np.nonzero(all_scores(code, v) >= height)
    got = code.above(v, height)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


@pytest.mark.parametrize("dim", [1, 2, 3, 64])
def test_near_vectors_recall_at_the_cut(spark, dim):
    """Pairs just above the cut among 10,000 vectors, against all products."""
    rng, n = np.random.default_rng(dim), 10_000 if dim == 64 else 400
    x = rng.standard_normal((n // 4, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    if dim > 1:
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    at = rng.uniform(0.98, 0.982, (n // 4, 1))
    v = np.concatenate([x, at * x + np.sqrt(1 - at * at) * y, rng.standard_normal((n // 2, dim))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    want = near.sum(1) - 1
    df = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = np.zeros(n, int)
    for r in caps.near_vectors(df).select("vec_id", "n_links").collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 0


def test_query_strings_are_pages_of_their_own(spark):
    link = "<link rel='canonical' href='{}'>"
    rows = [
        (1, "http://shop.org/item?id=1", link.format("http://bad.net/x")),
        (2, "http://shop.org/item?id=2", "no link"),
        (3, "http://shop.org/item?id=1#top", None),
        (4, "http://shop.org/list", link.format("?id=9")),
        (5, "http://shop.org/list?id=9", link.format("//bad.net/y")),
        (6, "http://shop.org/item", ""),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_links_as_pages_spell_them(spark):
    canonical = "<link rel=canonical href='{}'>".format
    rows = [
        (1, "http://shop.org", canonical("http://bad.net/x")),
        (2, "http://shop.org/", ""),  # the same page
        (3, "http://a.org/p?a=1&b=2", ""),
        (4, "http://b.org/", canonical("http://a.org/p?a=1&amp;b=2") + canonical("http://bad.net/y")),
        (5, "http://c.org/", "<!-- " + canonical("http://bad.net/z") + " -->"),
        (6, "http://d.org/", "<script>" + canonical("http://bad.net/z") + "</script>"),
        (7, "http://e.org/q/", "<base href='//bad.net/k/'>" + canonical("v")),
        (8, "http://f.org/", canonical("http&#58;//bad&#x2E;net/&#233;")),
        (9, "http://g.org/" + "a/" * 300, canonical("./../http/")),
        (10, "http://h.org/", "<!-- " + canonical("http://bad.net/never-closed")),
        (11, "http://i.org/&amp;lt;", ""),
        (12, "http://j.org/", canonical("http://i.org/&amp;amp;lt;") + canonical("http://bad.net/")),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" if i in (1, 2, 3, 4, 7, 8, 11, 12) else "allow" for i in range(1, 13)}


def test_character_references_as_the_standard_library_reads_them(spark):
    import html

    links = ["a&amp;b", "&amp;amp;", "&#38;lt;", "&#x1F600;/&#233;", "&&lt;&gt;", "x&y", "", "&quot;&apos;", "&#9;&#0065;"]
    df = spark.createDataFrame([(x,) for x in links], "link string").select("link", urls.without_entities(F.col("link")).alias("got"))
    assert {r.link: r.got for r in df.collect()} == {x: html.unescape(x) for x in links}


def test_boolean_labels(spark):
    texts = spark.createDataFrame([(i, "vile slur" if i % 2 else "kind word") for i in range(60)], "doc_id long, text string")
    number = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    same = number.selectExpr("doc_id", "toxic = 1 as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.score(texts, labels).collect()} for labels in (number, same))
    assert a == b and len(a) == 60
