"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import re
import time
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import html_text, language_id, lm_scoring, packing, quality, signature_tree
from lumenspan.llm.exact_dedup import exact_dedup
from lumenspan.llm.fingerprints import add, edge_at, fingerprint_with_next, lane_sums, range_of, subtract
from lumenspan.llm.line_dedup import drop_repeated_lines
from lumenspan.llm.mixing import capped_shares, min_cost_flow, mix_sources
from lumenspan.llm.ngram_join import ngram_components
from lumenspan.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, size int, key string, score double, n int"
WORDS = [f"w{k}" for k in range(400)]


def passage(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))


def rows_of(spark, texts, ids=None):
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", None, "x", "y", 1, "k", None, 0) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


BASE = passage(1, 120)
EDIT = BASE.split()
EDIT[60] = "other"
TEXTS = [BASE, BASE, " ".join(EDIT), BASE.upper(), None, "", "   ", "one two", "One TWO", "one two three", passage(2, 5000), passage(2, 5000) + " end", passage(3, 30), "x" * 70_000, "x" * 70_000 + "y", "é ß words in other signs 中文"]
IDS = [5, 9, 7, 3, 1, 2, 4, 11, 12, None, 13, 14, 15, 16, 17, 18]


@pytest.fixture(scope="module")
def docs(spark):
    return rows_of(spark, [*TEXTS, TEXTS[0]], [*IDS, 5]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return rows_of(spark, [])


def test_exact_dedup(docs, empty):
    found = exact_dedup(docs, first_block=4, growth=2).collect()
    assert len(found) == len(TEXTS) + 1 and exact_dedup(empty).count() == 0
    groups = defaultdict(list)
    for i, t in zip([*IDS, 5], [*TEXTS, TEXTS[0]], strict=True):
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in found:
        own = groups[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == max(own, key=lambda x: -1 if x is None else x)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert kept == dict.fromkeys(groups, 1)


def test_exact_dedup_deals_hot_groups(spark):
    texts = [BASE] * 300 + [f"{BASE} {k}" for k in range(40)] + ["x"] * 90 + [None, ""]
    found = exact_dedup(rows_of(spark, texts).repartition(3), first_block=8).collect()
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t or ""].append(k)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == {k: (max(own), len(own), k == max(own)) for own in groups.values() for k in own}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(texts, ids):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = root[a], root[b]
            root = [new if x == old else x for x in root]
    low = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    return Counter((ids[k], len(sets[k]), low[root[k]]) for k in range(len(ids)))


@pytest.mark.parametrize("task", [2_000_000, 400])
def test_ngram_join(docs, empty, task):
    found = ngram_components(docs, task_shingles=task)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == components([*TEXTS, TEXTS[0]], [*IDS, 5])
    assert ngram_components(empty).count() == 0


def test_ngram_join_of_chains_and_frequent_passages(spark, monkeypatch):
    """Near copies in a chain, a passage that all have, sizes near the threshold; tokens of many sets are parted."""
    from lumenspan.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LOCAL", 2)
    rng, texts = np.random.default_rng(0), []
    for k in range(6):
        words = passage(50 + k, 60).split()
        for _ in range(12):
            words = list(words)
            words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 10_000)}"
            texts.append(" ".join(words) + " " + passage(99, 12))
    docs = rows_of(spark, texts).repartition(3)
    found = ngram_components(docs, task_shingles=64).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(texts, list(range(len(texts))))


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        core = rng.integers(0, 1 << 63, 60, np.uint64)
        sets += [np.unique(np.concatenate((core[rng.random(60) < 0.93], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), np.uint64)))) for _ in range(4)]
    label, brute = signature_tree.link(sets, 75), np.arange(len(sets))
    for a, b in combinations(range(len(sets)), 2):
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
            brute[brute == brute[b]] = brute[a]
    assert len(set(zip(label.tolist(), brute.tolist(), strict=True))) == len(set(label.tolist())) == len(set(brute.tolist()))
    maps = [signature_tree.bitmap(s, signature_tree.width_for(len(s))) for s in sets]
    may = signature_tree.may_link(maps, np.array(list(map(len, sets))), 75)
    assert all(len({may[k] for k in np.flatnonzero(label == x)}) == 1 for x in set(label.tolist()))


def test_language_id(spark, docs, empty):
    rng, texts, langs = np.random.default_rng(2), [], []
    for k in range(120):
        texts.append("".join("abcdefgh "[i] if k % 2 else "stuvwxyz "[i] for i in rng.integers(0, 9, int(rng.integers(5, 600)))))
        langs.append("aa" if k % 2 else "zz")
    table = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    model = language_id.fit_language(table, docs_per_label=40)
    found = {r["doc_id"]: r for r in language_id.identify_language(table, model).collect()}
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([found[k]["lang_pred"] == langs[k] for k in held]) > 0.95
    odd = language_id.identify_language(docs, model).collect()
    assert len(odd) == len(TEXTS) + 1 and {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 4)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    nothing = language_id.fit_language(empty)
    assert {r["lang_pred"] for r in language_id.identify_language(docs, nothing).collect()} == {"und"} and language_id.identify_language(empty, model).count() == 0


def test_language_sample_is_that_of_the_least_hashes(spark, monkeypatch):
    """What is learned from is the docs_per_label texts of least rank of each label, as brute force finds them."""
    seen = []
    monkeypatch.setattr(language_id, "train", lambda segments, target, labels: seen.append((segments, target, labels)))
    texts = [f"{'uvw'[k % 3]} text number {k}" for k in range(900)]
    table = rows_of(spark, texts).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 3).cast("string"))).repartition(5)
    language_id.fit_language(table, docs_per_label=20)
    ranked = table.select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("rank"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).alias("fold")).filter("fold <> 1").collect()
    want = {r["text"] for label in ("l0", "l1", "l2") for r in sorted((r for r in ranked if r["lang"] == label), key=lambda r: r["rank"])[:20]}
    segments, _, labels = seen[0]
    assert labels == ["l0", "l1", "l2"] and {bytes(x).rstrip(b"\0").decode() for x in segments} == want


def test_backpropagation_through_time():
    """The gradient of one step against differences of the loss: Adam's first step has the gradient's signs."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 9, (3, 6)).astype(np.uint8), np.array([0, 1, 1])
    model = language_id.train(x, y, ["a", "b"], epochs=0)
    stepped = language_id.train(x, y, ["a", "b"], epochs=1)

    def loss():
        p = model.probabilities(x)
        return float(-np.log(p[np.arange(3)[:, None], np.arange(6), y[:, None]].astype(np.float64)).mean())

    checked = 0
    for name, w in model.params.items():
        flat, after = w.reshape(-1), stepped.params[name].reshape(-1)
        for k in rng.integers(0, flat.size, 12):
            old = flat[k]
            flat[k] = old + 2e-2
            up = loss()
            flat[k] = old - 2e-2
            down = loss()
            flat[k] = old
            if abs(up - down) > 1e-4:
                checked += 1
                assert np.sign(after[k] - old) == -np.sign(up - down), name
    assert checked > 10


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and this text about them is long enough to look like prose.</div>
<article><h1>Title &amp; more</h1><p>First <b>paragraph</b> with
 some&nbsp;words.<p>Second<br>one.</p><form><p>Your name</p></form></article><aside>Other</aside><section class="comments"><p>A comment of a reader that goes on and on for a while.</p></section><footer>&copy; me</footer></body>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with some words.\nSecond one."
    plain = "<body><div id=menu><a href=a>A</a></div><div><h2>Head line of a page</h2><p>Prose that is long enough to surge by itself, and then some more of it here.</p><p>End.</p></div><div>Contact us</div>"
    assert html_text.main_text(plain) == "Head line of a page\nProse that is long enough to surge by itself, and then some more of it here.\nEnd."
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p", "x"), (4, PAGE * 30, "x"), (5, "<<<>>>&bogus;</p></div>", "x")], "page_id long, html string, main_text string")
    found = {r["page_id"]: r["main_text"] for r in html_text.extract_text(pages).collect()}
    assert found[1] == found[2] == found[3] == "" and found[4].count("Second one.") == 30 and len(found) == 5
    assert html_text.extract_text(pages.filter("page_id > 9")).count() == 0


def test_html_keeps_what_names_and_links_hide():
    prose = "<p>Prose that is long enough to surge by itself, and then some more of it here.</p>"
    text = "Prose that is long enough to surge by itself, and then some more of it here."
    for inner in ('<section id="related-work">{}</section>', '<div class="legal-basis">{}</div>', '<h2 id="search-results">Found</h2>{}'):
        assert text in html_text.main_text(f"<article>{inner.format(prose)}</article>")
    assert "Found" in html_text.main_text(f'<article><h2 id="search-results">Found</h2>{prose}</article>')
    for around in ('<div class="content has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="with-menu">'):
        assert html_text.main_text(f"<body>{around}{prose}</div>") == text
    for name in ("sidebar", "site-footer", "related-posts", "share-buttons", "cookie-notice", "searchBox", "post-comments"):
        assert html_text.main_text(f'<body>{prose}<div class="{name}">{prose.replace("Prose", "Other")}</div>') == text
    linked = '<p><a href="/x">All of this paragraph is one link to elsewhere.</a></p>'
    assert html_text.main_text(f"<body><div>{prose}{linked}{prose}</div>") == f"{text}\nAll of this paragraph is one link to elsewhere.\n{text}"
    assert html_text.main_text("<body><div><p>Short text.</p></div>") == "Short text." and html_text.main_text("<body><a href=a>A</a>") == ""


def test_html_keeps_an_article_whatever_is_around_it():
    article = "<h1>Title</h1>" + "".join(f"<p>{'Some words of prose that go on. ' * 4}{k}</p>" for k in range(6))
    want = html_text.main_text(f"<body><article>{article}</article></body>")
    assert want.startswith("Title\nSome words") and want.count("\n") == 6
    comments = f"<div class='comments'><p>{'and a comment ' * 200}</p></div>"
    for around in ("<div class='page search'>{}</div>", "<form action='/'><nav>menu</nav>{}</form>", "<div id='related'><div class='notice'>{}</div></div>", "<form>{}" + comments + "</form>", "{}" + comments, "<div class='search'><p>find</p></div>{}"):
        for tag in ("article", "main", "div"):
            assert html_text.main_text(f"<body>{around.format(f'<{tag}>{article}</{tag}>')}</body>") == want


def test_html_tags_alone_make_no_text():
    prose = "".join(f"<p>{'Some words of prose that go on. ' * 4}{k}</p>" for k in range(6))
    gap = "".join(f"<div><a href='/{k}'>{k}</a></div>" for k in range(4))
    assert html_text.main_text(f"<body><div><p>a</p><p>b</p><p>c</p></div>{gap}<div>{prose}</div></body>").startswith("Some words")
    assert html_text.WINDOW * (html_text.PROSE + html_text.INSIDE) < html_text.SURGE


def test_html_attributes_and_references_are_read_exactly():
    prose = "Prose that is long enough to surge by itself, and then some more of it here, until the line ends."
    for start in ('<p data-class="menu">', '<p data-hidden-id="x">', '<p title="class=menu">', '<p class="share-price">', '<p id="copyright-law">'):
        assert html_text.main_text(f"<article>{start}{prose}</p></article>") == prose
    assert html_text.main_text(f"<p>{prose} &l<i>t;</i> &lt;b&gt;</p>") == f"{prose} &lt; <b>"
    # The sums decide: a short line in an element for the main text doesn't take all else away.
    page = f"<p>{prose}</p><p>{prose}</p><main><p>Ok.</p></main>"
    assert html_text.main_text(page) == f"{prose}\n{prose}\nOk."
    assert html_text.main_text(f"<div>Unmarked words before.</div><article><p>{prose}</p><p>End.</p></article><p>After all.</p>") == f"{prose}\nEnd."


def test_html_windows_against_brute_force():
    rng = np.random.default_rng(3)
    for n in range(40):
        weights = rng.integers(0, 99, n).tolist()
        padded = [0] * (html_text.WINDOW - 1) + weights + [0] * (html_text.WINDOW - 1)
        assert html_text.window_sums(weights) == [sum(padded[k : k + html_text.WINDOW]) for k in range(n + html_text.WINDOW - 1)]
    # No tag, no name: where paragraphs are long the text is, and short lines before and after are not.
    short, long = [f"<div>Item {k}</div>" for k in range(9)], [f"<div>{passage(k, 30)}</div>" for k in range(4)]
    found = html_text.main_text("".join(short + long + short))
    assert found == "\n".join(passage(k, 30) for k in range(4))


@pytest.mark.parametrize("page", ['<p class="x>some text </p>' * 40_000, "<a 'x <b \"y " * 80_000, "<b>" * 150_000 + "</i>" * 150_000, "<div>" * 100_000 + "</p>" * 100_000, "<![CDATA[ x" * 90_000, "<" * 500_000])
def test_html_takes_linear_time_on_broken_pages(page):
    def seconds(text):
        start = time.process_time()
        html_text.main_text(text)
        return time.process_time() - start

    assert seconds(page) < 10 * seconds(page[: len(page) // 4]) + 0.5


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    found = packing.pack_documents(docs, word_tokenizer(), capacity=256, group=12).collect()
    want = Counter()
    for i, t in zip([*IDS, 5], [*TEXTS, TEXTS[0]], strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack_documents(empty, word_tokenizer()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_every_constraint(rule):
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(1, 60, 500))[::-1]
    at, _ = packing.best_fit(n, 100, 4, 5_000, rule)
    for k in range(at.max() + 1):
        own = n[at == k]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 5_000
    at, _ = packing.best_fit(n, 100, 100, 10_000)
    assert at.max() + 1 <= 1.02 * np.ceil(n.sum() / 100)


def test_token_ids_of_odd_texts():
    words = packing.WordIds(word_tokenizer())
    for text in ("Don't I'LL 'sx ÀÉß ÿ a'b", "İstanbul ΣΑΣ σας ﬁ 中文 😀x", "<|endoftext|>abc x\x1fy \x0bq\x85z\xa0w", "á ́b 12.5€ ªº µm 3½", ""):
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_mixing(spark, docs, empty):
    texts = [passage(k, int(np.random.default_rng(k).integers(1, 40))) for k in range(400)]
    table = spark.createDataFrame([(k, t, ["a", "b", "c", None][min(k % 7, 3)]) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found = mix_sources(table, F.array("source")).toPandas()
    assert (found["size"] == [len(texts[i].split()) for i in found["doc_id"]]).all()
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] % found["size"].clip(lower=1) == 0).all()
    for _, own in found.groupby(found["members"].map(str)):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 0.01 * own["target"].iloc[0] + 3
        assert own["size"].sum() == own["source_size"].iloc[0]
    again = mix_sources(table.repartition(7), F.array("source")).toPandas()
    assert dict(zip(found["doc_id"], found["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))
    assert mix_sources(docs, F.array("source")).count() == len(TEXTS) + 1 and mix_sources(empty, F.array("source")).count() == 0


def test_mixing_passes_over_what_does_not_fit(spark):
    """One document above the quota among short ones, wherever its hash puts it: both quotas are met nearly to a short one."""
    for seed in range(3):
        rows = [(k, "w " * 50, "a") for k in range(300)] + [(1_000, "w " * 30_000, "a")] + [(2_000 + k, "w " * 50, "b") for k in range(600)]
        found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source"), weights=[1, 5], seed=seed).toPandas()
        assert len(found) == len(rows)
        for _, own in found.groupby(found["members"].map(str)):
            assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 50, (seed, own["taken"].sum(), own["target"].iloc[0])


def test_shares_and_flow():
    assert capped_shares([10, 10, 10], [1, 1, 1], 3) == [10, 10, 10]
    assert capped_shares([1, 100, 99], [1, 1, 2], 3) == [3, pytest.approx(197 / 3), pytest.approx(394 / 3)]
    # Two sources share a pattern: the cheapest flow uses words twice only where there is no other way.
    flow = min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [5, 25], 3)
    assert sum(f[0] if len(f) == 1 else f[1] for f in flow[1:]) == 25 and sum(flow[0]) == 5 and sum(flow[1]) <= 20
    assert sum(map(sum, min_cost_flow([4], [[0]], [100], 3))) == 12


def lm_model(texts, spark):
    table = lm_scoring.token_table(rows_of(spark, texts), word_tokenizer())
    return table, lm_scoring.train(table, 49152)


def test_lm_scoring(spark, docs, empty):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"{'abcdefghi'[k]} {'rstuvwxyz'[k]}" for k in rng.integers(0, 9, 60)) for _ in range(150)]
    _, model = lm_model(texts, spark)
    tokens = packing.tokenizer(word_tokenizer())
    shuffled = " ".join(np.random.default_rng(1).permutation(texts[0].split()))
    good, bad = model.score([tokens.ids(texts[0]), tokens.ids(shuffled)])
    assert good > bad + 50
    odd = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, word_tokenizer()).collect()}
    assert odd[1]["n_tokens"] == 0 and odd[1]["mean_log_prob"] is None and odd[2]["log_prob"] == 0 and len(odd) == len(set(IDS))
    assert odd[9]["log_prob"] == pytest.approx(odd[5]["log_prob"], rel=1e-5) and odd[9]["log_prob"] / odd[9]["n_tokens"] == odd[9]["mean_log_prob"]
    assert lm_scoring.score_documents(empty, word_tokenizer()).count() == 0


def test_lm_against_brute_force(spark):
    """Every token's probability from both sides, summed by a plain loop; all tokens of the vocabulary together have 1."""
    _, model = lm_model([passage(k, 80) for k in range(30)], spark)
    docs = [packing.tokenizer(word_tokenizer()).ids(t) for t in (passage(3, 80), "w1", "", "unseen words 中", passage(50, 300))]
    p, found = {k: v.astype(float) for k, v in model.params.items()}, model.score(docs)
    for ids, score in zip(docs, found, strict=True):
        ranks, brute = [int(model.rank[t]) for t in ids], 0.0
        for k, t in enumerate(ranks):
            x = p["bias"].copy()
            for side, d in enumerate((-2, -1, 1, 2)):
                near = ranks[k + d] if 0 <= k + d < len(ranks) else None
                x += p["side"][side] * p["ins"][model.known + 1 if near is None else min(near, model.known)]
            h = x / np.sqrt(1 + x * x)
            e, f = p["cw"] @ h + p["cb"], p["ww"] @ h + p["wb"]
            first = np.exp(e) / np.exp(e).sum()
            every = []
            for c, (lo, hi) in enumerate(zip(model.edges[:-1], model.edges[1:], strict=True)):
                q = np.exp(f[lo:hi]) / np.exp(f[lo:hi]).sum() if hi <= model.known else np.full(hi - lo, 1 / (hi - lo))
                every.append(first[c] * q)
            every = np.concatenate(every)
            assert abs(every.sum() - 1) < 1e-9
            brute += np.log(every[t])
        assert score == pytest.approx(brute, rel=1e-4, abs=1e-4)


def test_lm_slopes_are_derivatives(spark):
    tokens = packing.tokenizer(word_tokenizer())
    docs = [tokens.ids(passage(k, 40)) for k in range(3)]
    counts = np.bincount(np.concatenate(docs), minlength=49152)
    learner = lm_scoring.Learner(lm_scoring.fresh(counts))
    learner.model.params = {k: v.astype(np.float64) for k, v in learner.model.params.items()}
    blocks = learner.model.blocks(docs)
    loss = lambda: -float(learner.model.log_probabilities(blocks).astype(float).sum())
    for name, at, slope in learner.slopes(blocks):
        param = learner.model.params[name]
        rows = np.arange(len(param))[at]
        k = int(np.argmax(np.abs(slope if slope.ndim == 1 else slope.sum(axis=1))))
        place = (rows[k],) if slope.ndim == 1 else (rows[k], int(np.argmax(np.abs(slope[k]))))
        own = slope[(k, *place[1:])]
        param[place] += 1e-2
        up = loss()
        param[place] -= 2e-2
        down = loss()
        param[place] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(own), rel=2e-2, abs=2e-2), name


def test_lm_learns_from_every_position_whatever_the_partitions(spark):
    texts = ["one", "two", "", None, passage(1, 300), *(passage(k, 4 * k) for k in range(1, 60))]
    found = []
    for n in (2, 6):
        table = lm_scoring.token_table(rows_of(spark, texts).repartition(n), word_tokenizer())
        model = lm_scoring.train(table, 49152, shard=700)
        assert model.learned == sum(len(packing.tokenizer(word_tokenizer()).ids(t or "")) for t in texts)
        found.append({r["doc_id"]: r["log_prob"] for r in lm_scoring.score_tokens(table, model).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-5)


def test_lm_averages_rows_by_how_often_they_were_met(spark):
    rng, width, rows = np.random.default_rng(0), lm_scoring.HIDDEN, []
    total, change = np.zeros(600), np.zeros((600, width))
    for part in range(70):
        at = np.sort(rng.choice(600, 300, replace=False))
        met, moved = rng.integers(1, 50, len(at)).astype(float), rng.normal(size=(len(at), width)).astype(np.float16)
        total[at] += met
        change[at] += met[:, None] * moved
        for s in range(3):
            own = at // lm_scoring.SLICE == s
            rows.append((s, part, 1, at[own].astype("<i4").tobytes(), met[own].tobytes(), moved[own].tobytes()))
    found = np.zeros((600, width))
    for r in lm_scoring._averaged(spark.createDataFrame(rows, lm_scoring._CHANGE), 70).collect():
        found[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["change"], np.float16).reshape(-1, width)
    assert np.abs(found - change / np.maximum(total, 1)[:, None]).max() < 5e-3


def test_fingerprints(docs, empty, spark):
    found = fingerprint_with_next(docs, rows_per_range=3).collect()
    ordered = sorted(zip([*IDS, 5], [*TEXTS, TEXTS[0]], strict=True), key=lambda x: (-(x[0] if x[0] is not None else -1), x[1] or ""))
    want = Counter()
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    prints = defaultdict(set)
    for r in found:
        prints[r["doc_id"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[5] == prints[9] != prints[7] and prints[1] == prints[2]
    assert fingerprint_with_next(empty).count() == 0
    alone = fingerprint_with_next(rows_of(spark, ["abc def"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abc deab").hexdigest()[:0] + hashlib.sha256(("abc def"[:5] + "ab").encode()).hexdigest()


def test_ranges_of_many_edges(spark):
    edges = list(range(5, 3_000, 7))
    rows = spark.range(3_100).select(F.col("id").alias("key")).withColumn("r", range_of(F.col("key"), edges)).withColumn("x", F.coalesce(edge_at(F.col("r"), edges) == F.col("key"), F.lit(False)))
    assert all(r["r"] == bisect_left(edges, r["key"]) and r["x"] == (r["key"] in edges) for r in rows.collect())


def test_fingerprints_are_homomorphic(spark):
    def lanes(*pieces):
        return spark.createDataFrame([(p,) for p in pieces], "p string").agg(*lane_sums(F.col("p"))).first()["lanes"]

    assert lanes("a", "b", "b") == lanes("b", "a", "b") != lanes("a", "b")
    a, b, both = lanes("a", "x"), lanes("b"), lanes("b", "x", "a")
    joined = spark.createDataFrame([(a, b, both)], "a array<long>, b array<long>, c array<long>").select(add(F.col("a"), F.col("b")).alias("sum"), subtract(F.col("c"), F.col("b")).alias("less")).first()
    assert joined["sum"] == both and joined["less"] == a


def test_fingerprint_vectors_are_added_modulo_powers(spark):
    most, half = (1 << 31) - 1, 31
    cases = [(most, 1), (0, 1), (most << half | most, most << half | most), (5 << half | 3, 7 << half | 9)]
    table = spark.createDataFrame([([a], [b]) for a, b in cases], "a array<long>, b array<long>")
    for (a, b), r in zip(cases, table.select(add(F.col("a"), F.col("b")).alias("s"), subtract(F.col("a"), F.col("b")).alias("d")).collect(), strict=True):
        for got, sign in ((r["s"][0], 1), (r["d"][0], -1)):
            assert got & most == ((a & most) + sign * (b & most)) & most and got >> half == ((a >> half) + sign * (b >> half)) & most


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    texts = [passage(k, int(rng.integers(20, 90))) if k % 2 else "!!! $$$ " * int(rng.integers(3, 30)) for k in range(300)]
    table, labels = rows_of(spark, texts), spark.createDataFrame([(k, k % 2) for k in range(300)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(table, labels)
    found = {r["doc_id"]: r for r in quality.score_quality(table, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([found[k]["predicted"] == k % 2 for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in quality.score_quality(docs, model).collect())
    assert quality.score_quality(empty, model).count() == 0
    assert quality.score_quality(docs, quality.fit_quality(empty, labels)).filter("score <> 0.5").count() == 0
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and len(x) == 3


def brute_lines(rows):
    """The same by hand, word by word: windows of three lines, of which all but the first go."""
    seen, out = set(), []
    for _, text in rows:
        tokens = [(m[1], m[2]) for m in re.finditer(r"(\S+)(\s*)", text or "", re.ASCII)]
        mark = [w[-1] in ".!?" or "\n" in space for w, space in tokens]
        hard = ["\n" in space or (w[-1] in ".!?" and not any(mark[max(0, k - 3) : k])) or k + 1 == len(tokens) for k, (w, space) in enumerate(tokens)]
        powers = lambda w: sum(b * pow(0x85EBCA6B, min(j, 63), 2**64) for j, b in enumerate(w.encode())) % 2**64
        order = [powers(w) * 0x27220A95FE4A7C15 % 2**64 >> 32 if k == 0 or w != tokens[k - 1][0] else None for k, (w, _) in enumerate(tokens)]
        ends = set()
        for k in range(len(tokens) - 11):
            own = [(x, -j) for j, x in enumerate(order[k : k + 12]) if x is not None]
            if not any(hard[k : k + 11]) and own:
                ends.add(k - min(own)[1])
        lines, line = [], []
        for k, token in enumerate(tokens):
            line.append(token)
            if hard[k] or k in ends or len(line) == 12:
                lines, line = [*lines, line], []
        gone = set()
        for at in range(max(len(lines) - 2, 1) if lines else 0):
            window = tuple(tuple(w for w, _ in x) for x in lines[at : at + 3])
            gone |= set(range(at, min(at + 3, len(lines)))) if window in seen else set()
            seen.add(window)
        head = re.match(r"\s*", text or "", re.ASCII)[0]
        out.append(("" if 0 in gone else head) + "".join(w + space for k, x in enumerate(lines) if k not in gone for w, space in x))
    return out


def test_line_dedup_finds_passages_at_any_word(spark):
    """51 words without a sentence end, in mid-sentence, after other numbers of words each time; lines of one sign too."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(rng.choice(list("aeinrstlmdou"), rng.integers(1, 10))) for _ in range(n))
    passages, plain = [words(51) for _ in range(12)], [words(120) for _ in range(6)]
    texts = [f"{words(int(rng.integers(0, 40)))} {p} {words(9)}" for _ in range(3) for p in passages] + plain + ["\n".join("abcdefghij" * 12)] * 2 + ["short and equal.", "short  and equal."]
    found = {r["doc_id"]: r for r in drop_repeated_lines(rows_of(spark, texts).repartition(3)).collect()}
    assert [found[k]["text"] for k in range(len(texts))] == brute_lines(list(enumerate(texts)))
    assert [found[k]["n_removed"] > 0 for k in range(len(texts) - 4)] == [False] * 12 + [True] * 24 + [False] * 6
    assert not any(" ".join(p.split()[14:37]) in found[12 + k]["text"] for k, p in enumerate(passages))
    assert found[43]["text"] == found[45]["text"] == ""


def test_line_dedup(spark, docs, empty):
    shared = ". ".join(passage(70 + k, 14) for k in range(5)) + "."
    texts = ["  " + passage(1, 20) + ".\n" + shared + "\n" + passage(2, 30), shared + " " + passage(3, 10), passage(4, 9) + ". " + shared, passage(5, 80), shared, None, "", " \n ", "a b. c d. e f.", shared + "\n" + shared, "For " * 90, " ".join(f"{w}!!" for w in BASE.split()), " ".join(f"{w}!!" for w in BASE.split()[7:])]
    found = {r["doc_id"]: r for r in drop_repeated_lines(rows_of(spark, texts).repartition(3)).collect()}
    assert [found[k]["text"] or "" for k in range(len(texts))] == brute_lines(list(enumerate(texts)))
    assert found[3]["text"] == texts[3] and found[5]["text"] is None and found[4]["text"] == "" and found[0]["n_removed"] == 0
    assert drop_repeated_lines(docs).count() == len(TEXTS) + 1 and drop_repeated_lines(empty).count() == 0
    twice = drop_repeated_lines(rows_of(spark, [shared, shared, BASE, BASE], [3, 3, 4, 5]))
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in twice.collect()) == [(3, False), (3, False), (4, False), (5, True)]
    carried = drop_repeated_lines(docs, carry=("key", "body", "n_chars")).first()
    assert carried["carried"]["key"] == "k"


def test_pieces_of_plain_texts_are_remembered_whatever_marks_their_words_have(monkeypatch):
    words, asked = packing.WordIds(word_tokenizer()), []
    plain = words._piece
    monkeypatch.setattr(words.pieces, "of", lambda p: asked.append(p) or plain(p))
    chunks, whole = [], words.chunks.of
    monkeypatch.setattr(words.chunks, "of", lambda c: chunks.append(c) or whole(c))
    for text in ("Thentien, (thentien) 'THENTIEN'.\tÀé's\x0b12", "", " \n", "a <|x|> b", "x\x1cy thentien", "中 é"):
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert asked.count("thentien") == 1 and not any("thentien" in c.lower() and "," in c for c in chunks)
