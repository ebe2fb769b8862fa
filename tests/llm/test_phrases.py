"""Licence scan, spelling variants and collocations against brute force, with nulls, empty and long texts, repeats, clashing names."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from test_operators import rows_of

from lumenspan.llm import collocations, spelling
from lumenspan.llm.collocations import mine_collocations
from lumenspan.llm.license_scan import NOTICES, Notice, Scanner, scan_notices
from lumenspan.llm.spelling import corpus_words, group_variants, near_words

LETTERS = "[A-Za-zÀ-ÿ]+"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def brute_notices(text):
    """Least edits of each notice over all runs of words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    found = {}
    for k, n in enumerate(NOTICES):
        for size in range(max(1, n.words - n.edits), n.words + n.edits + 1):
            for at in range(len(words) - size + 1):
                own = " ".join(words[at : at + size])
                if own.startswith(n.fixed) and abs(len(own) - len(n.text)) <= n.edits:
                    d = distance(own[len(n.fixed) :], n.rest)
                    if d <= n.edits:
                        found[k] = min(d, found.get(k, 99))
    return found


def noisy(rng, text):
    out = list(text)
    for _ in range(rng.randrange(5)):
        k = rng.randrange(len(out))
        out[k] = rng.choice(["", out[k] + rng.choice("abl e"), rng.choice("abcé s")])
    return "".join(out)


def test_notices_against_all_runs_of_words():
    rng, scanner = random.Random(4), Scanner()
    fill = ["the", "license", "permit", "mit", "general", "public", "apache", "lic", "ense", "of"]
    for _ in range(250):
        text = " ".join(rng.choice([noisy(rng, rng.choice(NOTICES).text).upper(), rng.choice(fill) + rng.choice(["", ",", "\n", "-"])]) for _ in range(rng.randrange(12)))
        n, places = scanner.scan(text)
        least = {}
        for p in places:
            least[p[1]] = min(p[2], least.get(p[1], 99))
        assert least == brute_notices(text) and n == len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
        for label, k, edits, first, words, start, end, likeness in places:
            own = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text[start:end])))
            assert distance(own, NOTICES[k].text) == edits and label == NOTICES[k].label and likeness == 1 - edits / len(NOTICES[k].text)
            assert own.split() == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))[first : first + words]


def test_notices_of_a_table(spark):
    texts = ["MIT License", "mit license", None, "", "x " * 50_000 + "mit-licence apache  license mit license", "the permit license"]
    docs = rows_of(spark, [*texts, texts[0]]).withColumnsRenamed({"n": "n_words"})
    found = {r["doc_id"]: r for r in scan_notices(docs).collect()}
    assert [found[k]["n_words"] for k in range(7)] == [2, 1, 0, 0, 50_006, 3, 2]
    assert [[(p["label"], p["edits"], p["first_word"]) for p in found[k]["places"]] for k in (0, 1, 2, 3, 5)] == [[("mit", 0, 0)], [], [], [], []]
    assert [(p["label"], p["edits"], p["first_word"]) for p in found[4]["places"]] == [("mit", 1, 50_000), ("apache", 0, 50_002), ("mit", 0, 50_004)]
    assert scan_notices(rows_of(spark, [])).count() == 0
    with pytest.raises(ValueError, match="too short"):
        Notice("x", "", "short", 2)


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_variants(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and distance(w, x) == 1] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in form.items() if n[x] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def test_spelling_against_brute_force(spark):
    rng = random.Random(2)
    base = ["thoneral", "Èrleaquö", "aaaaaaa", "aaaaaaaa", "abcdefghij", "abcdefgij"]
    words = base * 3 + [noisy(rng, rng.choice(base)).replace(" ", "") for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) + rng.choice([".", " 12ab", "\n"]) for _ in range(60)] + [None, "", "thoneral " * 3000, "abcdefghij " * 900 + "abcdefghi abcdefghi", "abcdefgh " * 9]
    ids = [None, *range(1, 64), 63]
    found = {r["word"]: tuple(r)[1:] for r in group_variants(corpus_words(rows_of(spark, texts, ids).repartition(3)), per_group=9).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    want = brute_variants(brute_words(list(zip(ids, texts, strict=True))))
    assert found == want and len({r for *_, r in want.values()}) < len(want) > 60
    assert group_variants(corpus_words(rows_of(spark, []))).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [("abcdefg", 10**6), ("abcdefgh", 10**5), ("abcdefghi", 10**4), ("abcdefghij", 10**3), ("abcdefghijk", 100), ("abcdefghijkl", 10), ("abcdefghijklm", 2), ("zzzzzzz", 5)]
    found = {r["word"]: r["root"] for r in group_variants(spark.createDataFrame(chain, "word string, n long"), times=5).collect()}
    assert found == {w: "zzzzzzz" if w[0] == "z" else "abcdefg" for w, _ in chain}


@pytest.mark.parametrize("per_group", [3, 50, 10_000])
def test_near_words_lose_no_pair_in_blocks(spark, per_group):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) + "ing" for _ in range(250)} | {"aaaaaaa", "aaaaaaaa", "aaaaaab"})
    found = [(r["word"], r["near"]) for r in near_words(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long"), per_group).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if distance(a, b) == 1}
    assert all(spelling.one_edit(a, b) == (distance(a, b) == 1) for a in words[:60] for b in words)


def test_only_words_alike_up_to_or_from_the_gram_are_indexed(monkeypatch):
    indexed, plain = [], spelling.Index

    def noted(words, *more):
        indexed.append(len(words))
        return plain(words, *more)

    monkeypatch.setattr(spelling, "Index", noted)
    apart = [(f"oft{a}{a}zqz{b}{b}", 2, ["zqz"], 0) for a, b in zip("abcdefgh", "ijklmnop", strict=True)]
    assert not list(spelling._pairs(apart, "zqz", False)) and not indexed
    near = [("oftaazqzii", 2, ["zqz"], 0), ("oftaazqzji", 3, ["zqz"], 0), ("obtaazqzii", 4, ["zqz"], 0), ("oftaazqzi", 5, ["zqz"], 0)]
    assert {frozenset((a, b)) for a, _, b, _ in spelling._pairs(near, "zqz", False)} == {frozenset((a, b)) for a, *_ in near for b, *_ in near if distance(a, b) == 1}


def brute_collocations(rows, most=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            own = f.setdefault(lang, Counter())
            for k in (1, 2, 3):
                own.update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= 10}
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in candidates.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((Fraction(10**6 * a * a, own[p[:k]] * own[p[k:]]) // 1, k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def with_langs(spark, texts, langs):
    rows = [(k, t, lang, "s", None, "x", "y", 1, "k", None, 0) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, rows_of(spark, []).schema)


def test_collocations_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["ab", "a", "b", "New", "york", "city", "é-x", "of", "the", "a b", "x\x1cy", "'", "A"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t", "\x0b", "!?"]) for _ in range(rng.randrange(120))) for _ in range(80)] + [None, "", " .,\n", "ha " * 9000, "of the of the"]
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    want = brute_collocations(list(zip(langs, texts, strict=True)))
    for part in (3, 600_000):
        monkeypatch.setattr(collocations, "CHUNK", 700 if part == 3 else 3_000_000)
        found = mine_collocations(with_langs(spark, texts, langs).repartition(3), per_part=40 if part == 3 else part)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    top = mine_collocations(with_langs(spark, texts, langs), most=3).collect()
    assert sorted(map(tuple, top)) == [r for r in want if r[1] <= 3]
    assert mine_collocations(with_langs(spark, [], [])).count() == 0 == mine_collocations(with_langs(spark, [None, " . "], ["en", None])).count()


def test_sketch_bounds_hold_for_any_size(spark):
    texts = [" ".join(f"w{(k * j) % 17}" for j in range(60)) for k in range(1, 40)]
    lines = collocations.guarded_lines(with_langs(spark, texts, ["en"] * len(texts)))
    true = Counter(p for t in texts for k in (2, 3) for p in zip(*[t.split()[j:] for j in range(k)], strict=False))
    for n_words in (10, 10**7):
        got = {tuple(r["phrase"].split()) for r in collocations.candidate_phrases(lines, n_words).collect()}
        assert {p for p, a in true.items() if a >= 10} <= got


def test_counts_of_a_tasks_chunks_are_summed_before_they_are_shuffled():
    one = (np.array([1, 0, 1]), pa.array(["é b", "a", "c d e"]), np.array([2, 3, 2**40]))
    two = (np.array([1, 0]), pa.array(["é b", "z"]), np.array([9, 1]))
    packed = collocations._by_part("en", [one, two])
    assert packed.column("part").to_pylist() == [0, 1]
    found = [tuple(r.values()) for b in collocations._sums(2)(iter([packed, collocations._by_part("fr", [two])])) for r in b.to_pylist()]
    assert sorted(found) == [("en", "a", 3), ("en", "c d e", 2**40), ("en", "é b", 11), ("fr", "é b", 9)]
    assert collocations._by_part("en", [(np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64))]).num_rows == 0


def test_products_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", "a b", 9 * 10**12)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", "a", 10**13), ("en", "b", 9 * 10**12 + 7)], "lang string, word string, n long")
    r = collocations._scored(counted, words).first()
    assert r["score"] == 10**6 * (9 * 10**12) ** 2 // (10**13 * (9 * 10**12 + 7))


def test_lines_are_scanned_once_for_any_number_of_candidates(spark):
    texts = [" ".join(f"w{(k * j) % 17}" for j in range(60)) for k in range(1, 40)]
    docs, jobs, found = with_langs(spark, texts, ["en"] * len(texts)), [], []
    for part in (5, 600_000):
        spark.sparkContext.setJobGroup(f"phrases-{part}", "")
        found.append(sorted(map(tuple, mine_collocations(docs, per_part=part).collect())))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"phrases-{part}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and len(found[0]) > 30 and jobs[0] == jobs[1]
