"""The registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import mine_collocations
from .common import fold_of, read
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_with_next
from .html_text import extract_text
from .language_id import fit_language, identify_language
from .license_scan import NOTICES, scan_notices
from .line_dedup import LONG, NEAR, ORDER, RUN, SPREAD, drop_repeated_lines
from .lm_scoring import score_documents
from .mixing import mix_sources
from .ngram_join import ngram_components
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .spelling import corpus_words, group_variants


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return identify_language(docs, fit_language(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"), to="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), word_tokenizer())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), word_tokenizer())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels"))).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(read(spark, sf_dir, "documents")).drop("key")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_notices(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of_base = [k for k, n in enumerate(NOTICES) if n.base]
    base = F.filter("places", lambda p: (p["edits"] == 0) & p["notice"].isin(of_base))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    first = F.transform(base, lambda p: p["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), labels(base).alias("base_labels"), labels("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["likeness"])), F.lit(0.0)).alias("score"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(corpus_words(read(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_language_id, op3_exact_dedup, op4_html_extraction, op5_best_fit_packing, op6_mixing, op7_lm_scoring, op8_fingerprints, op9_quality, op10_line_dedup, op11_license_scan, op12_spelling_variants, op13_collocations)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distances in DuckDB go by bytes: for them the letters beyond ASCII become signs that no word has.
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
PLAIN = "".join(chr(c) for c in range(33, 127) if not (97 <= c <= 122 or c in (39, 45)))[: len(ACCENTED)]

#: crc32 in SQL, byte by byte from its polynomial.
CRC_STEPS = "steps AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i))"


def crc32_sql(text: str) -> str:
    """Of a text that isn't empty, with the table t of steps."""
    codes = rf"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\1 ', 'g')[:-2], ' '), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


ORACLES = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
        ), reached AS (
            SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.to_id
        )
        SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.to_id) AS component_id
        FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_line_dedup": rf"""
        WITH numbered AS (
            SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, body) AS r, * FROM (SELECT DISTINCT doc_id, text, coalesce(text, '') AS body FROM documents)
        ), tokens AS (
            SELECT r, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT r, regexp_extract_all(body, '\S+\s*') AS t FROM numbered)
        ), words AS (
            SELECT r, i, token, rtrim(token, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word FROM tokens
        ), bytes AS (SELECT word, list_transform(string_split(regexp_replace(hex(encode(word)), '(..)', '\1 ', 'g')[:-2], ' '), lambda x: ('0x' || x)::HUGEINT) AS b FROM (SELECT DISTINCT word FROM words)),
        -- The bytes beyond the {LONG}th share its power, so they are summed first.
        coded AS (
            SELECT word, (list_reduce(list_reverse(list_append(b[1:{LONG - 1}], coalesce(list_sum(b[{LONG}:]), 0)::HUGEINT)), lambda h, x: (h * {ORDER} + x) % 18446744073709551616) * {SPREAD}) % 18446744073709551616 // 4294967296 AS crc
            FROM bytes
        ),
        marked AS (SELECT w.*, CASE WHEN word IS DISTINCT FROM lag(word) OVER (PARTITION BY r ORDER BY i) THEN crc END AS h, regexp_matches(word, '[.!?]$') AS mark, contains(token, chr(10)) AS break FROM words w JOIN coded USING (word)),
        ended AS (SELECT *, break OR mark AND NOT coalesce(bool_or(mark OR break) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {NEAR} PRECEDING AND 1 PRECEDING), FALSE) AS hard FROM marked),
        runs AS (SELECT *, coalesce(sum(hard::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM ended),
        least AS (SELECT r, run, i, min(h) OVER w AS h, count(*) OVER w AS n FROM runs WINDOW w AS (PARTITION BY r, run ORDER BY i ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)),
        cuts AS (SELECT DISTINCT r, max(x.i) AS i FROM least l JOIN runs x USING (r, run, h) WHERE l.n = {RUN} AND x.i BETWEEN l.i AND l.i + {RUN - 1} GROUP BY r, l.i),
        lined AS (
            SELECT x.*, coalesce(sum((hard OR c.i IS NOT NULL)::INT) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM runs x LEFT JOIN cuts c ON c.r = x.r AND c.i = x.i
        ), sublined AS (SELECT * REPLACE (line * 1000000000 + (row_number() OVER (PARTITION BY r, line ORDER BY i) - 1) // {RUN} AS line) FROM lined),
        numbered_lines AS (SELECT * REPLACE (dense_rank() OVER (PARTITION BY r ORDER BY line) - 1 AS line) FROM sublined),
        lines AS (SELECT r, line, string_agg(word, ' ' ORDER BY i) AS t, string_agg(token, '' ORDER BY i) AS whole FROM numbered_lines GROUP BY r, line),
        windows AS (
            SELECT r, line, string_agg(t, chr(10)) OVER w AS t, count(*) OVER w AS n, count(*) OVER (PARTITION BY r) AS n_lines FROM lines WINDOW w AS (PARTITION BY r ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
        ), later AS (
            SELECT r, line, n FROM windows WHERE n = 3 OR line = 0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY r, line) > 1
        ), gone AS (SELECT DISTINCT r, line + k AS line FROM later, range(0, 3) AS s(k) WHERE k < n),
        kept AS (
            SELECT l.r, string_agg(whole, '' ORDER BY line) FILTER (g.line IS NULL) AS t, count(*) AS n_lines, count(g.line) AS n_removed, bool_or(line = 0 AND g.line IS NULL) AS head FROM lines l LEFT JOIN gone g USING (r, line) GROUP BY l.r
        )
        SELECT e.doc_id, CASE WHEN k.n_removed > 0 THEN CASE WHEN k.head THEN regexp_extract(d.body, '^\s*') ELSE '' END || coalesce(k.t, '') ELSE e.text END AS text, coalesce(k.n_lines, 0)::INT AS n_lines, coalesce(k.n_removed, 0)::INT AS n_removed
        FROM documents e JOIN numbered d ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.text IS NOT DISTINCT FROM e.text LEFT JOIN kept k USING (r)
    """,
    # The notices' own words, edits and labels; other letters than ASCII count as one sign each in distances.
    "op11_license_scan": rf"""
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), notices AS (
            SELECT * FROM (VALUES {", ".join(f"({k}, '{n.label}', '{n.fixed}', '{n.rest}', {n.edits}, {n.words}, {n.base}, '{n.fixed}.*(' || '{"|".join(p for p, _ in n.seeds)})')" for k, n in enumerate(NOTICES))}) AS t(k, label, fixed, rest, edits, n, base, needed)
        ), plain AS (
            SELECT r, k, list_transform(w, lambda x: regexp_replace(x, '[^\x00-\x7F]', '~', 'g')) AS w FROM words JOIN notices ON regexp_matches(array_to_string(w, ' '), needed)
        ), starts AS (SELECT r, k, w, unnest(range(len(w))) AS pos FROM plain),
        sizes AS (SELECT *, unnest(range(greatest(n - edits, 1), n + edits + 1)) AS size FROM notices),
        windows AS (
            SELECT r, pos, k, s.label, s.base, s.edits AS most, length(s.fixed || s.rest) AS size_of, s.rest, substr(array_to_string(w[pos + 1:pos + s.size], ' '), length(s.fixed) + 1) AS t
            FROM starts JOIN sizes s USING (k) WHERE pos + s.size <= len(w) AND (s.fixed = '' OR w[pos + 1] = rtrim(s.fixed)) AND starts_with(array_to_string(w[pos + 1:pos + s.size], ' '), s.fixed)
        ), places AS (
            SELECT *, levenshtein(t, rest) AS edits FROM windows WHERE abs(length(t) - length(rest)) <= most
        ), found AS (
            SELECT r, count(*) FILTER (base AND edits = 0) AS n_base, min(pos) FILTER (base AND edits = 0) AS first_word, max(pos) FILTER (base AND edits = 0) AS last_word,
                array_to_string(list_sort(list(DISTINCT label) FILTER (base AND edits = 0)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(1 - edits / size_of::DOUBLE) AS score
            FROM places WHERE edits <= most GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM words LEFT JOIN found USING (r)
    """,
    # Words one edit apart have a common text once a letter is left out of one or both.
    "op12_spelling_variants": rf"""
        WITH RECURSIVE {CRC_STEPS}, runs AS (
            SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
        ), coded AS (
            SELECT run, m, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, steps
        ), words AS (
            SELECT word, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, m FROM coded) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(m) >= 2
        ), cuts AS (
            SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT))))) AS part FROM words
        ), pairs AS (
            SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.part = b.part AND a.word <> b.word
        ), near AS (
            SELECT * FROM pairs WHERE levenshtein(translate(word, '{ACCENTED}', '{PLAIN}'), translate(near, '{ACCENTED}', '{PLAIN}')) = 1
        ), told AS (
            SELECT w.word, w.n, count(p.near) AS n_near, min((-p.near_n, p.near)) AS best FROM words w LEFT JOIN near p ON p.word = w.word GROUP BY ALL
        ), forms AS (
            SELECT word, n, n_near, CASE WHEN n_near > 0 AND -best[1] >= 10 * n THEN best[2] END AS form, CASE WHEN n_near > 0 AND -best[1] >= 10 * n THEN -best[1] END AS form_n FROM told
        ), way AS (
            SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT w.word, f.form, k + 1 FROM way w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.n, f.n_near, f.form, f.form_n::BIGINT AS form_n, w.root FROM forms f JOIN (SELECT word, max_by(root, k) AS root FROM way GROUP BY 1) w ON w.word = f.word
    """,
    "op13_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
        ), f AS (
            SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_concat(w, [array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))], [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])) AS g FROM pieces) GROUP BY ALL
        ), keyed AS (SELECT lang || chr(1) || g AS key, f FROM f WHERE f >= 10),
        candidates AS (
            SELECT lang, g, f, string_split(g, ' ') AS w FROM f WHERE f >= 10 AND contains(g, ' ')
        ), cuts AS (
            SELECT lang, g, f AS a, k, array_to_string(w[:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM candidates, (VALUES (1), (2)) AS t(k) WHERE k < len(w)
        ), scored AS (
            SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN keyed x ON x.key = c.lang || chr(1) || c.first JOIN keyed y ON y.key = c.lang || chr(1) || c.rest
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, part, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE len(w) = 3) GROUP BY ALL
        ), kept AS (
            SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
        ), sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM kept k JOIN sizes s ON s.lang = k.lang
        QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, g) <= 2000
    """,
}
