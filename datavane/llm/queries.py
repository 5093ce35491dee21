"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, exact, interactions, jaccard, language, licenses, merkle, packing, shards, substrings, suffixes, url_rules

#: The vocabulary as a tokenizers file, and as ranks; every executor needs both at the same place.
VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, profiles)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.byte_shards(documents(spark, sf_dir), 8)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file. Each tenth is a licence file (LICENSE-<id>) of a directory source, source/thousand or
    source/thousand/fifty, in turn; the others lie in source/thousand/fifty and inherit from the nearest of these."""
    docs = documents(spark, sf_dir)
    i, top = F.col("doc_id"), F.coalesce("source", F.lit("unknown"))
    thousand, fifty = F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 50").cast("string")
    depth = F.pmod(F.expr("doc_id div 10"), F.lit(3))
    held = F.concat(F.lit("LICENSE-"), i.cast("string"))
    path = F.when(i % 10 != 0, F.concat_ws("/", top, thousand, fifty, F.concat(i.cast("string"), F.lit(".txt"))))
    path = path.when(depth == 0, F.concat_ws("/", top, held)).when(depth == 1, F.concat_ws("/", top, thousand, held)).otherwise(F.concat_ws("/", top, thousand, fifty, held))
    return licenses.inherit(licenses.scan(docs.select("doc_id", "text", path.alias("path"))), "LICENSE(?:-.*)?")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), VOCABULARY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_words(documents(spark, sf_dir), 50)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(documents(spark, sf_dir), RANKS, VOCABULARY))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_bytes(documents(spark, sf_dir), 400)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries():
    return {f.__name__: f for f in (op1_url_rules, op2_language_id, op3_byte_shards, op4_license_scan, op5_bpe_round_trip, op6_substring_dedup, op7_best_fit_packing, op8_exact_dedup, op9_ngram_jaccard, op10_merkle_fingerprints, op11_conversation_repair, op12_suffix_dedup, op13_filter_audit)}


def _tree(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{merkle.LEAF}'), lambda x: sha256(x))))"


def _print(nodes: str) -> str:
    node = "sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))"
    leaves = "substr(sha256(array_to_string(p, '')), 1, 12) || '.' || array_to_string(list_transform(p, lambda x: substr(x, 1, 12)), '.')"
    return f"sha256(array_to_string(list_transform({nodes}, lambda s: {node}), '')) || '|' || array_to_string(list_transform({nodes}, lambda s: substr({node}, 1, 12) || ':' || array_to_string(list_transform(s, lambda p: {leaves}), ',')), '|')"


def _repair_sql() -> str:
    """The cheapest edits as a recursion from a conversation's last row: for each grammar state a string of six digits of cost and the
    audit, so that the least string is the cheapest, then the ASCII-least."""

    def add(cost, letter, value):
        return f"lpad(CAST(CAST(substr({value}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || '{letter}' || substr({value}, 7)"

    moves = ((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),))
    forced = (2, 2, 3, 2)
    base = []
    for q in range(4):
        keep = " ".join(f"WHEN stays AND ini = '{r}' THEN {add('cut', 'K', f'v{to}')}" for r, to in moves[q])
        other = add("3 + cut", "R", f"v{forced[q]}")
        base.append(f"list_min([{add(4, 'D', f'v{q}')}, CASE {keep} END, CASE WHEN stays THEN {other} END]) AS b{q}")
    best = []
    for q in range(4):
        one, two = forced[q], forced[forced[q]]
        best.append(f"list_min([b{q}, {add(3, 'I', f'b{one}')}, {add(6, 'II', f'b{two}')}]) AS v{q}")
    return rf"""
            WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 20 AS kind FROM conversations),
            m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
            o AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM m),
            f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][ 	-
]*$') THEN 'n' ELSE 't' END AS fault,
                    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM o),
            g AS (SELECT conv_id, i, ini, fault IN ('n', 't') AS stays, CASE fault WHEN 't' THEN 3 ELSE 0 END AS cut FROM f),
            t(conv_id, i, v0, v1, v2, v3) AS (SELECT conv_id, max(i) + 1, '000000', '000006II', '000003I', '000000' FROM f GROUP BY conv_id
                UNION ALL SELECT conv_id, i, {', '.join(best)} FROM (SELECT g.conv_id, g.i, {', '.join(base)} FROM t JOIN g ON g.conv_id = t.conv_id AND g.i = t.i - 1)),
            a AS (SELECT conv_id, CAST(substr(v0, 1, 6) AS BIGINT) AS cost, substr(v0, 7) AS audit FROM t WHERE i = 1),
            l AS (SELECT conv_id, unnest(string_split(audit, '')) AS c, generate_subscripts(string_split(audit, ''), 1) AS j FROM a),
            n AS (SELECT conv_id, c, count(*) FILTER (WHERE c <> 'I') OVER w AS i, count(*) FILTER (WHERE c <> 'D') OVER w AS p FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
            e AS (SELECT n.conv_id, p, CASE WHEN c = 'K' THEN role END AS role, CASE WHEN c = 'I' THEN '' ELSE text END AS text,
                    max(CASE WHEN p = 1 AND c = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
                  FROM n LEFT JOIN f ON f.conv_id = n.conv_id AND f.i = n.i WHERE c <> 'D'),
            h AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (p + system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS sha FROM e GROUP BY conv_id),
            s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
            SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id = q.conv_id LEFT JOIN a ON a.conv_id = q.conv_id LEFT JOIN h ON h.conv_id = q.conv_id"""


_WORD = r"[^\x20\x09-\x0D]+"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_rules": r"""
            WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM p),
            u AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM h),
            r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
            m AS (SELECT u.page_id, h || p AS rule, v, row_number() OVER (PARTITION BY u.page_id ORDER BY length(h || p) DESC, length(h) DESC) AS n
                  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
            SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.n = 1""",
        "op6_substring_dedup": rf"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
            s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
            k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
            f AS (SELECT h, min(doc_id) AS lo FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
            g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT k.doc_id, k.i FROM k JOIN f ON k.h = f.h AND k.doc_id > f.lo)),
            x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
            y AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN y ON d.doc_id = y.doc_id""",
        "op8_exact_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
        "op9_ngram_jaccard": rf"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
            r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
            SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
        "op10_merkle_fingerprints": rf"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
            f AS (SELECT doc_id, n, t, nt, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS ed FROM e),
            g AS (SELECT doc_id, n, ed, {_tree('t')} AS a, {_tree('ed')} AS b, {_tree('nt')} AS c FROM f),
            h AS (SELECT doc_id, n, ed, a, b,
                list_distinct(list_transform(flatten(flatten(a)), lambda x: substr(x, 1, 12))) AS la,
                list_distinct(list_transform(flatten(flatten(b)), lambda x: substr(x, 1, 12))) AS lb,
                list_distinct(list_transform(flatten(flatten(c)), lambda x: substr(x, 1, 12))) AS lc,
                list_filter(range(0, greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1])[1] AS ds FROM g),
            i AS (SELECT *, coalesce(a[ds + 1], [['-']]) AS sa, coalesce(b[ds + 1], [['-']]) AS sb FROM h),
            j AS (SELECT *, list_filter(range(0, greatest(len(sa), len(sb))), lambda i: sa[i + 1] IS DISTINCT FROM sb[i + 1])[1] AS dp FROM i),
            k AS (SELECT *, coalesce(sa[dp + 1], []) AS pa, coalesce(sb[dp + 1], []) AS pb FROM j),
            m AS (SELECT *, coalesce(list_filter(range(0, greatest(len(pa), len(pb))), lambda i: pa[i + 1] IS DISTINCT FROM pb[i + 1])[1], 0) AS dl FROM k)
            SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, {_print('a')} AS fingerprint, {_print('b')} AS edited_fingerprint,
                CASE WHEN len(la) + len(lb) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(la, lb)) / (len(la) + len(lb)) END AS near_edited,
                CASE WHEN len(la) + len(lc) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(la, lc)) / (len(la) + len(lc)) END AS near_next,
                CASE WHEN ds IS NOT NULL THEN ds || '.' || dp || '.' || dl END AS first_edit FROM m""",
        "op11_conversation_repair": _repair_sql(),
        "op12_suffix_dedup": r"""
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
            w AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 398)) AS i FROM d)),
            r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
            g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM r),
            k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
            s AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM k GROUP BY doc_id, k),
            p AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS lo, lo AS hi FROM s UNION ALL SELECT doc_id, max(hi), 1 << 30 FROM s GROUP BY doc_id),
            y AS (SELECT p.doc_id, string_agg(substr(x, CAST(2 * p.lo - 1 AS BIGINT), CAST(2 * (p.hi - p.lo) AS BIGINT)), '' ORDER BY p.lo) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
            z AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS n FROM s GROUP BY doc_id)
            SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
            FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id""",
        "op13_filter_audit": rf"""
            WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
            f AS (SELECT d.doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS bad,
                    coalesce(q.good, 0) AS good, coalesce(q.toxic, 0) AS toxic
                  FROM d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id),
            c AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bad),
            l(x) AS (VALUES (1), (2), (3), (4), (5)),
            o AS (SELECT [a.x, b.x, e.x, g.x, h.x] AS o FROM l a, l b, l e, l g, l h WHERE len(list_distinct([a.x, b.x, e.x, g.x, h.x])) = 5),
            s AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
            y AS (SELECT c.*, s.filter_order, s.step, o[step] AS me, bad[o[step]] AS fails, list_bool_or(list_transform(o[1:step - 1], lambda i: bad[i])) AS gone,
                    len(list_filter(bad, lambda b: b)) AS k FROM c, s),
            z AS (SELECT part, filter_order, step, any_value(me) AS me, CAST(sum(CASE WHEN NOT fails AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS BIGINT) AS kept,
                    CAST(sum(CASE WHEN fails AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
                    CAST(sum(CASE WHEN fails AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN fails AND NOT coalesce(gone, false) THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                    CAST(sum(CASE WHEN fails AND NOT coalesce(gone, false) THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM y GROUP BY part, filter_order, step)
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, me) AS BIGINT) AS shapley FROM z""",
    }
