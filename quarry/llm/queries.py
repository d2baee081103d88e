"""The queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import extraction, infilling, language, packing, pii, positional, quality, simhash, spelling, substring, topk, toxicity, warc
from quarry.llm.common import document_fold, read_table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.trained(language.training_rows(docs, document_fold()))
    found = language.identified(docs, model)
    return found.select("doc_id", F.coalesce(document_fold() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")


def _is(kind: str):
    return lambda s: s["kind"] == F.lit(kind)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.all_spans(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    added = F.concat("spans", F.sort_array("term_spans"))
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(F.col("spans")), 256).alias("base_sha256"), pii.joined_spans(added).alias("spans"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.with_quality(read_table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(warc.with_responses(read_table(spark, sf_dir, "pages")))
    found = warc.read_records(index, with_payload=False)
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lexicon = toxicity.trained(docs.where(document_fold() != 0), read_table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, lexicon)
    return found.select("doc_id", F.coalesce(document_fold() == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positional.build_index(read_table(spark, sf_dir, "documents"))
    found = positional.matches(index, read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"), "n_near", F.size("near_items").cast("long").alias("n_near_items"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(read_table(spark, sf_dir, "pages"))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.infilled(read_table(spark, sf_dir, "documents"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.counted_words(read_table(spark, sf_dir, "documents"), changed=spelling.damaged))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set, every id divisible by 50, against all rows."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.integer_vector(F.col("embedding")).alias("vector"))
    found = topk.top_k(rows, rows.where(F.col("id") % 50 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    "op1_language": op1_language,
    "op2_pii": op2_pii,
    "op3_substring": op3_substring,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_extraction": op10_extraction,
    "op11_infilling": op11_infilling,
    "op12_spelling": op12_spelling,
    "op13_topk": op13_topk,
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PII_SQL = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+",
    "card": "[0-9](?:[\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse({_DIGITS}), j, 1)::INT
    ELSE (2 * substr(reverse({_DIGITS}), j, 1)::INT) // 10 + (2 * substr(reverse({_DIGITS}), j, 1)::INT) % 10 END)) % 10 = 0"""
_VALID = f"""CASE kind WHEN 'ip' THEN regexp_full_match(v, '{r"(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$))+"}')
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15 ELSE true END"""


def _found_sql(source: str, kind: str, pattern: str) -> str:
    """key, kind, number, value, start of the matches: the texts between them and the matches take turns."""
    return f"""SELECT key, '{kind}' AS kind, v, i, sum(length(b) + length(v)) OVER (PARTITION BY key ORDER BY i) - length(v) AS s FROM
        (SELECT key, unnest(m) AS v, unnest(x[:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM (SELECT key, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS x FROM {source}) WHERE len(m) > 0)"""


_OP2_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key FROM documents), t AS (SELECT DISTINCT key, text FROM d),
    f AS ({" UNION ALL ".join(_found_sql("t", kind, pattern) for kind, pattern in _PII_SQL.items())}),
    b AS (SELECT key, kind, s, s + length(v) AS e, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {_DIGITS} ELSE lower(v) END AS entity FROM f WHERE {_VALID}),
    w AS (SELECT DISTINCT key, unnest(regexp_extract_all(lower(regexp_replace(text, '{_PII_SQL["email"]}', ' ', 'g')), '\\pL{{3,}}')) AS term FROM t),
    n AS (SELECT count(*)::DOUBLE AS n FROM t), h AS (SELECT DISTINCT key, entity FROM b), c AS (SELECT entity, count(*) AS n_c FROM h GROUP BY entity),
    m AS (SELECT term, count(*) AS n_t, count(*) FILTER (key IN (SELECT key FROM h)) AS m_t FROM w GROUP BY term),
    g AS (SELECT term, n_t, m_t / n_t * (m_t * m_t / (m_t * m_t + 2.0)) AS weight FROM m), p AS (SELECT entity, term, count(*) AS n_ct FROM h JOIN w USING (key) GROUP BY ALL),
    r AS (SELECT entity, term FROM p JOIN c USING (entity) JOIN g USING (term), n WHERE n > n_c AND weight * ln(n * n_ct / (n_c * n_t)) / ln(n / n_c) >= 0.5),
    k AS (SELECT DISTINCT key, term FROM h JOIN r USING (entity)), u AS (SELECT key, text FROM t WHERE key IN (SELECT key FROM k)),
    l AS ({_found_sql("u", "term", "\\pL{3,}")}),
    a AS (SELECT key, kind, s, s + length(v) AS e FROM l SEMI JOIN k ON l.key = k.key AND lower(l.v) = k.term WHERE NOT EXISTS (FROM b WHERE b.key = l.key AND b.s < l.s + length(l.v) AND l.s < b.e)),
    o AS (SELECT key, kind, s, kind || ':' || s || ':' || e AS x, CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 WHEN 'phone' THEN 4 ELSE 5 END AS z FROM (SELECT key, kind, s, e FROM b UNION ALL FROM a)),
    q AS (SELECT key, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _PII_SQL)}, string_agg(x, ',' ORDER BY z, s) FILTER (z < 5) AS base, string_agg(x, ',' ORDER BY z, s) AS spans FROM o GROUP BY key)
    SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _PII_SQL)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN q USING (key)"""

_OP3_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35), p AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM g),
    r AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p WHERE s IN (SELECT s FROM r)),
    o AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d), k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM o ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_OP5_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8), p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM g),
    r AS (SELECT doc_id, s FROM p GROUP BY ALL HAVING count(*) > 1), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM p SEMI JOIN r USING (doc_id, s)), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)),
    b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
    h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source), q AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
    a AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 2.0 END AS k FROM q), x AS (SELECT source, (f + m * k) / (n + k) AS rate FROM h, a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < 0.5 AS kept FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source"""

_OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
    b AS (SELECT *, list_reduce(list_transform(string_split(sha1(html), ''), lambda x: [(strpos('0123456789abcdef', x) - 1)]), lambda a, y: list_concat(a, y)) AS x FROM p),
    t AS (SELECT *, list_transform(range(0, 160), lambda i: (x[i // 4 + 1] >> (3 - i % 4)) & 1) AS z FROM b)
    SELECT page_id, strlen(html) AS payload_bytes,
        list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (z[5 * i + 1] * 16 + z[5 * i + 2] * 8 + z[5 * i + 3] * 4 + z[5 * i + 4] * 2 + z[5 * i + 5] + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM t"""

_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP9_SQL = f"""WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_BENCH_WORDS} AS w FROM benchmark),
    s AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0), q AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM s),
    z AS (SELECT DISTINCT n FROM q), g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z WHERE len(w) >= n), p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM g),
    f AS (SELECT doc_id, k, n, item FROM p JOIN q USING (n, s)), h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM f) GROUP BY doc_id),
    e AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM f GROUP BY doc_id),
    o AS (SELECT DISTINCT item, w[k] AS x, w[k:k + n - 1] AS t FROM s), y AS (SELECT doc_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
    v AS (SELECT doc_id, j, item FROM y JOIN o USING (x) WHERE list_has_all(y.w[greatest(j - 20, 1):j + 20], t)), r AS (SELECT doc_id, count(DISTINCT j) AS n_near, count(DISTINCT item) AS n_near_items FROM v GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id)"""

_OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
    h AS (SELECT *, list_transform(range(0, 4), lambda g: list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(x, (8 * g + i)::INT, 1)) - 1), lambda a, y: 16 * a + y)) AS h, length(t) AS n FROM d),
    f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
    p AS (SELECT *, substr(t, 1, a::INT) AS p, substr(t, a::INT + 1, (b - a)::INT) AS m, substr(t, b::INT + 1) AS s FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_OP12_SQL = r"""WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
    o AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= 6 GROUP BY ALL),
    b AS (SELECT w, k, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))::BIGINT[] AS x FROM o),
    h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, t),
    g AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM h),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM g WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    e AS (SELECT word, n, word AS key FROM v UNION ALL SELECT DISTINCT word, n, substr(word, 1, i::INT) || substr(word, i::INT + 2) FROM (SELECT *, unnest(range(0, length(word))) AS i FROM v)),
    p AS (SELECT DISTINCT a.word, b.word AS other, a.n, b.n AS m FROM e a JOIN e b USING (key) WHERE a.word <> b.word AND (CASE WHEN length(a.word) = length(b.word)
        THEN list_sum(list_transform(range(1, length(a.word) + 1), lambda i: (substr(a.word, i::INT, 1) <> substr(b.word, i::INT, 1))::INT)) = 1 ELSE key IN (a.word, b.word) AND abs(length(a.word) - length(b.word)) = 1 END)),
    q AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(struct_pack(other := other, m := m), struct_pack(x := -m, y := other)) AS best FROM p GROUP BY word),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * v.n THEN best.other END AS form, CASE WHEN best.m >= 5 * v.n THEN best.m END AS form_n FROM v LEFT JOIN q USING (word)),
    z AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT z.word, z.up, f.form FROM z JOIN f ON z.up = f.word)
    SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word AND z.up IS NULL"""

_OP13_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

#: The others are models, hashes or formats that SQL hasn't got; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op2_pii": _OP2_SQL, "op3_substring": _OP3_SQL, "op5_quality": _OP5_SQL, "op6_warc": _OP6_SQL, "op9_decontamination": _OP9_SQL, "op11_infilling": _OP11_SQL, "op12_spelling": _OP12_SQL, "op13_topk": _OP13_SQL}
