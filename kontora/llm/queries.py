"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, inner_products, licenses, mixing, ngram_join, pii, quality, secrets, spelling, substring_dedup, token_files


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(documents(spark, sf_dir, "doc_id", "text")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir, "doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write(documents(spark, sf_dir, "doc_id", "text"), token_files.new_folder(spark), end_id=2)
    return token_files.read_documents(shards).withColumnRenamed("id", "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.scan(documents(spark, sf_dir, "doc_id", "text")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return inner_products.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_files": op9_token_files,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_top_k": op13_top_k,
}

#: The words of a text, as SQL.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '(?m)^[ \\t]*(?:copyright|©|\\(c\\))[^\\n]*$', '', 'g')"
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _licence_bodies(name: str, source: str) -> str:
    """Steps from the table `source` (…, text) to `name` (…, body): texts without titles, rights lines, list marks and holders."""
    plain = "lower(text)"
    for pattern in (licenses.COPYRIGHT, licenses.RIGHTS, licenses.MARKS):
        plain = f"regexp_replace({plain}, {_quoted(pattern)}, '', 'g')"
    title = r"'^[^\n]{0,60}\blicen[sc]e\b[^\n]{0,40}\n'"
    body = "CASE WHEN length(c2) >= 100 THEN c2 ELSE c1 END"
    for pattern, to in licenses.HOLDERS:
        body = f"regexp_replace({body}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return f"""{name}_1 AS (SELECT *, {plain} AS t1 FROM {source}),
        {name}_2 AS (SELECT *, regexp_replace(t1, '^[^\\p{{L}}]*', '') AS rest FROM {name}_1),
        {name}_3 AS (SELECT *, CASE WHEN regexp_matches(rest, {title}) AND NOT regexp_matches(regexp_extract(rest, '^[^\\n]*'), '\\bunder\\b') THEN regexp_replace(rest, {title}, '') ELSE t1 END AS t2 FROM {name}_2),
        {name}_4 AS (SELECT *, {_canonical("t1")} AS c1, {_canonical("t2")} AS c2 FROM {name}_3),
        {name} AS (SELECT * EXCLUDE (t1, t2, rest, c1, c2), {body} AS body FROM {name}_4)"""


def _licences() -> str:
    """The scan of licences as SQL: whole texts by their bodies, single lines by the listed notices, standard headers."""
    texts = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses._all_known(licenses.KNOWN + licenses.TEXTS))
    headers = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in licenses.HEADERS)
    return f"""
        WITH known(id, text) AS (VALUES {texts}), {_licence_bodies("kb", "known")},
        whole AS (SELECT body, min(id) AS license_id FROM kb GROUP BY body),
        single AS (SELECT {_canonical("text")} AS c, min(id) AS id FROM known GROUP BY 1),
        heads AS (SELECT id, ' ' || {_canonical("text")} || ' ' AS h FROM (VALUES {headers}) t(id, text)),
        docs AS (SELECT doc_id, coalesce(text, '') AS text, {_canonical("coalesce(text, '')")} AS c FROM documents), {_licence_bodies("db", "docs")},
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
        found AS (SELECT doc_id, s.id FROM l JOIN single s ON s.c = {_canonical("line")} WHERE regexp_matches(line, '(?i)licen[sc]')
            UNION SELECT doc_id, h.id FROM docs JOIN heads h ON contains(' ' || c || ' ', h) WHERE regexp_matches(c, 'licen[sc]e')),
        n AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM found GROUP BY doc_id)
        SELECT d.doc_id, w.license_id, coalesce(n.notices, '') AS notices, CASE WHEN c <> '' THEN sha256(c) END AS text_digest
        FROM db d LEFT JOIN whole w ON c <> '' AND w.body = d.body LEFT JOIN n ON n.doc_id = d.doc_id
    """


#: The table of the usual checksum of 32 bits, from its polynomial.
_CRC = []
for _c in range(256):
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC.append(_c)

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

ORACLES = {
    "op5_quality": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n FROM p),
        r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM g WHERE n > 1) x GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        u AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     coalesce(u.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(u.lines, 0) AS lines, len([w FOR w IN ws IF lower(w) IN ({_STOP})]) AS stop
              FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id),
        v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1 AND (n_words < 50 OR stop / n_words >= 0.02) AND n_dup_lines / greatest(lines, 1) <= 0.5 AS kept
        FROM v
    """,
    "op6_licenses": _licences(),
    "op3_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        h AS (SELECT doc_id, [md5(array_to_string(ws[i:i + 19], ' ')) FOR i IN generate_series(1, len(ws) - 19)] AS gs FROM w WHERE len(ws) >= 20),
        p AS (SELECT doc_id, unnest(generate_series(1, len(gs))) AS i, unnest(gs) AS g FROM h),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM p),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM g WHERE nth > 1),
        k AS (SELECT w.doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
        left_over AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS kept FROM k LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY k.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(gone.i) AS n_removed, sha256(coalesce(any_value(kept), '')) AS kept_sha256
        FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id LEFT JOIN left_over ON left_over.doc_id = w.doc_id
        GROUP BY w.doc_id, ws
    """,
    "op4_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
        SELECT v AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(u) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = v GROUP BY v
    """,
    "op12_spelling": f"""
        WITH RECURSIVE c AS MATERIALIZED (SELECT {_CRC}::BIGINT[] AS crc),
        r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        o AS (SELECT id, run, count(*) AS k, flatten([CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END FOR x IN string_split(id || ':' || run, '')]) AS bytes FROM r WHERE length(run) >= 6 GROUP BY id, run),
        h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, [b::BIGINT FOR b IN bytes]), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS h FROM o, c),
        v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) t WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        d AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v) t),
        near AS (
            SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, v.word, v.n FROM d x JOIN v ON v.word = x.a || x.b
            UNION SELECT v.word, y.word, y.n FROM d y JOIN v ON v.word = y.a || y.b),
        best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN (SELECT min(near.near) FROM near WHERE near.word = v.word AND near.near_n = best.m) END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
              FROM v LEFT JOIN best ON best.word = v.word),
        u AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT u.word, f.form, step + 1 FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL),
        t AS (SELECT word, arg_max(root, step) AS root FROM u GROUP BY word)
        SELECT f.word, t.root, n, n_near, form, form_n FROM f JOIN t ON t.word = f.word
    """,
    "op13_top_k": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
