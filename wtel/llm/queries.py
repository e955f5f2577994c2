"""The thin queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wtel.llm import (
    bpe,
    divergence,
    embed,
    kneser_ney,
    langid,
    lexical,
    mixing,
    quality,
    secrets,
    setsketch,
    toxicity,
    url_filter,
    winnowing,
)
from wtel.llm.common import LOWER, UPPER, join_small, ranks_path, staged, table

URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source's size and target, and words taken of every document."""
    docs = table(spark, sf_dir, "documents")
    rows, units, sources = mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text")))
    copies = staged(units, "copies").toDF("_id", "_members", "_size", "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("members").eqNullSafe(F.col("_members"))
    taken = join_small(rows, copies, same & (F.col("size") == F.col("_size")), "inner")
    on = F.get("members", F.lit(0)).eqNullSafe(F.col("source"))
    return join_small(taken, sources, on, "inner").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of the decoded bytes."""
    path = path or ranks_path()
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links, component and whether it is kept, of every vector."""
    return embed.links(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and log probability of every document."""
    return kneser_ney.score(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, group and whether it is kept, of every document."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns, the digest of their spans, and all spans of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every two sources of a language, and the terms that mark each source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a benchmark item has too, and which items these are."""
    found = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifty documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_byte_bpe,
        op3_embedding_dedup,
        op4_url_filter,
        op5_toxicity,
        op6_quality_rules,
        op7_lm_scoring,
        op8_minhash_dedup,
        op9_secret_scans,
        op10_language_id,
        op11_source_divergence,
        op12_decontamination,
        op13_lexical_search,
    )
}


def _url_sql() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(whole, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"

    fits = ", ".join(
        f"CASE WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}'))"
        f" AND starts_with(path, '/{r.split('/', 1)[1]}') THEN ['{r}', '{v}'] END"
        for r, v in sorted(URL_RULES, key=lambda x: -len(x[0]))
    )
    return f"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path, translate(rest, '{UPPER}', '{LOWER}') AS whole FROM cut),
        judged AS (SELECT *, coalesce({fits}) AS fit, {" + ".join(map(hit, url_filter.STRICT))} AS n_strict,
            {" + ".join(map(hit, url_filter.SOFT))} AS n_soft FROM named)
        SELECT page_id, host, path, fit[1] AS rule, coalesce(fit[2], CASE WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_HITS}
            THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM judged"""


def _mix_sql() -> str:
    fills = "".join(
        f""",
        opened{k} AS (SELECT source, (any_value(rest) - coalesce(sum(tokens) FILTER (WHERE taken), 0))::BIGINT AS gap FROM run{k} GROUP BY source),
        best{k} AS MATERIALIZED (SELECT source, doc_id, size FROM (SELECT r.*, row_number() OVER (PARTITION BY r.source
            ORDER BY abs(o.gap - r.tokens), r.ord, r.doc_id NULLS FIRST, r.size) AS k
            FROM run{k} r JOIN opened{k} o ON r.source IS NOT DISTINCT FROM o.source
            WHERE NOT r.taken AND r.tokens > 0 AND abs(o.gap - r.tokens) < o.gap) WHERE k = 1),
        run{k + 1} AS MATERIALIZED (SELECT r.* REPLACE (r.taken OR b.size IS NOT NULL AS taken) FROM run{k} r LEFT JOIN best{k} b
            ON b.doc_id IS NOT DISTINCT FROM r.doc_id AND b.source IS NOT DISTINCT FROM r.source AND b.size = r.size)"""
        for k in range(mixing.FILLS)
    )
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""
        WITH sized AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
        counted AS (SELECT doc_id, source, size, count(*) AS n FROM sized GROUP BY doc_id, source, size),
        unit AS MATERIALIZED (SELECT doc_id, source, size, (n * size)::BIGINT AS tokens,
            md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, ''), ':', size::VARCHAR)) AS ord FROM counted),
        summed AS (SELECT source, sum(tokens)::BIGINT AS source_size FROM unit GROUP BY source),
        weighed AS (SELECT source, source_size,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weight} END AS w FROM summed),
        ranked AS (SELECT *, {mixing.MOST} * source_size AS cap,
            coalesce(sum({mixing.MOST} * source_size) OVER (ORDER BY {mixing.MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
            sum(w) OVER (ORDER BY {mixing.MOST} * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM weighed),
        levels AS (SELECT *, ({mixing.TOTAL}::DOUBLE * (SELECT sum(source_size) FROM weighed) - capped::DOUBLE) / rest_w::DOUBLE AS lv FROM ranked),
        chosen AS (SELECT coalesce(max(lv) FILTER (WHERE lv <= cap::DOUBLE / w), max(lv)) AS best_lv FROM levels),
        aimed AS MATERIALIZED (SELECT source, source_size, least(cap::DOUBLE, (SELECT best_lv FROM chosen) * w) AS target FROM ranked),
        planned AS MATERIALIZED (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS copies,
            CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT % source_size END AS rest FROM aimed),
        run0 AS MATERIALIZED (SELECT u.*, p.source_size, p.target, p.copies, p.rest,
            sum(tokens) OVER (PARTITION BY u.source ORDER BY ord, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) <= p.rest AS taken
            FROM unit u JOIN planned p ON u.source IS NOT DISTINCT FROM p.source)
        {fills}
        SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN s.size = 0 THEN 0 ELSE (r.copies + r.taken::INT) * s.size END::BIGINT AS taken
        FROM sized s JOIN run{mixing.FILLS} r ON s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.source IS NOT DISTINCT FROM r.source AND s.size = r.size"""


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


def _divergence_sql() -> str:
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    share = lambda n, total: f"(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v))::BIGINT"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            {_words("text", term)} AS w FROM documents),
        e AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS MATERIALIZED (SELECT lang, term, count(*) AS in_lang FROM e GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
        l AS (SELECT lang, count(*) AS v, sum(in_lang)::BIGINT AS total FROM k GROUP BY lang),
        g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL),
        c AS MATERIALIZED (SELECT g.lang, g.source, k.term, k.in_lang, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
        o AS (SELECT lang, source, sum(n)::BIGINT AS own FROM c GROUP BY ALL),
        p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n, {share("n", "own")} AS p, {share("in_lang", "total")} AS q
            FROM c JOIN o USING (lang, source) JOIN l USING (lang)),
        sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
        UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
            (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= {divergence.LISTED}"""


def _winnowing_sql() -> str:
    n, word = winnowing.WINDOW, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text", word)} AS w FROM documents),
        i AS (SELECT coalesce(item_id::VARCHAR, '') AS name, {_words("text", word)} AS w FROM benchmark),
        sized AS (SELECT name, w, least(len(w), {n}) AS n FROM i WHERE len(w) > 0),
        iw AS MATERIALIZED (SELECT DISTINCT name, n, array_to_string(w[s + 1:s + n], ' ') AS words
            FROM (SELECT name, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM sized)),
        dw AS (SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') AS words
            FROM (SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM iw))),
        m AS MATERIALIZED (SELECT r, n, s, name FROM dw JOIN iw USING (n, words)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m)) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM m) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


def _search_sql() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
        WITH e AS (SELECT r, doc_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS r, doc_id, {_words("text", term)} AS w FROM documents)),
        v AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM e GROUP BY r, term),
        sized AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM v GROUP BY r),
        s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
        m AS (SELECT r, 100 - 50 + (50 * n * docs) // terms AS m FROM sized, s),
        q AS MATERIALIZED (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_words("text", term)} AS w FROM benchmark)),
        weighed AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM v, s GROUP BY term),
        scored AS (SELECT q.i, any_value(q.item_id) AS item_id, v.r, any_value(v.doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM q JOIN v USING (term) JOIN weighed USING (term) JOIN m USING (r) GROUP BY q.i, v.r)
        SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank
            FROM scored WHERE score > 0) WHERE rank <= {lexical.MOST}"""


STATEMENTS = {
    "op1_mix_sources": _mix_sql(),
    "op4_url_filter": _url_sql(),
    "op11_source_divergence": _divergence_sql(),
    "op12_decontamination": _winnowing_sql(),
    "op13_lexical_search": _search_sql(),
}
