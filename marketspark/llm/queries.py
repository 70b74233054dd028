"""The corpus queries over the given tables, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import bpe, decontaminate, hmm, langid, mixing, periods, phrases, quality, secrets, simhash, sketches, substrings, warc
from marketspark.llm.common import documents
from marketspark.session import new_path, ship_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Production parameters of the mixture: no source is repeated more than twice as often as another.
MIX_REPEATS, MIX_SEED = 2.0, 1


def query(build: Callable[[SparkSession, str], DataFrame] | None = None, sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL twin where SQL can say it."""
    if build is None:
        return lambda build: query(build, sql)
    QUERIES[build.__name__] = build
    if sql:
        ORACLE[build.__name__] = sql
    return build


@query(
    sql="""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w),
    ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM win),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM ranked WHERE n > 1),
    word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find_repeats(documents(spark, sf_dir), length=20).drop("spans")


@query(
    sql="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT h, min(page_id) AS m FROM p WHERE strlen(h) >= 100 GROUP BY h)
    SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest,
        CASE WHEN f.m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.m < page_id THEN f.m END AS refers_to
    FROM p LEFT JOIN f USING (h)"""
)
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    root = new_path(spark, "warc")
    manifest = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return warc.read(manifest, root).drop("url")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.with_next(documents(spark, sf_dir))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy")


@query
def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir)).withColumn("votes", F.array_join("votes", ","))


@query(
    sql=f"""    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
    c AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY source HAVING sum(n_tokens) > 0),
    r AS (SELECT max(ln(tokens)) - min(ln(tokens)) AS spread FROM c),
    b AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM r
        UNION ALL SELECT k + 1, CASE WHEN exp((1 - (low + high) / 2) * spread) <= {MIX_REPEATS} THEN low ELSE (low + high) / 2 END,
            CASE WHEN exp((1 - (low + high) / 2) * spread) <= {MIX_REPEATS} THEN (low + high) / 2 ELSE high END FROM b, r WHERE k < 40),
    a AS (SELECT CASE WHEN exp(spread) <= {MIX_REPEATS} THEN 0.0 ELSE high END AS a FROM b, r WHERE k = 40),
    t AS (SELECT max(pow(tokens, 1 - a)) * sum(pow(tokens, a)) AS spend, sum(pow(tokens, a)) AS z FROM c, a),
    p AS (SELECT source, tokens, docs, CAST(ceil(sqrt(docs)) AS BIGINT) AS blocks, CAST(round(spend * (pow(tokens, a) / z)) AS BIGINT) AS target FROM c, a, t),
    s AS (SELECT *, target // tokens AS epochs, target % tokens AS rest FROM p),
    o AS (SELECT d.doc_id, d.source, n_tokens, epochs, rest, blocks, CAST('0x' || md5('b{MIX_SEED}:' || d.doc_id)[:12] AS BIGINT) % blocks AS block,
        CAST('0x' || md5('d{MIX_SEED}:' || epochs || ':' || d.doc_id)[:12] AS BIGINT) AS doc_key FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
    k AS (SELECT *, CAST('0x' || md5('p{MIX_SEED}:' || epochs || ':' || coalesce(source, '') || ':' || block)[:12] AS BIGINT) AS block_key FROM o),
    f AS (SELECT *, n_tokens > 0 AND coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY block_key, block, doc_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS more FROM k)
    SELECT doc_id, source, CAST(unnest(range(0, epochs + CAST(more AS BIGINT))) AS INTEGER) AS copy, n_tokens FROM f"""
)
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), repeats=MIX_REPEATS, seed=MIX_SEED).select("doc_id", "source", "copy", mixing.n_tokens().alias("n_tokens"))


@query
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op10_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


@query
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    made = bpe.decode(bpe.encode(documents(spark, sf_dir), vocabulary), vocabulary)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    sql="""
    WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents WHERE text IS NOT NULL),
    q AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\\x20\\x09]+') AS ws FROM p),
    o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM q),
    g AS (SELECT lang, ws[i:i + m - 1] AS ws, m FROM o, (VALUES (1), (2), (3)) v(m) WHERE i + m - 1 <= len(ws)),
    c AS (SELECT lang, m, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
    k AS (SELECT lang, m, ws, phrase, f AS a, unnest(range(1, m)) AS k FROM c WHERE m > 1 AND f >= 10),
    s AS (SELECT k.*, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM k
        JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:k.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    x AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND b.m = 2 AND c.m = 3 AND c.f >= 10 AND 100 * c.f >= 50 * b.a AND c.ws[1:2] = b.ws)
        AND NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND b.m = 2 AND c.m = 3 AND c.f >= 10 AND 100 * c.f >= 50 * b.a AND c.ws[2:3] = b.ws)),
    t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM x)
    SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), order=3, least=10, contained_percent=50, top=2000)


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of every tenth document by the hash of its id repeat with a period from some word on."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    repeated = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p AS int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(planted_periods(documents(spark, sf_dir)), least=24, times=3)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
