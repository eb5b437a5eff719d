"""Registered queries of this subpackage, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, merkle, mixing, pii, ppm, quality_classifier, secret_scan, simhash, token_counts, topk, warc
from . import quality_rules as rules
from .common import table

#: the tokenizer of the queries, and the one it is aligned with
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _rules_sql(r: rules.Rules) -> str:
    """Divergence rules over the documents in DuckDB, written from the definition and not from the plan."""
    words = ", ".join(f"('{lang}', {list(ws)}, {[x / 100 for x in ws.values()]})" for lang, ws in r.references.items())
    shares = [x / sum(r.classes) for x in r.classes]

    def js(ps: str, qs: str) -> str:
        half = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) / 2 ELSE 0 END))"
        return f"sqrt(greatest({half.format(a=ps, b=qs)} + {half.format(a=qs, b=ps)}, 0.0))"

    def count(pattern: str) -> str:
        return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"

    kinds = [r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]", r"[\p{Lu}\p{Lt}]", r"[\x20\x09-\x0D\p{Z}\p{C}]", r"[#*$%&|<>\p{S}]",
             r"[^\p{L}\p{M}\x20\x09-\x0D\p{Z}\p{C}#*$%&|<>\p{S}\p{N}]"]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n
  FROM (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d))
), covered AS (
  SELECT r, sum(step) AS n FROM (
    SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS step FROM windows WHERE n > 1) GROUP BY r
), measures AS (
  SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '\p{{N}}', '', 'g')) AS chars,
         [{', '.join(count(k) for k in kinds)}] AS counts
  FROM d LEFT JOIN covered c ON d.r = c.r
), reference(lang, names, shares) AS (VALUES {words}),
found AS (
  SELECT m.r, f.lang, f.shares || [1 - list_sum(f.shares)] AS q,
         list_transform(f.names, lambda x: len(list_filter(m.w, lambda y: y = x)) / m.n_words) AS p
  FROM measures m JOIN reference f ON lower(m.lang) = f.lang OR m.lang IS NULL
       OR lower(m.lang) NOT IN (SELECT lang FROM reference)
  WHERE m.n_words >= {r.min_words}
), near AS (
  SELECT r, min({js('p || [1 - list_sum(p)]', 'q')}) AS distance FROM found GROUP BY r
), judged AS (
  SELECT m.*, n_words < {r.fail_words} OR 100 * n_repeat_words > {r.fail_repeat_percent} * n_words AS base_failed,
         CASE WHEN chars >= {r.min_chars} THEN {js('list_transform(counts, lambda c: c / chars)', str(shares))} END AS class_distance,
         n.distance AS word_distance
  FROM measures m LEFT JOIN near n ON m.r = n.r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
         AND coalesce(class_distance <= CASE WHEN n_words < {r.min_words} THEN {r.short_class_distance} ELSE {r.max_class_distance} END, true)
         AND coalesce(word_distance <= {r.max_word_distance}, true) AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged"""


@query("op7_quality_rules", _rules_sql(rules.Rules()))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Token number and digests of decoded documents."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return pii.find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[pii.count_kind(spans, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed(spans, pii.BASE).cast("binary"), 256).alias("base_sha256"),
        pii.listed(spans, pii.KINDS).alias("spans"),
    )


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query("op4_ppm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents")).select("doc_id", "kept", "score", "label")


def _mix_sql(m: mixing.Mix) -> str:
    """The same draw in DuckDB: a recursive bisection and one window over each source."""
    power = "list_sum(list_transform(l, lambda x: pow(x, {a})))"
    entropy = f"ln({power}) - {{a}} * list_sum(list_transform(l, lambda x: pow(x, {{a}}) * ln(x))) / {power}"
    repeats = f"list_max(list_transform(l, lambda x: pow(x, {{a}} - 1))) / {power} * {m.budget}"
    entropic, repeated = f"({entropy}) >= {m.entropy} * ln(len(l))", f"({repeats}) > {m.max_repeats}"
    middle = "((low + high) / 2)"
    tree = """{name}(i, low, high, l) AS (
  SELECT 0, CASE WHEN {at1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE, l FROM shares
  UNION ALL
  SELECT i + 1, CASE WHEN {atm} THEN {m} ELSE low END, CASE WHEN {atm} THEN high ELSE {m} END, l FROM {name} WHERE i < {steps}
)"""
    trees = ", ".join(tree.format(name=n, at1=c.format(a="1.0"), atm=c.format(a=middle), m=middle, steps=mixing.STEPS)
                      for n, c in (("entropic", entropic), ("repeated", repeated)))
    return rf"""
WITH RECURSIVE rows_of AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS key,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS n_tokens
  FROM documents
), totals AS (SELECT key, sum(n_tokens)::DOUBLE AS tokens FROM rows_of GROUP BY key HAVING sum(n_tokens) > 0),
shares AS (SELECT list(tokens / (SELECT sum(tokens) FROM totals) ORDER BY key) AS l FROM totals),
{trees},
chosen AS (
  SELECT greatest((SELECT low FROM entropic WHERE i = {mixing.STEPS}),
                  (SELECT CASE WHEN low > 0 AND low < 1 THEN low + pow(2.0, -{mixing.STEPS}) ELSE low END FROM repeated WHERE i = {mixing.STEPS})) AS a
), weights AS (
  SELECT key, tokens, pow(tokens / sum(tokens) OVER (), a) / sum(pow(tokens / total, a)) OVER () AS weight
  FROM (SELECT *, sum(tokens) OVER () AS total FROM totals), chosen
), plan AS (
  SELECT *, floor(quota / tokens)::BIGINT AS passes, (quota - floor(quota / tokens) * tokens)::BIGINT AS rest
  FROM (SELECT *, floor(weight * ({m.budget} * (SELECT sum(tokens) FROM totals)) + 0.001) AS quota FROM weights)
), laid AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY key, epoch ORDER BY hash, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS last
  FROM (SELECT *, md5('{m.seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || epoch) AS hash
        FROM (SELECT r.*, p.tokens, p.passes, p.rest, p.weight, unnest(range(0, p.passes + 1)) AS epoch FROM rows_of r JOIN plan p USING (key)))
), placed AS (
  SELECT *, floor((epoch * tokens + last - n_tokens) / greatest(1, ceil(weight * {m.block_tokens})))::BIGINT AS block
  FROM laid WHERE epoch < passes OR last <= rest
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, block,
       row_number() OVER (PARTITION BY block ORDER BY md5(hash || '|block'), doc_id, n_tokens, key) - 1 AS place
FROM placed"""


@query("op10_mixing", _mix_sql(mixing.Mix()))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"))


@query("op2_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, strlen(html) AS n,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31), 1)), '') AS digest,
         max(page_id) OVER (PARTITION BY h) AS latest
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM d""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_secret_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[secret_scan.count_kind(spans, k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.listed(spans, secret_scan.BASE).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(spans, secret_scan.KINDS).alias("spans"),
    )


def _merkle_sql() -> str:
    """The same trees level by level in DuckDB: nodes by a recursion upwards, proofs by a recursion from every leaf."""
    fan = merkle.FAN

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c if c != "text" else text) for c in merkle.FIELDS) + ")"

    def tree(p: str, base: str) -> str:
        return f"""{p}_tree(level, grp, pos, n, digest) AS (
  {base}
  UNION ALL
  SELECT level + 1, grp, pos // {fan}, (n + {fan - 1}) // {fan}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {p}_tree WHERE n > 1 GROUP BY level, grp, pos // {fan}, n
), {p}_runs AS (
  SELECT level, grp, pos // {fan} AS run, list(digest ORDER BY pos) AS l FROM {p}_tree WHERE n > 1 GROUP BY ALL
), {p}_tops AS (SELECT grp, digest FROM {p}_tree WHERE n = 1)"""

    def walk(p: str, base: str) -> str:
        return f"""{p}_walk(r, level, grp, pos, proof, folded, done) AS (
  {base}
  UNION ALL
  SELECT w.r, w.level + 1, w.grp, w.pos // {fan},
         w.proof || array_to_string(u.l[:w.pos % {fan}], '') || array_to_string(u.l[w.pos % {fan} + 2:], ''),
         sha256(array_to_string(u.l[:w.pos % {fan}], '') || w.folded || array_to_string(u.l[w.pos % {fan} + 2:], '')), false
  FROM {p}_walk w JOIN {p}_runs u ON u.level = w.level AND u.grp = w.grp AND u.run = w.pos // {fan}
), {p}_end AS (SELECT r, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM {p}_walk GROUP BY r)"""

    crc = ("list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: "
           "list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1::BIGINT, 3988292384::BIGINT * (x & 1))))")
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS grp, {leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % 3 = 0
              THEN {leaf(f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')")} ELSE {leaf('text')} END AS claimed
  FROM documents
), places AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d
), {tree('low', 'SELECT 0, grp, pos, n, leaf FROM places')},
subroots AS (SELECT grp AS lang, digest, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM low_tops),
{tree('high', "SELECT 0, '', pos, n, digest FROM subroots")},
{walk('low', "SELECT r, 0, grp, pos, '', claimed, false FROM places")},
{walk('high', "SELECT e.r, 0, '', s.pos, e.proof, e.folded, false FROM low_end e JOIN places p USING (r) JOIN subroots s ON s.lang = p.grp")}
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
       e.folded = t.digest AS verified
FROM places p JOIN subroots s ON s.lang = p.grp JOIN high_end e USING (r) CROSS JOIN high_tops t"""


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), claimed={"text": merkle.tampered_text()}, witnesses=False)
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECES))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
